"""Operators over series: edge cases of the fixtures' list and properties."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrine.operators import align, cycles, histogram, ramps, resample, reshape, score, stats, weibull
from zephyrine.sources import series as sources

SERIES = "source string, time timestamp_ntz, M double, Dir double"
T0 = dt.datetime(2020, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def metrics(df):
    return {(r.source, r.var, r.metric): r.value for r in df.collect()}


@pytest.fixture(scope="module")
def two(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        m, d = 8 + 3 * math.sin(i / 20) + r.random(), r.random() * 360
        rows += [("ref", at(60 * i), m, d), ("new", at(60 * i), m + 0.5, (d + 10) % 360)]
    return spark.createDataFrame(rows, SERIES)


def test_a_series_against_itself(two):
    same = two.where("source = 'ref'").unionByName(two.where("source = 'ref'").withColumn("source", F.lit("new")))
    got = metrics(stats.compare_stats(align.pairs(align.time_match_sources(same), "ref")))
    for v in ("M", "Dir"):
        assert all(abs(got["new", v, m]) < 1e-9 for m in ("bias", "rmse", "EMD", "MAE", "std_bias", "bias_max")) and math.isclose(got["new", v, "r2"], 1)
    assert math.isclose(got["new", "M", "lfit_slope"], 1) and ("new", "Dir", "factor") not in got


def test_a_shift(two):
    got = metrics(stats.compare_stats(align.pairs(two, "ref")))
    for m in ("bias", "EMD", "rmse", "MAE", "bias_q0.5", "td_error_q0.98"):
        assert math.isclose(got["new", "M", m], 0.5, abs_tol=1e-9)
    for m in ("bias", "rmse", "MAE", "td_bias_q0.02"):
        assert math.isclose(got["new", "Dir", m], 10, abs_tol=1e-6)
    assert math.isclose(got["new", "Dir", "r2"], 1, rel_tol=1e-9)


def test_edges_of_comparison(spark):
    p = "source string, var string, ref double, new double"
    one = spark.createDataFrame([("n", "M", 1.0, 2.0)], p)
    assert stats.compare_stats(one).count() == 0
    flat = metrics(stats.compare_stats(spark.createDataFrame([("n", "M", 0.0, 1.0)] * 3 + [("n", "M", None, 5.0)], p)))
    assert flat["n", "M", "length"] == 4 and flat["n", "M", "factor"] == 0 and ("n", "M", "r2") not in flat and flat["n", "M", "EMD"] == 2.0
    turn = metrics(stats.compare_stats(spark.createDataFrame([("n", "Dir", 359.0, 1.0), ("n", "Dir", 1.0, 359.0)], p)))
    assert math.isclose(turn["n", "Dir", "rmse"], 2) and abs(turn["n", "Dir", "bias"]) < 1e-6
    energy = metrics(stats.compare_stats(spark.createDataFrame([("n", "energy", 1.0, 2.0), ("n", "energy", 3.0, 1.0)], p)))
    assert (energy["n", "energy", "sum"], energy["n", "energy", "bias_sum"], energy["n", "energy", "SAE"]) == (3, -1, 3)
    w = spark.createDataFrame([("n", "k", 1.0, 2.0, 3.0), ("n", "k", 1.0, 1.0, 1.0)], p + ", weight double")
    got = metrics(stats.compare_stats(w))
    assert math.isclose(got["n", "k", "weighted_rmse"], math.sqrt(0.75)) and math.isclose(got["n", "k", "weighted_MAE"], math.sqrt(0.75))
    approx = metrics(stats.compare_stats(spark.createDataFrame([("n", "M", float(i), float(i)) for i in range(100)], p), accuracy=1000, distribution_only=True))
    assert abs(approx["n", "M", "q0.5"] - 49.5) <= 1 and approx["n", "M", "bias_length"] == 0


def test_emd_of_unequal_samples(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=57), r.normal(1, 2, size=140)
    rows = [("x", float(v), None) for v in a] + [("x", None, float(v)) for v in b]
    grid = np.sort(np.concatenate((a, b)))
    f, g = np.searchsorted(np.sort(a), grid[:-1], "right") / len(a), np.searchsorted(np.sort(b), grid[:-1], "right") / len(b)
    want = float(np.sum(np.abs(f - g) * np.diff(grid)))
    for buckets in (1, 7, 1024):
        got = stats.emd(spark.createDataFrame(rows, "source string, ref double, new double"), ["source"], buckets).first()["emd"]
        assert math.isclose(got, want, rel_tol=1e-9)


def test_alignment(spark):
    rows = [("a", at(0), 1.0, None), ("a", at(0), 0.5, 9.0), ("a", at(10), None, None), ("a", at(20), 3.0, None), ("b", at(0), 1.0, 1.0), ("b", at(10), 1.0, 1.0), ("b", at(30), 1.0, 1.0)]
    df = spark.createDataFrame(rows, SERIES)
    assert sorted((r.source, r.time, r.M) for r in align.time_match_sources(df).collect()) == [("a", at(0), 0.5), ("b", at(0), 1.0)]
    assert {(r.time, r.M) for r in align.drop_duplicates_time(df, -F.col("M")).where("source = 'a'").collect()} == {(at(0), 1.0), (at(10), None), (at(20), 3.0)}
    freq = {r.source: r.freq_min for r in align.deduce_frequency(df).collect()}
    assert freq == {"a": 10, "b": 10}
    grid = align.regularize(align.drop_duplicates_time(df)).where("source = 'b'").orderBy("index").collect()
    assert [(r.time, r.M) for r in grid] == [(at(0), 1.0), (at(10), 1.0), (at(20), None), (at(30), 1.0)]
    assert align.deduce_frequency(df.limit(1)).count() == 0


def test_ramps_and_noise_in_chunks(spark):
    r = random.Random(2)
    rows = [("s", at(10 * i), r.random() * 10, r.random() * 360) for i in range(300) if i % 17 and i % 90 > 12]
    df = spark.createDataFrame(rows, SERIES)
    x = dict((t, (m, d)) for _, t, m, d in rows)
    want = {t: m - x[t - dt.timedelta(minutes=10)][0] for t, (m, d) in x.items() if t - dt.timedelta(minutes=10) in x}
    for chunk in (8, 1000):
        got = {q.time: q["M-ramp"] for q in ramps.ramps(df, chunk=chunk).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], abs_tol=1e-12) for t in want)
    first, last = min(x), max(x)
    n = int((last - first).total_seconds() // 600) + 1
    v = [x.get(first + dt.timedelta(minutes=10 * i), (None,))[0] for i in range(n)]

    def mean(a, lo, hi, least):
        some = [q for q in a[max(lo, 0) : hi] if q is not None]
        return sum(some) / len(some) if len(some) >= least else None

    raw = [None if v[i] is None or mean(v, i - 1, i + 2, 2) is None else abs(v[i] - mean(v, i - 1, i + 2, 2)) for i in range(n)]
    want = [mean(raw, i - 6, i + 6, 6) for i in range(n)]
    for chunk in (32, 10_000):
        got = [q["M-noise"] for q in ramps.noise(df, ["M"], chunk=chunk).orderBy("time").collect()]
        assert len(got) == n and all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(got, want, strict=True))
    flat = spark.createDataFrame([("s", at(10 * i), 5.0, 0.0) for i in range(40)], SERIES)
    assert {q[0] for q in ramps.noise(flat, ["M"], fill="mean").select("M-noise").collect()} == {0.0}


def test_resampling(two):
    assert [resample.min_values_period(p, 6) for p in ("hourly", "6-hourly", "daily", "weekly", "monthly", "yearly")] == [4, 27, 129, 907, 3758, 47304]
    assert resample.min_values_period("daily", None) == 0 and resample.per_hour(two, "ref") == 1
    got = metrics(resample.stats_in_resampling(align.pairs(two, "ref"), "daily", 1))
    assert got["new", "M", "length_daily"] == 25 and math.isclose(got["new", "M", "rmse_daily"], 0.5) and math.isclose(got["new", "M", "EMD_daily"], 0.5) and math.isclose(got["new", "Dir", "MAE_daily"], 10)
    yearly = metrics(resample.stats_in_resampling(align.pairs(two, "ref"), "yearly", None))
    assert yearly["new", "M", "length_yearly"] == 1 and ("new", "M", "r2_yearly") not in yearly and ("new", "M", "EMD_yearly") not in yearly


def test_histogram(two):
    dist = histogram.distribution(two)
    assert dist.agg(F.sum("n")).first()[0] <= two.count() and dist.where("n = 0").count() > 0
    full = histogram.distribution(two, include_top_bin=True)
    assert full.agg(F.sum("n")).first()[0] == two.count()
    shares = histogram.bin_population(full, min_samples=0).groupBy("source").agg(F.sum("population").alias("p")).collect()
    assert all(math.isclose(r.p, 100) for r in shares)
    both = metrics(histogram.compare_tabfiles(two, "ref", sectors=2, relative=True))
    assert ("new", "TAB_relpop", "rmse") in both and ("new", "TAB_relpop", "r2") not in both


def test_weibull_recovery(spark):
    r = np.random.default_rng(1)
    rows = [("a", at(i), float(x), 0.0) for i, x in enumerate(9 * r.weibull(2.1, 20_000))] + [("b", at(i), 1.0, 0.0) for i in range(9)] + [("c", at(i), 3.2, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, SERIES)
    for method in ("params", "values", "histogram"):
        got = {x.source: x for x in weibull.weibull_fit(df, ["source"], method=method).collect()}
        assert abs(got["a"].k - 2.1) < 0.06 and abs(got["a"].A - 9) < 0.12 and got["b"].k is None and got["c"].k is None
    assert math.isclose(spark.range(1).select(weibull.gamma(F.lit(4.5)).alias("g")).first().g, math.gamma(4.5), rel_tol=1e-12)
    with pytest.raises(ValueError):
        weibull.weibull_fit(df, ["source"], method="other")
    q = weibull.weibull_quality(df.where("source = 'a'"), weibull.weibull_fit(df, ["source"]), ["source"]).first()
    assert q.fit_r2 > 0.9 and abs(q.fit_mbias) < 0.1


def test_cycles(two):
    cells = cycles.seasonal_daily_cycle(two, min_days=5)
    assert cells.count() == 2 * 24 * 1 and cells.where("M is null").count() == 0
    assert cycles.seasonal_daily_cycle(two, min_days=500).where("M is not null").count() == 0
    assert "Dir" not in cycles.seasonal_daily_cycle(two, stat="max").columns
    norm = cycles.seasonal_daily_cycle(two, min_days=5, normalized=True)
    assert all(abs(r.m) < 1e-9 for r in norm.groupBy("source").agg(F.avg("M").alias("m")).collect()) and norm.columns == ["source", "month", "hour", "M", "count"]
    with pytest.raises(ValueError):
        cycles.seasonal_daily_cycle(two, stat="mode")


def test_quality_bounds(spark):
    for which, want in (("perfect", 10), ("good", 0)):
        rows = [("n", v, m, float(p if which == "perfect" else g)) for v, m, p, g, _ in score.RULES]
        quality = score.compute_quality(spark.createDataFrame(rows, "source string, var string, metric string, value double"))
        total = score.total_quality(quality).first()
        assert math.isclose(total.quality, want, abs_tol=1e-9) and total.rules_used == 74 and total.rules_missing == 0
    part = score.total_quality(score.compute_quality(spark.createDataFrame([("n", "M", "rmse", 0.75)], "source string, var string, metric string, value double"))).first()
    assert math.isclose(part.quality, 5) and part.rules_missing == 73
    assert sum(r[4] for r in score.RULES) == 106


def test_full_score_of_a_perfect_submission(spark):
    from zephyrine.plans import fixtures

    ref = fixtures.wind(spark, "/root/testdata/sf0.001").where("source = 'ref'").drop("source")
    quality, total = score.score(ref, ref)
    row = total.first()
    assert math.isclose(row.quality, 10, abs_tol=1e-6) and row.rules_used >= 70, quality.where("quality_index is null").collect()


def test_reshaping(spark):
    wide = spark.createDataFrame([(T0, 1.0, 5.0, None, 2.0, 9), (at(10), None, 5.0, 10.0, 2.0, 9)], "time timestamp_ntz, `U_10.00` double, `U_50.00` double, `U_100.00` double, `V_10.00` double, other int")
    long = reshape.wide_to_long(wide)
    assert long.columns == ["time", "other", "lev", "U", "V"] and long.count() == 6
    assert reshape.long_to_wide(long, [10.0, 50.0], ["U"]).columns == ["time", "U_10.0", "U_50.0"]
    got = reshape.level_interp(wide).orderBy("time").collect()
    assert got[0]["U_70.0"] is None and math.isclose(got[1]["U_70.0"], 7.0) and got[1]["V_70.0"] is None
    built = sources.dataset_build(wide.drop("other"), wind=False)
    assert built.columns == ["time", "U_10.0", "U_50.0", "U_100.0", "V_10.0", "U_70.0", "V_70.0"]
    with pytest.raises(ValueError):
        reshape.wide_to_long(spark.range(1))
    df = spark.createDataFrame([(1, 2.0, float("inf"), float("nan"))], "i long, x double, y double, z double")
    assert dict(reshape.downcast32(df).dtypes) == {"i": "int", "x": "float", "y": "float", "z": "float"}
    one = reshape.nan_to_null(reshape.replace_inf(df)).first()
    assert one.y is None and one.z is None
    tagged = reshape.with_metadata(df.withColumnRenamed("x", "M"), sources.METADATA)
    assert tagged.schema["M"].metadata["units"] == "m/s"
    assert reshape.apply_general(df, lambda s: s * 2, ["x"], pandas=True).first().x == 4
    with pytest.raises(ValueError):
        reshape.lag_and_lead(df, ["nothing"])


def test_csv_and_submission(spark, tmp_path):
    (tmp_path / "train.csv").write_text("sample,time,U_10.00,U_100.00,V_10.00,V_100.00,M,Dir\n0,2020-01-01 00:00:00,1,3,0,0,NaN,5\n1,2020-01-01 00:10:00,2,4,1,1,2,6\n")
    x, y = sources.get_train_x(spark, str(tmp_path)), sources.get_train_y(spark, str(tmp_path))
    assert x.count() == 2 and "U_70.0" in x.columns and y.columns == ["time", "M", "Dir", "lev"] and y.orderBy("time").first().M is None
    sources.check_inputs(spark, str(tmp_path), ["train.csv"])
    with pytest.raises(FileNotFoundError):
        sources.check_inputs(spark, str(tmp_path), ["test.csv"])
    df = spark.createDataFrame([(at(20), 0.0, -1.0), (at(0), -1.0, 0.0)], "time timestamp_ntz, U double, V double")
    got = sources.prepare_submission(df).orderBy("sample").collect()
    assert [(r.sample, r.time, r.M, r.Dir) for r in got] == [(0, at(0), 1.0, 90.0), (1, at(20), 1.0, 360.0)]
    with pytest.raises(ValueError):
        sources.prepare_submission(df.drop("U"))
    with pytest.raises(ValueError):
        sources.prepare_submission(df.drop("time"))
    sources.write_parquet(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert sources.get_logger("zephyrine.test", str(tmp_path / "log")) is sources.get_logger("zephyrine.test")


def test_quantiles_are_exact_and_bounded_by_buckets(spark):
    r = random.Random(3)
    rows = [(s, "Dir" if s == "c" else "M", r.choice([None, r.uniform(0, 30), float(r.randrange(5))]), r.choice([None, r.gauss(10, 4)])) for s in "abc" for _ in range(400)] + [("d", "M", 1.0, None), ("d", "M", 2.0, None), ("e", "M", 5.0, 5.0), ("e", "M", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "source string, var string, ref double, new double")
    got = {x.source: x for x in stats.distributions(df, ["source"], stats.QUANTILES).collect()}
    for s in "abcde":
        for side, i in (("q_ref", 2), ("q_new", 3)):
            have = [x[i] for x in rows if x[0] == s and x[i] is not None]
            want = np.quantile(have, stats.QUANTILES) if have else [None] * 5
            assert all(a is None and b is None or math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[s][side], want, strict=True)), (s, side)
    assert got["d"].emd is None and got["e"].emd == 0
    metrics = {(x.source, x.metric): x.value for x in stats.compare_stats(df).collect()}
    e = [n - f for s, _, f, n in rows if s == "a" and f is not None and n is not None]
    assert math.isclose(metrics["a", "td_bias_q0.25"], np.quantile(e, 0.25), abs_tol=1e-9) and math.isclose(metrics["a", "td_error_q0.98"], np.quantile(np.abs(e), 0.98), abs_tol=1e-9)
    near = {(x.source, x.metric): x.value for x in stats.compare_stats(df, accuracy=10000).collect()}
    assert set(near) == set(metrics) and all(abs(near[k] - v) < 0.5 for k, v in metrics.items() if "_q" not in k[1] and not k[1].startswith("q"))


def test_frequency_and_lags_over_days(spark):
    times = [at(10 * i) for i in range(0, 400)] + [at(10 * 400 + 37 * i) for i in range(500)] + [at(60 * 24 * 40), at(60 * 24 * 40 + 5)]
    rows = [("a", t, float(i)) for i, t in enumerate(times)] + [("b", at(0), 1.0), (None, at(3), 2.0), (None, None, 7.0)]
    df = spark.createDataFrame(rows, "source string, time timestamp_ntz, M double")
    assert {x.source: x.freq_min for x in align.deduce_frequency(df).collect()} == {"a": 37}
    assert {x.source: x.freq_min for x in align.deduce_frequency(df, 200).collect()} == {"a": 10}
    got = {(x.source, x.time): (x.M_lag1, x.M_lead1) for x in reshape.lag_and_lead(df, ["M"]).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(times):
        assert got["a", t] == (float(i + 1) if i + 1 < len(times) else None, float(i - 1) if i else None)
    assert got["b", at(0)] == (None, None) and got[None, at(3)] == (None, 7.0) and got[None, None] == (2.0, None)


def test_shape_of_values_by_aggregates(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(x)) for k, shape in (("a", 2.0), ("b", 0.8), ("c", 7.0)) for x in 9 * r.weibull(shape, 3000)] + [("d", 3.0)] * 12 + [("e", 1.0)]
    df = spark.createDataFrame(rows, "source string, M double")
    got = {x.source: x for x in weibull.weibull_fit(df, ["source"], method="values").collect()}
    for s in "abc":
        x = np.array([v for k, v in rows if k == s])
        slope = (x ** got[s].k * np.log(x)).sum() / (x ** got[s].k).sum() - 1 / got[s].k - np.log(x).mean()
        assert abs(slope) < 1e-9 and math.isclose(got[s].A, (x ** got[s].k).mean() ** (1 / got[s].k))
    assert got["d"].k is None and got["e"]["count"] == 1


def test_functions_by_group(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 11.0), ("b", 2.0, 100.0)], "source string, M double, Dir double")
    with pytest.raises(ValueError):
        weibull.apply_by_sectors(df, lambda f: f)
    made = weibull.apply_by_sectors(df, lambda f: f.groupby(["source", "sector"], as_index=False).agg(M=("M", "sum")), schema="source string, sector double, M double")
    assert sorted(tuple(x) for x in made.collect()) == [("a", 0.0, 4.0), ("b", 90.0, 2.0)]


def test_shared_folder_is_asked_for_off_one_machine(spark):
    from zephyrine import session

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Session(master))
    for master in ("local", "local[4]"):
        assert session.shared_dir(Session(master)).startswith("file:")
    plain = spark.range(10).selectExpr("id", "id * 2 as x")
    assert session.settled(plain) is plain and session.settled(plain.groupBy("x").count()).count() == 10
