"""Every registered query of the time-series operators, each with SQL of its own making where SQL can say it.

Doubles are rounded to six digits on both sides. The SQL uses other formulas than the operators where there are any: sorted ranks for the distance of distributions, closed forms for wrapped angles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrine.functions import dates, power as curve, wind
from zephyrine.ml import blend, splits, train
from zephyrine.operators import align, cycles, histogram, ramps, resample, reshape, score, stats, weibull
from zephyrine.sources import series as sources

from . import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

REF = {"hourly": "view", "daily": "1-URGENT", "wind": "ref"}
SQL = {"hourly": fixtures.SQL_HOURLY, "daily": fixtures.SQL_DAILY, "wind": fixtures.SQL_WIND, "wide": fixtures.SQL_WIDE}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero; NaN, which two engines may write differently, as null."""
    return df.select(*((F.round(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`").cast("double")), 6) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in ((c, t) for c, t in df.dtypes)))


def shown(inner: str, columns: str) -> str:
    """SQL that gives columns of inner, `name:kind`: d double, l long, i int, s as it is."""
    kinds = {"d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "l": "CAST({0} AS BIGINT)", "i": "CAST({0} AS INTEGER)", "s": "{0}"}
    parts = []
    for column in columns.split():
        name, _, kind = column.rpartition(":")
        parts.append(kinds[kind].format(f'"{name}"') + f' AS "{name}"')
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS shown_rows"


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


def pairs_sql(series: str, ref: str, names=("M", "Dir")) -> str:
    parts = [f"SELECT n.source, '{v}' AS var, n.time, r.{v} AS ref, n.{v} AS new FROM s n JOIN s r ON n.time = r.time WHERE r.source = '{ref}' AND n.source <> '{ref}'" for v in names]
    return f"WITH s AS ({series}), p AS ({' UNION ALL '.join(parts)})"


E = "CASE WHEN var LIKE 'Dir%' THEN (new - ref) - 360*floor((new - ref + 180)/360) ELSE new - ref END"


def wrap_sql(x: str) -> str:
    return f"CASE WHEN var LIKE 'Dir%' AND abs({x}) > 180 THEN {x} - 360*sign({x}) ELSE {x} END"


def stats_sql(pairs: str, *, tail: str = "", emd: bool = True) -> str:
    """Metrics of the CTE p; pairs ends with it."""
    rad = {s: f"sin(radians({s}))" for s in ("ref", "new")}
    agg = ["count(*) AS n"]
    for s in ("ref", "new"):
        agg += [f"avg({s}) AS mean_{s}", f"stddev_pop({s}) AS std_{s}", f"max({s}) AS max_{s}", f"avg({rad[s]}) AS s_{s}", f"avg(cos(radians({s}))) AS c_{s}"]
        agg += [f"quantile_cont({s}, {q}) AS q_{s}_{i}" for i, q in enumerate(stats.QUANTILES)]
    agg += ["avg(abs(e)) AS mae", "sqrt(avg(e*e)) AS rmse", "corr(t, ref) AS r", "regr_slope(t, ref) AS slope", "regr_intercept(t, ref) AS icpt"]
    agg += [f"quantile_cont(e, {q}) AS qe_{i}, quantile_cont(abs(e), {q}) AS qa_{i}" for i, q in enumerate(stats.QUANTILES)]
    agg += ["list_avg(list_transform(list_zip(list_sort(list(ref)), list_sort(list(new))), lambda x: abs(x[1] - x[2]))) AS emd"] if emd else []
    side = {}
    for s in ("ref", "new"):
        side[f"mean_{s}"] = f"CASE WHEN var LIKE 'Dir%' THEN (degrees(atan2(s_{s}, c_{s})) + 360) % 360 ELSE mean_{s} END"
        side[f"std_{s}"] = f"CASE WHEN var LIKE 'Dir%' THEN degrees(sqrt(-ln(s_{s}*s_{s} + c_{s}*c_{s}))) ELSE std_{s} END"
    cells = {"length": "n", "mean": side["mean_new"], "bias": wrap_sql(f"({side['mean_new']} - {side['mean_ref']})"), "std": side["std_new"], "std_bias": wrap_sql(f"({side['std_new']} - {side['std_ref']})")}
    cells |= {"factor": "CASE WHEN var NOT IN ('Dir', 'U', 'V') THEN mean_ref/nullif(mean_new, 0) END", "max": "max_new", "bias_max": wrap_sql("(max_new - max_ref)"), "MAE": "mae", "rmse": "rmse", "r2": "r*r", "lfit_slope": "slope", "lfit_intercept": "icpt"}
    for i, q in enumerate(stats.QUANTILES):
        cells |= {f"q{q}": f"q_new_{i}", f"bias_q{q}": wrap_sql(f"(q_new_{i} - q_ref_{i})"), f"td_bias_q{q}": f"qe_{i}", f"td_error_q{q}": f"qa_{i}"}
    cells |= {"EMD": "emd"} if emd else {}
    names, values = ", ".join(f"'{k}'" for k in cells), ", ".join(f"CAST({v} AS DOUBLE)" for v in cells.values())
    return f"""{pairs}, e AS (SELECT *, {E} AS e FROM p), t AS (SELECT *, CASE WHEN var LIKE 'Dir%' THEN ref + e ELSE new END AS t FROM e),
      a AS (SELECT source, var, {', '.join(agg)} FROM t GROUP BY 1, 2 HAVING count(*) >= 2),
      m AS (SELECT source, var, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM a)
      {tail or 'SELECT * FROM m WHERE value IS NOT NULL'}"""


LONG = "source:s var:s metric:s value:d"
SERIES = "source:s time:s M:d Dir:d"


# --- alignment


@query("compare_stats", shown(stats_sql(pairs_sql(SQL["hourly"], "view")), LONG))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compare_stats(align.pairs(fixtures.hourly(spark, sf_dir), "view"))


@query("compare_stats_wind", shown(stats_sql(pairs_sql(SQL["wind"], "ref")), LONG))
def _(spark, sf_dir):
    return stats.compare_stats(align.pairs(fixtures.wind(spark, sf_dir), "ref"))


MATCH = "t AS (SELECT time FROM s WHERE M IS NOT NULL OR Dir IS NOT NULL GROUP BY time HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM s))"


@query("time_match_sources", shown(f"WITH s AS ({SQL['daily']}), {MATCH} SELECT s.* FROM s JOIN t USING (time)", SERIES))
def _(spark, sf_dir):
    return align.time_match_sources(fixtures.daily(spark, sf_dir))


@query("select_by_time", shown(f"WITH s AS ({SQL['daily']}) SELECT * FROM s WHERE time IN (SELECT time FROM s WHERE source = '5-LOW')", SERIES))
def _(spark, sf_dir):
    d = fixtures.daily(spark, sf_dir)
    return align.select_by_time(d, d.where("source = '5-LOW'"))


@query("drop_duplicates_time", shown("SELECT event_type AS source, date_trunc('hour', ts) AS time, arg_min(value, event_id) AS M FROM events GROUP BY 1, 2", "source:s time:s M:d"))
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), F.col("value").alias("M"), "event_id")
    return align.drop_duplicates_time(e, "event_id").drop("event_id")


GAPS = "SELECT source, time, CASE WHEN day(time) % 2 = 0 THEN M END AS M, CASE WHEN day(time) % 3 = 0 THEN Dir END AS Dir FROM ({})"


def gaps(df: DataFrame) -> DataFrame:
    return df.select("source", "time", F.when(F.day("time") % 2 == 0, F.col("M")).alias("M"), F.when(F.day("time") % 3 == 0, F.col("Dir")).alias("Dir"))


for _how, _word in (("all", "OR"), ("any", "AND")):
    QUERIES[f"dropna_{_how}"] = lambda spark, sf_dir, f=getattr(align, f"dropna_{_how}"): rounded(f(gaps(fixtures.daily(spark, sf_dir))))
    ORACLES[f"dropna_{_how}"] = shown(f"SELECT * FROM ({GAPS.format(SQL['daily'])}) WHERE M IS NOT NULL {_word} Dir IS NOT NULL", SERIES)


@query("combine_first", shown(f"WITH s AS ({GAPS.format(SQL['daily'])}), a AS (SELECT * FROM s WHERE source = '1-URGENT'), b AS (SELECT * FROM s WHERE source = '2-HIGH') SELECT coalesce(a.time, b.time) AS time, coalesce(a.M, b.M) AS M, coalesce(a.Dir, b.Dir) AS Dir FROM a FULL JOIN b ON a.time = b.time", "time:s M:d Dir:d"))
def _(spark, sf_dir):
    s = gaps(fixtures.daily(spark, sf_dir))
    a, b = (s.where(F.col("source") == x).select("time", "M", "Dir") for x in ("1-URGENT", "2-HIGH"))
    return align.combine_first(a, b, ["time"])


@query("outer_merge", shown(f"WITH s AS ({SQL['daily']}), a AS (SELECT time, M FROM s WHERE source = '1-URGENT'), b AS (SELECT time, Dir FROM s WHERE source = '2-HIGH' AND M > 5) SELECT coalesce(a.time, b.time) AS time, M, Dir FROM a FULL JOIN b ON a.time = b.time", "time:s M:d Dir:d"))
def _(spark, sf_dir):
    s = fixtures.daily(spark, sf_dir)
    return align.outer_merge([s.where("source = '1-URGENT'").select("time", "M"), s.where("source = '2-HIGH' and M > 5").select("time", "Dir")], ["time"])


FREQ = "d AS (SELECT source, time, date_diff('minute', lag(time) OVER (PARTITION BY source ORDER BY time), time) AS step FROM s), c AS (SELECT source, step, count(*) AS n, min(time) AS first FROM d WHERE step IS NOT NULL GROUP BY 1, 2), f AS (SELECT source, step AS freq_min FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1)"


@query("deduce_frequency", shown(f"WITH s AS ({SQL['wind']} UNION ALL {SQL['hourly']} UNION ALL {SQL['daily']}), {FREQ} SELECT * FROM f", "source:s freq_min:i"))
def _(spark, sf_dir):
    return align.deduce_frequency(fixtures.wind(spark, sf_dir).unionByName(fixtures.hourly(spark, sf_dir)).unionByName(fixtures.daily(spark, sf_dir)))


GRID = "b AS (SELECT source, min(time) AS t0, max(time) AS t1 FROM s GROUP BY 1), g AS (SELECT b.source, unnest(generate_series(t0, t1, to_minutes(freq_min))) AS time, freq_min FROM b JOIN f USING (source)), r AS (SELECT g.source, g.time, s.M, s.Dir, row_number() OVER (PARTITION BY g.source ORDER BY g.time) - 1 AS index FROM g LEFT JOIN s ON g.source = s.source AND g.time = s.time)"


@query("regularize", shown(f"WITH s AS ({SQL['daily']}), {FREQ}, {GRID} SELECT * FROM r", f"{SERIES} index:l"))
def _(spark, sf_dir):
    return align.regularize(fixtures.daily(spark, sf_dir)).select("source", "time", "M", "Dir", "index")


@query("intersect_times", shown(f"WITH s AS ({SQL['daily']}) SELECT time FROM s WHERE source = '1-URGENT' INTERSECT SELECT time FROM s WHERE source = '2-HIGH'", "time:s"))
def _(spark, sf_dir):
    s = fixtures.daily(spark, sf_dir)
    return s.where("source = '1-URGENT'").select("time").intersect(s.where("source = '2-HIGH'").select("time"))


@query("union_all", shown(f"SELECT source, time, M, NULL::DOUBLE AS Dir FROM ({SQL['daily']}) UNION ALL SELECT source, time, NULL, Dir FROM ({SQL['hourly']})", SERIES))
def _(spark, sf_dir):
    return reshape.union_all([fixtures.daily(spark, sf_dir).drop("Dir"), fixtures.hourly(spark, sf_dir).drop("M")]).select("source", "time", "M", "Dir")


@query("head_times", shown(f"SELECT * FROM ({SQL['hourly']}) WHERE source = 'view' ORDER BY time LIMIT 200", SERIES))
def _(spark, sf_dir):
    return fixtures.hourly(spark, sf_dir).where("source = 'view'").orderBy("time").limit(200)


# --- derived variables

UV = "SELECT source, time, M, Dir, -M*sin(radians(Dir)) AS U, -M*cos(radians(Dir)) AS V FROM ({})"


@query("wind_components", shown(UV.format(SQL["hourly"]), f"{SERIES} U:d V:d"))
def _(spark, sf_dir):
    h = fixtures.hourly(spark, sf_dir)
    return h.withColumns({"U": wind.derive(h, "U"), "V": wind.derive(h, "V")})


@query("wind_speed_direction", shown(f"SELECT source, time, M, CASE WHEN M = 0 THEN 180 WHEN Dir = 0 THEN 360 ELSE Dir END AS Dir FROM ({SQL['hourly']})", SERIES))
def _(spark, sf_dir):
    h = fixtures.hourly(spark, sf_dir)
    uv = h.select("source", "time", wind.derive(h, "U").alias("U"), wind.derive(h, "V").alias("V"))
    return uv.select("source", "time", wind.derive(uv, "M").alias("M"), F.when(F.round(wind.derive(uv, "Dir"), 6) == 0, 360.0).otherwise(wind.derive(uv, "Dir")).alias("Dir"))


@query("sector", shown(f"SELECT source, time, CAST(floor((Dir + 11.25)/22.5) AS INTEGER) % 16 AS s16, CAST(floor((Dir + 15)/30) AS INTEGER) % 12 AS s12, CAST(floor((Dir + 45)/90) AS INTEGER) % 4 AS s4 FROM ({SQL['hourly']})", "source:s time:s s16:i s12:i s4:i"))
def _(spark, sf_dir):
    return fixtures.hourly(spark, sf_dir).select("source", "time", *(wind.sector(F.col("Dir"), n).alias(f"s{n}") for n in (16, 12, 4)))


@query("bins", shown(f"SELECT source, time, round(M + 1e-12) AS nearest, floor(M) + 0.5 AS edge1, 2*floor(M/2) + 1 AS edge2, 2*floor(M/2 + 0.5) AS centre2, CAST(floor(M) AS BIGINT) AS whole FROM ({SQL['hourly']})", "source:s time:s nearest:d edge1:d edge2:d centre2:d whole:l"))
def _(spark, sf_dir):
    m = F.col("M")
    return fixtures.hourly(spark, sf_dir).select("source", "time", wind.speed_bin(m, slack=1e-12).alias("nearest"), wind.bin_value(m).alias("edge1"), wind.bin_value(m, 2.0).alias("edge2"), wind.bin_value(m, 2.0, centred=True).alias("centre2"), wind.truncated_speed(m).alias("whole"))


@query("bin_edges", shown(f"SELECT source, unnest(generate_series(0, CAST(floor(max(M)/2) AS BIGINT) + 1))*2.0 AS edge FROM ({SQL['hourly']}) GROUP BY 1", "source:s edge:d"))
def _(spark, sf_dir):
    return fixtures.hourly(spark, sf_dir).groupBy("source").agg(F.max("M").alias("m")).select("source", F.explode(wind.bin_edges(F.col("m"), 2.0)).alias("edge"))


@query("wrap180", shown("SELECT event_id, x - 360*floor((x + 180)/360) AS half_open, CASE WHEN abs(x) > 180 THEN x - 360*sign(x) ELSE x END AS closed FROM (SELECT event_id, CAST(event_id % 721 AS DOUBLE) - 360 AS x FROM events) WHERE abs(x) < 360", "event_id:l half_open:d closed:d"))
def _(spark, sf_dir):
    x = ((F.col("event_id") % 721).cast("double") - 360).alias("x")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", x).where("abs(x) < 360").select("event_id", wind.wrap180(F.col("x")).alias("half_open"), wind.wrap180_closed(F.col("x")).alias("closed"))


def _spline_sql(x: str) -> str:
    """The cubic curve in the form that weighs both ends' second derivatives, from a system solved for the slopes."""
    knots, values = np.asarray(curve.SPEEDS, float), np.asarray(curve.POWERS, float)
    c = curve.spline(knots, values)
    m = np.append(2 * c[:, 1], 2 * c[-1, 1] + 6 * c[-1, 0] * (knots[-1] - knots[-2]))
    rows = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE, {q}::DOUBLE, {u!r}::DOUBLE, {v!r}::DOUBLE)" for a, b, p, q, u, v in zip(knots[:-1].tolist(), knots[1:].tolist(), values[:-1].tolist(), values[1:].tolist(), m[:-1].tolist(), m[1:].tolist(), strict=True))
    inner = "(m0*pow(b - x, 3) + m1*pow(x - a, 3))/(6*(b - a)) + (y0/(b - a) - m0*(b - a)/6)*(b - x) + (y1/(b - a) - m1*(b - a)/6)*(x - a)"
    return f"WITH k(a, b, y0, y1, m0, m1) AS (VALUES {rows}), v AS ({x}) SELECT v.*, CASE WHEN x < 3 OR x > 50 THEN 0 ELSE {inner} END AS power FROM v LEFT JOIN k ON x >= a AND (x < b OR x = 50 AND b = 50)"


@query("power", shown(_spline_sql(f"SELECT source, time, M AS x FROM ({SQL['hourly']})"), "source:s time:s power:d"))
def _(spark, sf_dir):
    h = fixtures.hourly(spark, sf_dir)
    return h.select("source", "time", wind.derive(h, "power").alias("power"))


@query("power_curve_linear", shown(f"SELECT source, time, CASE WHEN M < 2 OR M > 20 THEN -1 WHEN M < 5 THEN 100*(M - 2)/3 WHEN M < 12 THEN 100 + 900*(M - 5)/7 ELSE 1000 END AS power FROM ({SQL['hourly']})", "source:s time:s power:d"))
def _(spark, sf_dir):
    return fixtures.hourly(spark, sf_dir).select("source", "time", curve.power(F.col("M"), [2, 5, 12, 20], [0, 100, 1000, 1000], kind="linear", fill=-1.0).alias("power"))


@query("energy", shown(f"SELECT source, time, power*10/60 AS energy FROM ({_spline_sql('SELECT source, time, M AS x FROM (' + SQL['wind'] + ')')})", "source:s time:s energy:d"))
def _(spark, sf_dir):
    w = fixtures.wind(spark, sf_dir)
    freq = align.deduce_frequency(w.where("source = 'ref'"), 40).first()["freq_min"]
    return w.select("source", "time", wind.derive(w, "energy", freq_min=freq).alias("energy"))


@query("date_parts", shown("SELECT event_id, isodow(ts) - 1 AS weekday, weekofyear(ts) AS week, day(ts) AS day, hour(ts) AS hour, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, month(ts) AS month, year(ts) AS year, dayofyear(ts) AS dayofyear FROM events", "event_id:l weekday:i week:i day:i hour:i date:s month:i year:i dayofyear:i"))
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return dates.date_parts(e, "ts").drop("ts").withColumn("date", F.col("date").cast("string"))


@query("date_names", shown("SELECT o_orderkey, dayname(o_orderdate) AS weekday_name, monthname(o_orderdate) AS month_name, isodow(o_orderdate) - 1 AS weekday, month(o_orderdate) AS month FROM orders", "o_orderkey:l weekday_name:s month_name:s weekday:i month:i"))
def _(spark, sf_dir):
    return dates.date_names(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("fourier", shown("SELECT event_id, sin(2*pi()*x/7) AS x_sin_1, cos(2*pi()*x/7) AS x_cos_1, sin(4*pi()*x/7) AS x_sin_2, cos(4*pi()*x/7) AS x_cos_2 FROM (SELECT event_id, event_id % 7 AS x FROM events)", "event_id:l x_sin_1:d x_cos_1:d x_sin_2:d x_cos_2:d"))
def _(spark, sf_dir):
    return dates.fourier(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 7).alias("x")), "x", 7, 2).drop("x")


@query("bulk_fourier", shown("SELECT event_id, sin(2*pi()*x/7) AS x_sin_1, cos(2*pi()*x/7) AS x_cos_1, sin(2*pi()*y/5) AS y_sin_1, cos(2*pi()*y/5) AS y_cos_1 FROM (SELECT event_id, event_id % 7 AS x, event_id % 5 AS y FROM events)", "event_id:l x_sin_1:d x_cos_1:d y_sin_1:d y_cos_1:d"))
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 7).alias("x"), (F.col("event_id") % 5).alias("y"))
    return dates.bulk_fourier(e, ["x", "y"], [7, 5]).drop("x", "y")


_VARS = ", ".join(f"{f}(2*pi()*{p}(ts)/{m}) AS {p}_{f}_1" for p, m in dates.PERIODS.items() for f in ("sin", "cos"))


@query("date_vars", shown(f"SELECT event_id, {_VARS} FROM events", "event_id:l " + " ".join(f"{p}_{f}_1:d" for p in dates.PERIODS for f in ("sin", "cos"))))
def _(spark, sf_dir):
    return dates.date_vars(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), "ts").drop("ts")


@query("get_dataset", shown(UV.format(SQL["hourly"]), f"{SERIES} U:d V:d"))
def _(spark, sf_dir):
    return score.with_variables(fixtures.hourly(spark, sf_dir), ("M", "Dir", "U", "V", "nothing"))


# --- reshaping


@query("select_uv", shown(f"SELECT * EXCLUDE (M, Dir) FROM ({SQL['wide']})", "time:s U_10.00:d U_50.00:d U_100.00:d V_10.00:d V_50.00:d V_100.00:d"))
def _(spark, sf_dir):
    return reshape.select_uv(reshape.drop_targets(fixtures.wide(spark, sf_dir)))


_LONG = " UNION ALL ".join(f'SELECT sample, time, CAST({h} AS DOUBLE) AS lev, "U_{h}.00" AS U, "V_{h}.00" AS V FROM w' for h in (10, 50, 100))


@query("wide_to_long", shown(f"WITH w AS ({SQL['wide']}) {_LONG}", "sample:l time:s lev:d U:d V:d"))
def _(spark, sf_dir):
    return reshape.wide_to_long(reshape.drop_targets(fixtures.wide(spark, sf_dir)), ("sample", "time"))


@query("long_to_wide", shown(f"WITH w AS ({SQL['wide']}) SELECT sample, time, \"U_10.00\" AS \"U_10.0\", \"U_100.00\" AS \"U_100.0\", \"V_10.00\" AS \"V_10.0\", \"V_100.00\" AS \"V_100.0\" FROM w", "sample:l time:s U_10.0:d U_100.0:d V_10.0:d V_100.0:d"))
def _(spark, sf_dir):
    long = reshape.wide_to_long(fixtures.wide(spark, sf_dir).drop("M", "Dir"), ("sample", "time"))
    return reshape.long_to_wide(long, [10.0, 100.0], ["U", "V"], ("sample", "time"))


def _at70(v: str) -> str:
    a, b, c = (f'"{v}_{h}.00"' for h in (10, 50, 100))
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {b} IS NULL THEN {a} + ({c} - {a})*60/90 ELSE {b} + ({c} - {b})*20/50 END"


@query("level_interp", shown(f'SELECT sample, {_at70("U")} AS "U_70.0", {_at70("V")} AS "V_70.0" FROM ({SQL["wide"]})', "sample:l U_70.0:d V_70.0:d"))
def _(spark, sf_dir):
    return reshape.level_interp(fixtures.wide(spark, sf_dir)).select("sample", "`U_70.0`", "`V_70.0`")


@query("dataset_build", shown(f'SELECT time, "U_10.00" AS "U_10.0", "V_100.00" AS "V_100.0", "U_70.0", "V_70.0", sqrt("U_70.0"*"U_70.0" + "V_70.0"*"V_70.0") AS "M_70.0", degrees(atan2("U_70.0", "V_70.0")) + 180 AS "Dir_70.0" FROM (SELECT *, {_at70("U")} AS "U_70.0", {_at70("V")} AS "V_70.0" FROM ({SQL["wide"]}))', "time:s U_10.0:d V_100.0:d U_70.0:d V_70.0:d M_70.0:d Dir_70.0:d"))
def _(spark, sf_dir):
    return sources.dataset_build(fixtures.wide(spark, sf_dir)).select("time", *(f"`{c}`" for c in ("U_10.0", "V_100.0", "U_70.0", "V_70.0", "M_70.0", "Dir_70.0")))


@query("dataset_targets", shown(f"SELECT time, M, Dir, 70.0 AS lev FROM ({SQL['wide']})", "time:s M:d Dir:d lev:d"))
def _(spark, sf_dir):
    return sources.dataset_build(fixtures.wide(spark, sf_dir), targets=True)


@query("downcast32", shown("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS FLOAT) AS o_totalprice FROM orders", "o_orderkey:i o_custkey:i o_totalprice:d"))
def _(spark, sf_dir):
    return reshape.downcast32(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("low_std_columns", shown("SELECT * FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS \"column\", unnest([stddev_samp(l_quantity), stddev_samp(l_discount), stddev_samp(l_tax), stddev_samp(l_linenumber)]) AS std FROM lineitem) WHERE std <= 1", "column:s std:d"))
def _(spark, sf_dir):
    return reshape.low_std_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_linenumber"))


@query("lag_lead", shown(f"SELECT *, lead(M) OVER w AS M_lag1, lag(M) OVER w AS M_lead1 FROM ({SQL['hourly']}) WINDOW w AS (PARTITION BY source ORDER BY time)", f"{SERIES} M_lag1:d M_lead1:d"))
def _(spark, sf_dir):
    return reshape.lag_and_lead(fixtures.hourly(spark, sf_dir), ["M"])


@query("mask_where", shown(f"SELECT source, time, CASE WHEN M > 5 THEN M ELSE 0 END AS M, Dir FROM ({SQL['hourly']})", SERIES))
def _(spark, sf_dir):
    return reshape.mask_where(fixtures.hourly(spark, sf_dir), "M", F.col("M") > 5, 0.0)


@query("replace_inf", shown(f"SELECT source, time, CASE WHEN Dir > 180 THEN M END AS M, Dir FROM ({SQL['hourly']})", SERIES))
def _(spark, sf_dir):
    h = fixtures.hourly(spark, sf_dir)
    return reshape.replace_inf(h.withColumn("M", F.when(F.col("Dir") > 180, F.col("M")).otherwise(float("-inf"))))


@query("fillna_mean", shown(f"SELECT source, time, coalesce(M, avg(M) OVER (PARTITION BY source)) AS M, coalesce(Dir, -1) AS Dir FROM ({GAPS.format(SQL['daily'])})", SERIES))
def _(spark, sf_dir):
    return reshape.fillna_scalar_or_mean(reshape.fillna_scalar_or_mean(gaps(fixtures.daily(spark, sf_dir)), "M", "mean"), "Dir", -1)


@query("rename_vars", shown(f"SELECT source, time, M AS \"M-x\", Dir AS \"Dir-x\" FROM ({SQL['hourly']})", "source:s time:s M-x:d Dir-x:d"))
def _(spark, sf_dir):
    return reshape.rename_vars(fixtures.hourly(spark, sf_dir), suffix="-x")


@query("prepare_submission", shown(f"SELECT row_number() OVER (ORDER BY time) - 1 AS sample, time, M, CASE WHEN Dir = 0 THEN 360 ELSE Dir END AS Dir FROM ({SQL['wind']}) WHERE source = 'new'", "sample:l time:s M:d Dir:d"))
def _(spark, sf_dir):
    w = fixtures.wind(spark, sf_dir).where("source = 'new'")
    return sources.prepare_submission(w.select("time", wind.derive(w, "U").alias("U"), wind.derive(w, "V").alias("V"))).withColumn("Dir", F.when(F.round("Dir", 6) == 0, 360.0).otherwise(F.col("Dir")))


@query("apply_general", shown(f"SELECT source, time, sqrt(M) AS M, Dir FROM ({SQL['hourly']})", SERIES))
def _(spark, sf_dir):
    return reshape.apply_general(fixtures.hourly(spark, sf_dir), F.sqrt, ["M"])


@query("join_features", shown(f"SELECT a.time, a.M AS x, b.M AS y FROM (SELECT * FROM ({SQL['daily']}) WHERE source = '1-URGENT') a LEFT JOIN (SELECT * FROM ({SQL['daily']}) WHERE source = '5-LOW' AND M > 5) b ON a.time = b.time", "time:s x:d y:d"))
def _(spark, sf_dir):
    d = fixtures.daily(spark, sf_dir)
    return reshape.join_features(d.where("source = '1-URGENT'").select("time", F.col("M").alias("x")), d.where("source = '5-LOW' and M > 5").select("time", F.col("M").alias("y")))


# --- resampling


def _resample_sql(series: str, unit: str, least: int) -> str:
    return f"SELECT source, date_trunc('{unit}', time) AS time, CASE WHEN count(*) >= {least} THEN avg(M) END AS M, CASE WHEN count(*) >= {least} THEN avg(Dir) END AS Dir FROM ({SQL[series]}) GROUP BY 1, 2"


for _series, _period, _rate in (("wind", "hourly", 6), ("hourly", "daily", 1), ("daily", "monthly", None), ("daily", "yearly", None)):
    QUERIES[f"resample_{_period}"] = lambda spark, sf_dir, s=_series, p=_period, r=_rate: rounded(resample.resample(getattr(fixtures, s)(spark, sf_dir), resample.UNITS[p], ["M", "Dir"], least=resample.min_values_period(p, r)))
    ORACLES[f"resample_{_period}"] = shown(_resample_sql(_series, resample.UNITS[_period], {("hourly", 6): 4, ("daily", 1): 21}.get((_period, _rate), 0)), SERIES)

_PERIOD = """r AS (SELECT source, var, date_trunc('{unit}', time) AS time, CASE WHEN count(*) >= {least} THEN avg(ref) END AS ref, CASE WHEN count(*) >= {least} THEN avg(new) END AS new
  FROM (SELECT source, var, time, ref, CASE WHEN var = 'Dir' THEN ref + {e} ELSE new END AS new FROM p) GROUP BY 1, 2, 3),
  a AS (SELECT source, var, count(new) AS n, corr(new, ref) AS c, sqrt(avg((new - ref)*(new - ref))) AS rmse, avg(abs(new - ref)) AS mae,
    list_avg(list_transform(list_zip(list_sort(list(ref) FILTER (ref IS NOT NULL)), list_sort(list(new) FILTER (new IS NOT NULL))), lambda x: abs(x[1] - x[2]))) AS emd FROM r GROUP BY 1, 2)
  SELECT * FROM (SELECT source, var, unnest(['length_{p}', 'r2_{p}', 'rmse_{p}', 'MAE_{p}', 'EMD_{p}']) AS metric, unnest([CAST(n AS DOUBLE), CASE WHEN n > 2 THEN c*c END, rmse, mae, CASE WHEN n > 5 THEN emd END]) AS value FROM a) WHERE value IS NOT NULL"""


def _period_sql(series: str, period: str, least: int) -> str:
    return f"{pairs_sql(SQL[series], REF[series])}, {_PERIOD.format(unit=resample.UNITS[period], least=least, p=period, e=f'({E})')}"


for _series, _period, _rate, _least in (("wind", "hourly", 6, 4), ("wind", "daily", 6, 129), ("wind", "monthly", 6, 3758), ("daily", "yearly", None, 0)):
    QUERIES[f"stats_{_period}"] = lambda spark, sf_dir, s=_series, p=_period, r=_rate: rounded(resample.stats_in_resampling(align.pairs(getattr(fixtures, s)(spark, sf_dir), REF[s]), p, r))
    ORACLES[f"stats_{_period}"] = shown(_period_sql(_series, _period, _least), LONG)


# --- distributions


@query("emd", shown(f"""WITH s AS ({SQL['daily']}), k AS (SELECT * FROM s WHERE source = '1-URGENT' OR M > 4), u AS (SELECT b.source, a.M AS v, 1 AS r, 0 AS n FROM k a CROSS JOIN (SELECT DISTINCT source FROM k WHERE source <> '1-URGENT') b WHERE a.source = '1-URGENT' UNION ALL SELECT source, M, 0, 1 FROM k WHERE source <> '1-URGENT'),
  c AS (SELECT source, v, sum(r) OVER w / sum(r) OVER (PARTITION BY source) AS f, sum(n) OVER w / sum(n) OVER (PARTITION BY source) AS g, lead(v) OVER (PARTITION BY source ORDER BY v) AS after FROM u WINDOW w AS (PARTITION BY source ORDER BY v))
  SELECT source, sum(abs(f - g)*(after - v)) AS emd FROM c GROUP BY 1""", "source:s emd:d"))
def _(spark, sf_dir):
    s = fixtures.daily(spark, sf_dir).where("source = '1-URGENT' or M > 4")
    others = s.where("source <> '1-URGENT'").select("source").distinct()
    left = s.where("source = '1-URGENT'").select("M").crossJoin(F.broadcast(others)).select("source", F.col("M").alias("ref"), F.lit(None).cast("double").alias("new"))
    return stats.emd(left.unionByName(s.where("source <> '1-URGENT'").select("source", F.lit(None).cast("double").alias("ref"), F.col("M").alias("new"))), ["source"])


_DIST = "c AS (SELECT source, CAST(floor(M) AS BIGINT) AS b, CAST(floor((Dir + 11.25)/22.5) AS INTEGER) % 16 AS k, count(*) AS n FROM s GROUP BY 1, 2, 3), top AS (SELECT source, max(CAST(floor(M) AS BIGINT)) AS bins FROM s GROUP BY 1), g AS (SELECT source, unnest(range(bins)) AS b, k FROM top CROSS JOIN (SELECT unnest(range(16)) AS k)), d AS (SELECT g.source, g.b + 0.5 AS speed, g.k*22.5 AS direction, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.source = c.source AND g.b = c.b AND g.k = c.k)"


@query("distribution", shown(f"WITH s AS ({SQL['wind']}), {_DIST} SELECT * FROM d", "source:s speed:d direction:d n:i"))
def _(spark, sf_dir):
    return histogram.distribution(fixtures.wind(spark, sf_dir))


_POP = "mx AS (SELECT max(speed) AS top FROM d), f AS (SELECT x.source, b + 0.5 AS speed, direction FROM (SELECT DISTINCT source, direction FROM d) x CROSS JOIN (SELECT unnest(range(CAST(floor(top) AS BIGINT) + 1)) AS b FROM mx)), pop AS (SELECT f.source, f.speed, f.direction, CASE WHEN n > 15 THEN 100.0*n ELSE 0 END / sum(n) OVER (PARTITION BY f.source) AS population FROM f LEFT JOIN d ON f.source = d.source AND f.speed = d.speed AND f.direction = d.direction)"


@query("bin_population", shown(f"WITH s AS ({SQL['wind']}), {_DIST}, {_POP} SELECT * FROM pop", "source:s speed:d direction:d population:d"))
def _(spark, sf_dir):
    return histogram.bin_population(histogram.distribution(fixtures.wind(spark, sf_dir)))


@query("compare_tabfiles", shown(stats_sql(f"WITH s AS ({SQL['wind']}), {_DIST}, {_POP}, p AS (SELECT b.source, 'TAB_pop' AS var, a.population AS ref, b.population AS new FROM pop a JOIN pop b ON a.speed = b.speed AND a.direction = b.direction WHERE a.source = 'ref' AND b.source <> 'ref')"), LONG))
def _(spark, sf_dir):
    return histogram.compare_tabfiles(fixtures.wind(spark, sf_dir), "ref")


@query("apply_by_sectors", shown(f"SELECT source, CAST(floor((Dir + 11.25)/22.5) AS INTEGER) % 16 * 22.5 AS sector, avg(M) AS M, count(*) AS n FROM ({SQL['wind']}) GROUP BY 1, 2", "source:s sector:d M:d n:l"))
def _(spark, sf_dir):
    return weibull.apply_by_sectors(fixtures.wind(spark, sf_dir), {"M": F.avg("M"), "n": F.count(F.lit(1))})


# --- cycles


def _cycle_sql(series: str, expr: str = "avg(M)", least: str = "count(M) > 20*6") -> str:
    return f"SELECT source, month(time) AS month, hour(time) AS hour, CASE WHEN {least} THEN {expr} END AS M, CASE WHEN {least} THEN avg(Dir) END AS Dir, count(M) AS count FROM ({SQL[series]}) GROUP BY 1, 2, 3"


@query("seasonal_daily_cycle", shown(_cycle_sql("wind"), "source:s month:i hour:i M:d Dir:d count:l"))
def _(spark, sf_dir):
    return cycles.seasonal_daily_cycle(fixtures.wind(spark, sf_dir))


for _stat, _expr in (("median", "median(M)"), ("max", "max(M)"), ("std", "stddev_samp(M)"), ("q0.9", "quantile_cont(M, 0.9)")):
    QUERIES[f"cycle_{_stat}"] = lambda spark, sf_dir, s=_stat: rounded(cycles.seasonal_daily_cycle(fixtures.wind(spark, sf_dir), ["M"], stat=s))
    ORACLES[f"cycle_{_stat}"] = shown(_cycle_sql("wind", _expr), "source:s month:i hour:i M:d count:l")


@query("cycle_normalized", shown(f"SELECT *, 100*(M/avg(M) OVER (PARTITION BY source) - 1) AS x FROM ({_cycle_sql('wind')})".replace("SELECT *,", "SELECT source, month, hour, count,"), "source:s month:i hour:i x:d count:l"))
def _(spark, sf_dir):
    return cycles.seasonal_daily_cycle(fixtures.wind(spark, sf_dir), normalized=True).withColumnRenamed("M", "x")


def _cycle_pairs_sql() -> str:
    cells = f"WITH c0 AS ({_cycle_sql('wind')})"
    parts, ctes = [], []
    for norm in ("", "_norm"):
        table = "c0" if not norm else "c1"
        if norm:
            ctes.append("c1 AS (SELECT source, month, hour, 100*(M/avg(M) OVER (PARTITION BY source) - 1) AS M FROM c0)")
        for kind, by in (("_mthhr", "month, hour"), ("_mth", "month"), ("_hr", "hour")):
            name = f"g{norm}{kind}"
            ctes.append(f"{name} AS (SELECT source, {by}, avg(M) AS M FROM {table} GROUP BY source, {by})")
            parts.append(f"SELECT n.source, 'M{norm}{kind}' AS var, r.M AS ref, n.M AS new FROM {name} n JOIN {name} r USING ({by}) WHERE r.source = 'ref' AND n.source <> 'ref' AND r.M IS NOT NULL AND n.M IS NOT NULL")
    return f"{cells}, {', '.join(ctes)}, p AS ({' UNION ALL '.join(parts)})"


# the means of normalized cells are zero but for rounding, so their ratio says nothing
@query("compare_cycle", shown(stats_sql(_cycle_pairs_sql(), tail="SELECT * FROM m WHERE value IS NOT NULL AND NOT (metric = 'factor' AND var LIKE '%norm%')"), LONG))
def _(spark, sf_dir):
    return cycles.compare_seasonal_daily_cycle(fixtures.wind(spark, sf_dir), "ref", ["M"]).where("not (metric = 'factor' and var like '%norm%')")


# --- Weibull

FIT = "source:s mean:d variance:d k:d A:d count:l"
_PARAMS = "f AS (SELECT source, avg(M) AS mean, var_pop(M) AS variance, pow(stddev_pop(M)/avg(M), -1.086) AS k, count(M) AS count FROM s GROUP BY 1), fit AS (SELECT source, mean, variance, k, mean/gamma(1 + 1/k) AS A, count FROM f)"


@query("weibull_params_method", shown(f"WITH s AS ({SQL['hourly']}), {_PARAMS} SELECT * FROM fit", FIT))
def _(spark, sf_dir):
    return weibull.weibull_fit(fixtures.hourly(spark, sf_dir), ["source"], method="params")


def _bisect_sql(source: str, bins: str) -> str:
    """The likelihood's root by Newton's rule, twelve steps from the moments' estimate; keys are source."""
    slope = "(SELECT struct_pack(g := sum(n*pow(b, it.k)*ln(b))/sum(n*pow(b, it.k)) - 1/it.k - sum(n*ln(b))/sum(n), h := sum(n*pow(b, it.k)*ln(b)*ln(b))/sum(n*pow(b, it.k)) - pow(sum(n*pow(b, it.k)*ln(b))/sum(n*pow(b, it.k)), 2) + 1/(it.k*it.k)) FROM h WHERE h.source = it.source)"
    return f"""WITH RECURSIVE s AS ({source}), h AS (SELECT source, {bins} AS b, count(*) AS n FROM s WHERE M > 0 GROUP BY 1, 2),
      m AS (SELECT source, sum(n*b)/sum(n) AS mean, sum(n*b*b)/sum(n) - pow(sum(n*b)/sum(n), 2) AS variance, CAST(sum(n) AS BIGINT) AS count FROM h GROUP BY 1),
      it(source, k, step) AS (SELECT source, pow(sqrt(variance)/mean, -1.086), 0 FROM m UNION ALL SELECT source, k - d.g/d.h, step + 1 FROM (SELECT it.source, it.k, it.step, {slope} AS d FROM it WHERE step < 12)),
      fit AS (SELECT m.source, mean, variance, k, pow((SELECT sum(n*pow(b, it.k))/sum(n) FROM h WHERE h.source = it.source), 1/k) AS A, count FROM m JOIN it ON m.source = it.source WHERE step = 12)"""


@query("weibull_histogram", shown(_bisect_sql(SQL["wind"], "floor(M) + 0.5") + " SELECT * FROM fit", FIT))
def _(spark, sf_dir):
    return weibull.weibull_fit(fixtures.wind(spark, sf_dir).where("M > 0"), ["source"])


@query("weibull_values", shown(_bisect_sql(f"SELECT source, round(M, 2) AS M FROM ({SQL['wind']})", "M") + " SELECT * FROM fit", "source:s k:d A:d"))
def _(spark, sf_dir):
    return weibull.weibull_fit(fixtures.wind(spark, sf_dir).withColumn("M", F.round("M", 2)).where("M > 0"), ["source"], method="values").select("source", "k", "A")


@query("weibull_sectors", shown(_bisect_sql(f"SELECT concat(source, CAST(floor((Dir + 11.25)/22.5) AS INTEGER) % 16) AS source, M FROM ({SQL['wind']})", "floor(M) + 0.5") + " SELECT * FROM fit", FIT))
def _(spark, sf_dir):
    fits = weibull.weibull_ds(fixtures.wind(spark, sf_dir).where("M > 0"), sectors=16).where("sector is not null")
    return fits.withColumn("source", F.concat("source", (F.col("sector") / 22.5).cast("int").cast("string"))).drop("sector")


@query("weibull_quality", shown(f"""WITH s AS ({SQL['wind']}), {_PARAMS}, c AS (SELECT source, floor(M/0.2) AS j, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT source, count(*) AS total, avg(M) AS xbar, CAST(floor(max(M)/0.2) AS BIGINT) AS last FROM s GROUP BY 1),
  g AS (SELECT *, unnest(range(last + 1)) AS j FROM t), d AS (SELECT g.source, (g.j + 0.5)*0.2 AS b, coalesce(n, 0)/(total*0.2) AS ref, xbar, k, A FROM g LEFT JOIN c ON g.source = c.source AND g.j = c.j JOIN fit ON g.source = fit.source),
  x AS (SELECT *, k/A*pow(b/A, k - 1)*exp(-pow(b/A, k)) AS new FROM d)
  SELECT source, sum(b*new)/sum(new) - any_value(xbar) AS fit_mbias, sqrt(avg((new - ref)*(new - ref))) AS fit_rmse, sqrt(avg(abs(new - ref))) AS fit_MAE, list_avg(list_transform(list_zip(list_sort(list(ref)), list_sort(list(new))), lambda y: abs(y[1] - y[2]))) AS fit_emd, pow(corr(ref, new), 2) AS fit_r2 FROM x GROUP BY 1""", "source:s fit_mbias:d fit_rmse:d fit_MAE:d fit_emd:d fit_r2:d"))
def _(spark, sf_dir):
    w = fixtures.wind(spark, sf_dir)
    return weibull.weibull_quality(w, weibull.weibull_fit(w, ["source"], method="params"), ["source"])


@query("compare_weibulls", shown(f"WITH s AS ({SQL['hourly']}), {_PARAMS}, x AS (SELECT n.source, unnest(['A', 'k']) AS var, unnest([r.A, r.k]) AS ref, unnest([n.A, n.k]) AS new FROM fit n JOIN fit r ON r.source = 'view' WHERE n.source <> 'view') SELECT source, var, unnest(['mean', 'bias', 'factor']) AS metric, unnest([new, new - ref, ref/new]) AS value FROM x", LONG))
def _(spark, sf_dir):
    return weibull.compare_weibulls(fixtures.hourly(spark, sf_dir), "view", method="params")


# --- ramps and noise


def _ramp_sql(series: str) -> str:
    return f"WITH s AS ({SQL[series]}), {FREQ}, rr AS (SELECT a.source, a.time, a.M - b.M AS \"M-ramp\", CASE WHEN abs(a.Dir - b.Dir) > 180 THEN a.Dir - b.Dir - 360*sign(a.Dir - b.Dir) ELSE a.Dir - b.Dir END AS \"Dir-ramp\" FROM s a JOIN f ON a.source = f.source JOIN s b ON a.source = b.source AND b.time = a.time - to_minutes(freq_min))"


@query("ramps", shown(f"{_ramp_sql('hourly')} SELECT * FROM rr", "source:s time:s M-ramp:d Dir-ramp:d"))
def _(spark, sf_dir):
    return ramps.ramps(fixtures.hourly(spark, sf_dir))


def _noise_sql(series: str) -> str:
    return f"""WITH s AS ({SQL[series]}), {FREQ}, {GRID}, n1 AS (SELECT *, CASE WHEN count(M) OVER w >= 2 THEN abs(M - avg(M) OVER w) END AS raw FROM r WINDOW w AS (PARTITION BY source ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
      n2 AS (SELECT source, time, CASE WHEN count(raw) OVER w >= 6 THEN avg(raw) OVER w END AS "M-noise" FROM n1 WINDOW w AS (PARTITION BY source ORDER BY time ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))"""


@query("noise", shown(f"{_noise_sql('hourly')} SELECT * FROM n2", "source:s time:s M-noise:d"))
def _(spark, sf_dir):
    return ramps.noise(fixtures.hourly(spark, sf_dir), ["M"], chunk=64)


@query("compare_ramps", shown(stats_sql(f"{_ramp_sql('wind')}, p AS (SELECT n.source, 'M-ramp' AS var, a.\"M-ramp\" AS ref, n.\"M-ramp\" AS new FROM rr n JOIN rr a ON n.time = a.time WHERE a.source = 'ref' AND n.source <> 'ref')"), LONG))
def _(spark, sf_dir):
    return ramps.compare_ramps(fixtures.wind(spark, sf_dir), "ref", ["M"])


@query("compare_noise", shown(stats_sql(f"{_noise_sql('wind')}, p AS (SELECT n.source, 'M-noise' AS var, a.\"M-noise\" AS ref, n.\"M-noise\" AS new FROM n2 n JOIN n2 a ON n.time = a.time WHERE a.source = 'ref' AND n.source <> 'ref' AND a.\"M-noise\" IS NOT NULL AND n.\"M-noise\" IS NOT NULL)"), LONG))
def _(spark, sf_dir):
    return ramps.compare_noise(fixtures.wind(spark, sf_dir), "ref", ["M"])


# --- quality


def _deduced_sql(stats_from: str) -> str:
    """Deduced metrics of the CTE st (source, var, metric, value)."""
    names = sorted({"mean", "bias", "std", "std_bias", "rmse", "sum", *score.OF_MEAN, *score.OF_SUM, *(u for u in score.UNSIGNED if "(" not in u and "cv" not in u and "iqr" not in u and "range" not in u), *(f"q{q}" for q in stats.QUANTILES)})
    wide = ", ".join(f"max(value) FILTER (metric = '{n}') AS \"{n}\"" for n in names)
    c = {f"{v} (%)": f"100*\"{v}\"/nullif(\"mean\" - \"bias\", 0)" for v in score.OF_MEAN} | {f"{v} (%)": f"100*\"{v}\"/nullif(\"sum\", 0)" for v in score.OF_SUM}
    c |= {"cv": '"std"/nullif("mean" - "bias", 0)', "cv_bias": '"std_bias"/nullif("mean" - "bias", 0)', "iqr": '"q0.75" - "q0.25"', "bias_iqr": '"bias_q0.75" - "bias_q0.25"', "range": '"q0.98" - "q0.02"', "bias_range": '"bias_q0.98" - "bias_q0.02"'}
    c |= {"rmse_norm_mean": '"rmse"/nullif("mean" - "bias", 0)', "rmse_norm_range": f'"rmse"/nullif({c["range"]}, 0)', "rmse_norm_iqr": f'"rmse"/nullif({c["iqr"]}, 0)'}
    c |= {f"absolute {v}": f"abs({c.get(v, chr(34) + v + chr(34))})" for v in score.UNSIGNED}
    names_sql, values = ", ".join(f"'{k}'" for k in c), ", ".join(c.values())
    return f"{stats_from}, wd AS (SELECT source, var, {wide} FROM st GROUP BY 1, 2), dd AS (SELECT source, var, metric, value FROM st UNION ALL SELECT * FROM (SELECT source, var, unnest([{names_sql}]) AS metric, unnest([{values}]) AS value FROM wd) WHERE value IS NOT NULL)"


_ST = stats_sql(pairs_sql(SQL["wind"], "ref"), tail=", st AS (SELECT * FROM m WHERE value IS NOT NULL)")
_RULES = ", ".join(f"('{v}', '{m}', {float(p)}::DOUBLE, {float(g)}::DOUBLE, {float(w)}::DOUBLE)" for v, m, p, g, w in score.RULES)


@query("quality_rules", shown(f"SELECT * FROM (VALUES {_RULES}) AS x(var, metric, perfect, good, weight)", "var:s metric:s perfect:d good:d weight:d"))
def _(spark, sf_dir):
    return score.rules(spark)


@query("deduced_stats", shown(f"{_deduced_sql(_ST)} SELECT * FROM dd", LONG))
def _(spark, sf_dir):
    return score.deduced_stats(stats.compare_stats(align.pairs(fixtures.wind(spark, sf_dir), "ref")))


_QUALITY = f"{_deduced_sql(_ST)}, rl(var, metric, perfect, good, weight) AS (VALUES {_RULES}), q AS (SELECT s.source, rl.*, value, 10/(perfect - good)*(value - good) AS quality_index, 10/(perfect - good)*(value - good)*weight AS quality_weighted FROM rl CROSS JOIN (SELECT DISTINCT source FROM st) s LEFT JOIN dd ON dd.source = s.source AND dd.var = rl.var AND dd.metric = rl.metric)"


@query("compute_quality", shown(f"{_QUALITY} SELECT * FROM q", "source:s var:s metric:s perfect:d good:d weight:d value:d quality_index:d quality_weighted:d"))
def _(spark, sf_dir):
    return score.compute_quality(score.deduced_stats(stats.compare_stats(align.pairs(fixtures.wind(spark, sf_dir), "ref"))))


@query("total_quality", shown(f"{_QUALITY} SELECT source, sum(quality_weighted)/sum(weight) FILTER (quality_index IS NOT NULL) AS quality, count(quality_index) AS rules_used, count(*) - count(quality_index) AS rules_missing FROM q GROUP BY 1", "source:s quality:d rules_used:l rules_missing:l"))
def _(spark, sf_dir):
    return score.total_quality(score.compute_quality(score.deduced_stats(stats.compare_stats(align.pairs(fixtures.wind(spark, sf_dir), "ref")))))


@query("all_sources_stats", shown(stats_sql(pairs_sql(f"WITH s0 AS ({SQL['hourly']}), t0 AS (SELECT time FROM s0 GROUP BY time HAVING count(*) = (SELECT count(DISTINCT source) FROM s0)) SELECT source, time, M, Dir, -M*sin(radians(Dir)) AS U, -M*cos(radians(Dir)) AS V FROM s0 JOIN t0 USING (time)", "view", ("M", "Dir", "U", "V"))), LONG))
def _(spark, sf_dir):
    return score.all_sources_stats(fixtures.hourly(spark, sf_dir), "view", ("M", "Dir", "U", "V"), periods=())


ENERGY = "SELECT source, time, M AS energy FROM ({})"
_SUMS = "SELECT source, var, unnest(['sum', 'bias_sum', 'SAE']) AS metric, unnest([sum(new), sum(new) - sum(ref), sum(abs(new - ref))]) AS value FROM p GROUP BY 1, 2"


@query("compare_cumulative", shown(stats_sql(pairs_sql(ENERGY.format(SQL["daily"]), "1-URGENT", ("energy",)), tail=f"SELECT * FROM m WHERE value IS NOT NULL UNION ALL {_SUMS}"), LONG))
def _(spark, sf_dir):
    return stats.compare_stats(align.pairs(fixtures.daily(spark, sf_dir).select("source", "time", F.col("M").alias("energy")), "1-URGENT"))


@query("stats_cumulative_monthly", shown(f"""{pairs_sql(ENERGY.format(SQL['daily']), '1-URGENT', ('energy',))}, r AS (SELECT source, var, date_trunc('month', time) AS time, sum(ref) AS ref, sum(new) AS new FROM p GROUP BY 1, 2, 3),
  a AS (SELECT source, var, count(*) AS n, corr(new, ref) AS c, sqrt(avg((new - ref)*(new - ref))) AS rmse, avg(abs(new - ref)) AS mae, sum(abs(new - ref)) AS sae, list_avg(list_transform(list_zip(list_sort(list(ref)), list_sort(list(new))), lambda x: abs(x[1] - x[2]))) AS emd FROM r GROUP BY 1, 2)
  SELECT source, var, unnest(['length_monthly', 'r2_monthly', 'rmse_monthly', 'MAE_monthly', 'SAE_monthly', 'EMD_monthly']) AS metric, unnest([CAST(n AS DOUBLE), c*c, rmse, mae, sae, emd]) AS value FROM a""", LONG))
def _(spark, sf_dir):
    return resample.stats_in_resampling(align.pairs(fixtures.daily(spark, sf_dir).select("source", "time", F.col("M").alias("energy")), "1-URGENT"), "monthly", None)


@query("compare_distribution_only", shown(stats_sql(pairs_sql(GAPS.format(SQL["daily"]), "1-URGENT"), emd=False, tail="SELECT * FROM m WHERE value IS NOT NULL AND metric NOT IN ('MAE', 'rmse', 'r2', 'lfit_slope', 'lfit_intercept') AND metric NOT LIKE 'td_%' UNION ALL SELECT source, var, 'bias_length', CAST(count(new) - count(ref) AS DOUBLE) FROM p GROUP BY 1, 2"), LONG))
def _(spark, sf_dir):
    return stats.compare_stats(align.pairs(gaps(fixtures.daily(spark, sf_dir)), "1-URGENT"), distribution_only=True, distance=False)


def _sector_frame(frame):
    import pandas as pd

    first = frame.iloc[0]
    return pd.DataFrame({"source": [first["source"]], "sector": [first["sector"]], "M": [frame["M"].mean()], "n": [len(frame)]})


@query("apply_by_sectors_function", ORACLES["apply_by_sectors"])
def _(spark, sf_dir):
    return weibull.apply_by_sectors(fixtures.wind(spark, sf_dir), _sector_frame, schema="source string, sector double, M double, n long")


def _span(frame):
    import pandas as pd

    return pd.DataFrame({"source": [frame["source"].iloc[0]], "span": [frame["M"].max() - frame["M"].min()]})


@query("apply_groups", shown(f"SELECT source, max(M) - min(M) AS span FROM ({SQL['hourly']}) GROUP BY 1", "source:s span:d"))
def _(spark, sf_dir):
    return weibull.apply_groups(fixtures.hourly(spark, sf_dir), _span, "source string, span double", ["source"])


@query("resample_function", shown(f"SELECT source, date_trunc('day', time) AS time, CASE WHEN count(*) >= 21 THEN max(M) END AS M FROM ({SQL['hourly']}) GROUP BY 1, 2", "source:s time:s M:d"))
def _(spark, sf_dir):
    return resample.resample(fixtures.hourly(spark, sf_dir), "day", ["M"], least=21, function=F.max)


def _score_sql() -> str:
    """Every part of the score by its own SQL, over one written series: variables, histogram, fits by sector, cycles, ramps, noise and periods; then what is deduced, and the rules."""
    parts = ("M", "Dir", "power", "U", "V")
    spline = _spline_sql("SELECT source, time, M, Dir, M AS x FROM wnd")
    main = f"vars AS MATERIALIZED (SELECT source, time, M, Dir, power, -M*sin(radians(Dir)) AS U, -M*cos(radians(Dir)) AS V FROM ({spline})), pm AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT n.source, '{v}' AS var, n.time, r.{v} AS ref, n.{v} AS new FROM vars n JOIN vars r ON n.time = r.time WHERE r.source = 'ref' AND n.source <> 'ref'" for v in parts) + ")"
    tab = f"WITH s AS (SELECT * FROM wnd), {_DIST}, {_POP} SELECT b.source, 'TAB_pop' AS var, a.population AS ref, b.population AS new FROM pop a JOIN pop b ON a.speed = b.speed AND a.direction = b.direction WHERE a.source = 'ref' AND b.source <> 'ref'"
    ramp = f"{_ramp_sql('wind')} SELECT n.source, 'M-ramp' AS var, a.\"M-ramp\" AS ref, n.\"M-ramp\" AS new FROM rr n JOIN rr a ON n.time = a.time WHERE a.source = 'ref' AND n.source <> 'ref'"
    calm = f"{_noise_sql('wind')} SELECT n.source, 'M-noise' AS var, a.\"M-noise\" AS ref, n.\"M-noise\" AS new FROM n2 n JOIN n2 a ON n.time = a.time WHERE a.source = 'ref' AND n.source <> 'ref' AND a.\"M-noise\" IS NOT NULL AND n.\"M-noise\" IS NOT NULL"
    cycle = f"{_cycle_pairs_sql()} SELECT * FROM p"
    by_sector = "SELECT concat(source, '|', CAST(floor((Dir + 11.25)/22.5) AS INTEGER) % 16) AS source, M FROM wnd"
    fits = f"whole AS MATERIALIZED ({_bisect_sql('SELECT source, M FROM wnd', 'floor(M) + 0.5')} SELECT * FROM fit), sect AS MATERIALIZED (SELECT split_part(source, '|', 1) AS source, split_part(source, '|', 2) AS k16, k, A, count FROM ({_bisect_sql(by_sector, 'floor(M) + 0.5')} SELECT * FROM fit) WHERE count >= 10)"
    pairs = "sp AS (SELECT n.source, unnest(['A_sector', 'k_sector']) AS var, unnest([r.A, r.k]) AS ref, unnest([n.A, n.k]) AS new, n.count AS w FROM sect n JOIN sect r ON n.k16 = r.k16 WHERE r.source = 'ref' AND n.source <> 'ref')"
    every = " UNION ALL ".join(["SELECT source, var, ref, new FROM pm", "SELECT source, var, ref, new FROM sp", *(f"SELECT source, var, ref, new FROM ({x})" for x in (tab, ramp, calm, cycle))]).replace(SQL["wind"], "SELECT * FROM wnd")
    periods = [f"SELECT * FROM (WITH p AS (SELECT * FROM pm), {_PERIOD.format(unit=resample.UNITS[x], least=least, p=x, e=f'({E})')})" for x, least in (("hourly", 4), ("daily", 129), ("monthly", 3758), ("yearly", 47304))]
    weighted = "SELECT source, var, unnest(['weighted_rmse', 'weighted_MAE']) AS metric, unnest([sqrt(sum(w*(new - ref)*(new - ref))/sum(w)), sqrt(sum(w*abs(new - ref))/sum(w))]) AS value FROM sp GROUP BY source, var"
    shape = "SELECT source, var, unnest(['mean', 'bias', 'factor']) AS metric, unnest([new, new - ref, ref/new]) AS value FROM (SELECT n.source, unnest(['A', 'k']) AS var, unnest([r.A, r.k]) AS ref, unnest([n.A, n.k]) AS new FROM whole n JOIN whole r ON r.source = 'ref' WHERE n.source <> 'ref')"
    start = f"WITH wnd AS MATERIALIZED ({SQL['wind']}), {main}, {fits}, {pairs}, p AS MATERIALIZED ({every})"
    whole = stats_sql(start, tail=f", st AS MATERIALIZED (SELECT * FROM m WHERE value IS NOT NULL AND NOT isnan(value) UNION ALL {' UNION ALL '.join([weighted, shape, *periods])})")
    return f"{_deduced_sql(whole)}, rl(var, metric, perfect, good, weight) AS (VALUES {_RULES}), q AS (SELECT s.source, rl.*, value, 10/(perfect - good)*(value - good) AS quality_index, 10/(perfect - good)*(value - good)*weight AS quality_weighted FROM rl CROSS JOIN (SELECT DISTINCT source FROM st) s LEFT JOIN dd ON dd.source = s.source AND dd.var = rl.var AND dd.metric = rl.metric)"


_SCORED = "source:s var:s metric:s perfect:d good:d weight:d value:d quality_index:d quality_weighted:d"


@query("score", shown(f"{_score_sql()} SELECT * FROM q", _SCORED))
def _(spark, sf_dir):
    w = fixtures.wind(spark, sf_dir)
    return score.score(w.where("source = 'ref'").drop("source"), w.where("source = 'new'").drop("source"))[0]


# --- splits, blends, models

_NUMBERED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS \"row\" FROM orders"


def _orders(spark, sf_dir):
    """Orders with a time that tells every row apart."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr("timestampadd(MICROSECOND, o_orderkey, o_orderdate)").alias("time"))


@query("holdout_split", shown(f"SELECT *, CASE WHEN \"row\" >= (SELECT count(*) - CAST(ceil(0.3*count(*)) AS BIGINT) FROM orders) THEN 'test' ELSE 'train' END AS part FROM ({_NUMBERED})", "o_orderkey:l row:l part:s"))
def _(spark, sf_dir):
    return splits.holdout_split(_orders(spark, sf_dir)).drop("time")


@query("timeseries_folds", shown(f"SELECT * FROM (SELECT o_orderkey, \"row\", fold, CASE WHEN \"row\" < n - (8 - fold)*(n//9) THEN 'train' WHEN \"row\" < n - (7 - fold)*(n//9) THEN 'test' END AS part FROM ({_NUMBERED}) CROSS JOIN (SELECT unnest(range(8)) AS fold) CROSS JOIN (SELECT count(*) AS n FROM orders)) WHERE part IS NOT NULL", "o_orderkey:l row:l fold:i part:s"))
def _(spark, sf_dir):
    return splits.timeseries_folds(_orders(spark, sf_dir)).drop("time")


@query("kfold_folds", shown(f"SELECT o_orderkey, \"row\", ntile(8) OVER (ORDER BY \"row\") - 1 AS fold FROM ({_NUMBERED})", "o_orderkey:l row:l fold:i"))
def _(spark, sf_dir):
    return splits.kfold_folds(_orders(spark, sf_dir)).drop("time")


_PRED = "SELECT l_orderkey, l_linenumber, l_quantity AS y, l_quantity + l_discount*20 - 1 AS a, l_quantity*0.9 + l_linenumber AS b, 20 + l_tax*100 AS c FROM lineitem"


def _predictions(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity")
    return x.select("l_orderkey", "l_linenumber", q.alias("y"), (q + F.col("l_discount") * 20 - 1).alias("a"), (q * 0.9 + F.col("l_linenumber")).alias("b"), (20 + F.col("l_tax") * 100).alias("c"))


_BOARD = f"p AS ({_PRED}), u AS (SELECT y, unnest(['a', 'b', 'c']) AS \"Model\", unnest([a, b, c]) AS p FROM p), board AS (SELECT \"Model\", avg(abs(p - y)) AS \"MAE\", avg((p - y)*(p - y)) AS \"MSE\", sqrt(avg((p - y)*(p - y))) AS \"RMSE\", 1 - avg((p - y)*(p - y))/var_pop(y) AS \"R2\", sqrt(avg(pow(ln(1 + p) - ln(1 + y), 2))) AS \"RMSLE\", avg(abs((p - y)/y)) AS \"MAPE\" FROM u GROUP BY 1)"
_BEST = _BOARD + ", best AS (" + " UNION ALL ".join(f"(SELECT '{m}' AS metric, \"Model\" FROM board ORDER BY \"{m}\" {'DESC' if big else ''} LIMIT 1)" for m, big in blend.METRICS.items()) + ")"


@query("leaderboard", shown(f"WITH {_BOARD} SELECT * FROM board", "Model:s " + " ".join(f"{m}:d" for m in blend.METRICS)))
def _(spark, sf_dir):
    return blend.leaderboard(_predictions(spark, sf_dir), "y", ["a", "b", "c"])


@query("best_by_metric", shown(f"WITH {_BEST} SELECT * FROM best", "metric:s Model:s"))
def _(spark, sf_dir):
    return blend.best_by_metric(blend.leaderboard(_predictions(spark, sf_dir), "y", ["a", "b", "c"]))


@query("vote_count", shown(f"WITH {_BEST} SELECT \"Model\", count(*) AS votes FROM best GROUP BY 1", "Model:s votes:l"))
def _(spark, sf_dir):
    return blend.vote_weights(blend.leaderboard(_predictions(spark, sf_dir), "y", ["a", "b", "c"]))


@query("vote_blend", shown(f"WITH {_BEST}, v AS (SELECT count(*) FILTER (\"Model\" = 'a') AS va, count(*) FILTER (\"Model\" = 'b') AS vb, count(*) FILTER (\"Model\" = 'c') AS vc FROM best) SELECT l_orderkey, l_linenumber, (a*va + b*vb + c*vc)/(va + vb + vc) AS blend FROM p CROSS JOIN v", "l_orderkey:l l_linenumber:i blend:d"))
def _(spark, sf_dir):
    return blend.vote_blend(_predictions(spark, sf_dir), "y", ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "blend")


@query("weighted_prediction", shown(f"SELECT l_orderkey, l_linenumber, (a*0.5 + b*0.3 + c*0.1)/0.9 AS blend FROM ({_PRED})", "l_orderkey:l l_linenumber:i blend:d"))
def _(spark, sf_dir):
    return _predictions(spark, sf_dir).select("l_orderkey", "l_linenumber", blend.weighted_prediction(["a", "b", "c"], [0.5, 0.3, 0.1]).alias("blend"))


@query("rmse", shown(f"SELECT sqrt(avg((a - y)*(a - y))) AS rmse FROM ({_PRED})", "rmse:d"))
def _(spark, sf_dir):
    return blend.rmse(_predictions(spark, sf_dir), "y", "a")


# the least error of all blends on a grid of weights; the search has to come within half a hundredth of it
_GRID = "SELECT a, b, 1 - a - b AS c FROM (SELECT unnest(range(101))/100.0::DOUBLE AS a) CROSS JOIN (SELECT unnest(range(101))/100.0::DOUBLE AS b) WHERE a + b <= 1"


@query("optimize_weights", shown(f"WITH e AS (SELECT avg((a - y)*(a - y)) AS aa, avg((b - y)*(b - y)) AS bb, avg((c - y)*(c - y)) AS cc, avg((a - y)*(b - y)) AS ab, avg((a - y)*(c - y)) AS ac, avg((b - y)*(c - y)) AS bc FROM ({_PRED})) SELECT round(min(sqrt(g.a*g.a*aa + g.b*g.b*bb + g.c*g.c*cc + 2*g.a*g.b*ab + 2*g.a*g.c*ac + 2*g.b*g.c*bc)), 2) AS rmse, TRUE AS within FROM e CROSS JOIN ({_GRID}) g", "rmse:d within:s"))
def _(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    found = blend.WeightOptimizer(seed=1).fit(rows, "y", ["a", "b", "c"])
    least, most = min(found.get_weights()), max(found.get_weights())
    return blend.rmse(found.predict(rows), "y", "blend").select(F.round("rmse", 2).alias("rmse"), F.lit(found.LOW <= least and most <= found.HIGH).alias("within"))


@query("kde_grid", shown(f"WITH s AS (SELECT source, floor(M*10)/10 AS v FROM ({SQL['hourly']})), n AS (SELECT source, count(*) AS n FROM s GROUP BY 1), c AS (SELECT source, v, count(*) AS c FROM s GROUP BY 1, 2), g AS (SELECT unnest(range(61)) * 0.5 AS x) SELECT c.source, x, sum(c*exp(-(x - v)*(x - v)/(2*0.7*0.7)))/(any_value(n)*0.7*sqrt(2*pi())) AS density FROM c CROSS JOIN g JOIN n ON c.source = n.source GROUP BY 1, 2", "source:s x:d density:d"))
def _(spark, sf_dir):
    return blend.kde_grid(fixtures.hourly(spark, sf_dir).withColumn("M", F.floor(F.col("M") * 10) / 10.0), "M", low=0.0, high=30.0, points=61, width=0.7, bins=30000)


def _features(spark, sf_dir):
    h = fixtures.hourly(spark, sf_dir).where("source = 'view'")
    return dates.date_vars(h).withColumn("D", F.sin(F.radians("Dir"))).select("time", "M", "D", "hour_sin_1", "hour_cos_1", "dayofyear_sin_1")


FEATURES = ["D", "hour_sin_1", "hour_cos_1", "dayofyear_sin_1"]


@query("train_boosted")
def _(spark, sf_dir):
    return train.train_boosted(_features(spark, sf_dir), FEATURES, "M", splits=3, iterations=5, depth=3)[1]


@query("automl_compare")
def _(spark, sf_dir):
    return train.automl_compare(_features(spark, sf_dir), FEATURES, "M", splits=2, exclude=("gbt", "rf"))


# --- streams


@query("stream_resample", shown("SELECT event_type AS source, date_trunc('hour', ts) AS time, avg(value) AS M, count(*) AS n FROM events GROUP BY 1, 2", "source:s time:s M:d n:l"))
def _(spark, sf_dir):
    import uuid

    from zephyrine.session import shared_dir
    from zephyrine.streaming.resample import run_available, stream_resample

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).select(F.col("event_type").alias("source"), F.col("ts").alias("time"), F.col("value").alias("M"))
    run_available(stream_resample(rows, ["M"]), f"{folder}/out", f"{folder}/state", mode="complete")
    return spark.read.parquet(f"{folder}/out")


# --- sources, sinks and what is left


@query("read_series_csv", shown(f"SELECT * FROM ({SQL['wide']})", "sample:l time:s U_10.00:d U_50.00:d U_100.00:d V_10.00:d V_50.00:d V_100.00:d M:d Dir:d"))
def _(spark, sf_dir):
    import uuid

    from zephyrine.session import shared_dir

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    fixtures.wide(spark, sf_dir).write.option("header", True).csv(path)
    return sources.read_series_csv(spark, path, sources.T.StructType.fromDDL("sample bigint, time timestamp_ntz, `U_10.00` double, `U_50.00` double, `U_100.00` double, `V_10.00` double, `V_50.00` double, `V_100.00` double, M double, Dir double"))


@query("frame_from_memory", shown("SELECT * FROM (VALUES (1, 2.5::DOUBLE), (2, NULL), (3, NULL)) AS x(k, v)", "k:l v:d"))
def _(spark, sf_dir):
    return sources.frame_from_memory(spark, [(1, 2.5), (2, float("nan")), (3, None)], "k long, v double")


@query("write_parquet", shown(f"SELECT * FROM ({SQL['hourly']})", SERIES))
def _(spark, sf_dir):
    import uuid

    from zephyrine.session import shared_dir

    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    sources.write_parquet(fixtures.hourly(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("add_level", shown(f"SELECT *, 70.0 AS lev FROM ({SQL['hourly']})", f"{SERIES} lev:d"))
def _(spark, sf_dir):
    return reshape.add_level(fixtures.hourly(spark, sf_dir))


@query("drop_targets", shown(f"SELECT sample, time, \"U_10.00\" FROM ({SQL['wide']})", "sample:l time:s U_10.00:d"))
def _(spark, sf_dir):
    return reshape.drop_targets(fixtures.wide(spark, sf_dir).select("sample", "time", "`U_10.00`", "M", "Dir"))


@query("reindex_bins", shown(f"WITH s AS ({SQL['wind']}), {_DIST}, {_POP.split(', pop AS')[0]} SELECT f.source, f.speed, f.direction, n FROM f LEFT JOIN d ON f.source = d.source AND f.speed = d.speed AND f.direction = d.direction", "source:s speed:d direction:d n:d"))
def _(spark, sf_dir):
    return histogram.reindex_bins(histogram.distribution(fixtures.wind(spark, sf_dir))).withColumn("n", F.col("n").cast("double"))


@query("missing_rules", shown(f"{_deduced_sql(_ST)}, rl(var, metric, perfect, good, weight) AS (VALUES {_RULES}) SELECT var, metric FROM rl ANTI JOIN dd USING (var, metric)", "var:s metric:s"))
def _(spark, sf_dir):
    found = score.deduced_stats(stats.compare_stats(align.pairs(fixtures.wind(spark, sf_dir), "ref")))
    return score.rules(spark).join(found, ["var", "metric"], "left_anti").select("var", "metric")


_TAB = f"WITH s AS ({SQL['wind']}), {_DIST}, {_POP}, p0 AS (SELECT b.source, a.population AS ref, b.population AS new FROM pop a JOIN pop b ON a.speed = b.speed AND a.direction = b.direction WHERE a.source = 'ref' AND b.source <> 'ref')"


@query("compare_tabfiles_relative", shown(f"{_TAB}, x AS (SELECT source, 100*new/ref AS v FROM p0 WHERE ref > 1) SELECT source, 'TAB_relpop' AS var, unnest(['length', 'mean', 'bias', 'rmse', 'MAE', 'std', 'max', 'q0.5']) AS metric, unnest([count(*), avg(v), avg(v) - 100, sqrt(avg((v - 100)*(v - 100))), avg(abs(v - 100)), stddev_pop(v), max(v), median(v)]) AS value FROM x GROUP BY source", LONG))
def _(spark, sf_dir):
    out = histogram.compare_tabfiles(fixtures.wind(spark, sf_dir), "ref", relative=True)
    return out.where("var = 'TAB_relpop' and metric in ('length', 'mean', 'bias', 'rmse', 'MAE', 'std', 'max', 'q0.5')")


_SECTORS = "f AS (SELECT source, CAST(floor((Dir + 11.25)/22.5) AS INTEGER) % 16 AS k16, avg(M) AS mean, pow(stddev_pop(M)/avg(M), -1.086) AS k, count(M) AS count FROM s GROUP BY 1, 2), fit AS (SELECT source, k16, mean/gamma(1 + 1/k) AS A, k, count FROM f WHERE count >= 10)"


@query("compare_weibulls_sectors", shown(f"""WITH s AS ({SQL['wind']}), {_SECTORS}, p AS (SELECT n.source, unnest(['A_sector', 'k_sector']) AS var, unnest([r.A, r.k]) AS ref, unnest([n.A, n.k]) AS new, n.count AS w FROM fit n JOIN fit r ON n.k16 = r.k16 WHERE r.source = 'ref' AND n.source <> 'ref')
  SELECT source, var, unnest(['rmse', 'r2', 'weighted_rmse', 'weighted_MAE']) AS metric, unnest([sqrt(avg((new - ref)*(new - ref))), pow(corr(new, ref), 2), sqrt(sum(w*(new - ref)*(new - ref))/sum(w)), sqrt(sum(w*abs(new - ref))/sum(w))]) AS value FROM p GROUP BY source, var""", LONG))
def _(spark, sf_dir):
    out = weibull.compare_weibulls(fixtures.wind(spark, sf_dir), "ref", sectors=16, method="params")
    return out.where("var like '%sector' and metric in ('rmse', 'r2', 'weighted_rmse', 'weighted_MAE')")


@query("fold_averages", shown(f"WITH p AS ({_PRED}), f AS (SELECT l_orderkey % 5 AS fold, sqrt(avg((a - y)*(a - y))) AS rmse FROM p GROUP BY 1) SELECT avg(rmse) AS rmse FROM f", "rmse:d"))
def _(spark, sf_dir):
    e = F.col("a") - F.col("y")
    folds = _predictions(spark, sf_dir).groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return folds.agg(F.avg("rmse").alias("rmse"))


@query("circular_statistics", shown(f"SELECT source, (degrees(atan2(avg(sin(radians(Dir))), avg(cos(radians(Dir))))) + 360) % 360 AS mean, degrees(sqrt(-ln(pow(avg(sin(radians(Dir))), 2) + pow(avg(cos(radians(Dir))), 2)))) AS std FROM ({SQL['wind']}) GROUP BY source", "source:s mean:d std:d"))
def _(spark, sf_dir):
    return fixtures.wind(spark, sf_dir).groupBy("source").agg(wind.circular_mean(F.col("Dir")).alias("mean"), wind.circular_std(F.col("Dir")).alias("std"))
