"""Scalar functions: documented examples, edges and properties."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrine.functions import dates, power, wind
from zephyrine.plans import catalog


def values(spark, expression, rows, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_bins(spark):
    x = [2.5, 2.3, 1.3, 1.8, 3.9, 0.4, 1.1]
    assert values(spark, wind.bin_value, x) == [2.5, 2.5, 1.5, 1.5, 3.5, 0.5, 1.5]
    assert values(spark, lambda c: wind.bin_value(c, centred=True), x) == [3, 2, 1, 2, 4, 0, 1]
    assert values(spark, lambda c: wind.bin_value(c, 1.0, 2.0), [7.2, -3.0, None]) == [3.5, 0.5, None]
    assert values(spark, lambda c: wind.bin_edges(c), [5.0]) == [[0, 1, 2, 3, 4, 5, 6]]
    assert values(spark, lambda c: wind.bin_edges(c, centred=True), [5.0]) == [[-0.5, 0.5, 1.5, 2.5, 3.5, 4.5, 5.5]]
    assert values(spark, lambda c: wind.bin_edges(c, 2.0), [8.43]) == [[0, 2, 4, 6, 8, 10]]
    assert values(spark, wind.speed_bin, [0.5, 1.49, None]) == [1, 1, None]


def test_means_that_fall_short_of_a_half(spark, tmp_path):
    assert values(spark, wind.speed_bin, [0.49999999999999994, 37.49999999999999, -2.5]) == [0, 37, -2]
    assert values(spark, lambda c: wind.speed_bin(c, slack=1e-12), [37.49999999999999, 37.4999999, None]) == [38, 37, None]
    # 675.00 / 3 / 6 is 37.5; in doubles the sum of these is a little less
    rows = [(i, dt.datetime(2024, 1, 1, 3, i), "view", v) for i, v in enumerate((277.69, 262.89, 134.42))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["bins"](spark, str(tmp_path)).first()
    db = pytest.importorskip("duckdb").connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert tuple(got)[2:] == db.execute(catalog.ORACLES["bins"]).fetchall()[0][2:] == (38, 37.5, 37, 38, 37)


def test_sectors(spark):
    x = [0.0, 5, 87, 56, 279, 182, 340, 355]
    for n, want in ((16, [0, 0, 4, 2, 12, 8, 15, 0]), (12, [0, 0, 3, 2, 9, 6, 11, 0]), (4, [0, 0, 1, 1, 3, 2, 0, 0])):
        assert values(spark, lambda c, n=n: wind.sector(c, n), [float(v) for v in x]) == want
    assert values(spark, wind.sector, [None, 360.0, 348.75, 348.74]) == [0, 0, 0, 15]


def test_wrapping(spark):
    x = [-360.0, -181.0, -180.0, -1.0, 0.0, 179.0, 180.0, 181.0, 359.0, None]
    assert values(spark, wind.wrap180, x) == [0, 179, -180, -1, 0, 179, -180, -179, -1, None]
    assert values(spark, wind.wrap180_closed, x) == [0, 179, -180, -1, 0, 179, 180, -179, -1, None]


def test_components_round_trip(spark):
    df = spark.createDataFrame([(3.0, 10.0), (8.5, 270.0), (1.0, 360.0), (2.0, 123.4), (None, 5.0)], "M double, Dir double")
    uv = df.select("M", "Dir", wind.derive(df, "U").alias("U"), wind.derive(df, "V").alias("V"))
    back = uv.select("U", "V", F.col("M").alias("m"), F.col("Dir").alias("d"))
    for r in back.select("m", "d", wind.derive(back, "M").alias("M"), wind.derive(back, "Dir").alias("Dir")).collect():
        if r.m is None:
            assert r.M is None and r.Dir is None
        else:
            assert math.isclose(r.m, r.M) and math.isclose(r.d, r.Dir)
    assert wind.derive(df, "M")._jc.toString() == "M"
    with pytest.raises(ValueError):
        wind.derive(spark.range(1), "U")


def test_circular(spark):
    one = spark.createDataFrame([(359.0,), (1.0,), (None,)], "x double").agg(wind.circular_mean(F.col("x")).alias("m"), wind.circular_std(F.col("x")).alias("s")).first()
    assert min(one.m, 360 - one.m) < 1e-9 and math.isclose(one.s, 1.0, rel_tol=1e-3)
    same = spark.createDataFrame([(90.0,)] * 3, "x double").agg(wind.circular_std(F.col("x")).alias("s")).first()
    assert same.s < 1e-6


def test_power(spark):
    knots = [float(s) for s in power.SPEEDS]
    assert np.allclose(values(spark, power.power, knots), power.POWERS)
    got = values(spark, power.power, [5.1, 7.3, 25.0, 2.99, 50.01, None])
    assert np.allclose(got[:5], [640.508, 1947.542, 4200, 0, 0], atol=2e-3) and got[5] is None
    # a cubic is its own spline, with knots that are not even
    x = [0.0, 1, 2.5, 3, 7, 8]
    y = [v**3 - 2 * v for v in x]
    ask = [0.3, 2.0, 2.7, 5.0, 7.9]
    assert np.allclose(values(spark, lambda c: power.power(c, x, y), ask), [v**3 - 2 * v for v in ask])
    assert values(spark, lambda c: power.power(c, [0, 1, 2], [0, 10, 10], kind="linear", fill=None), [0.5, 1.5, 3.0]) == [5, 10, None]
    assert np.allclose(values(spark, lambda c: power.power(c, [0, 1, 2], [0, 1, 4]), [0.5, 1.5]), [0.25, 2.25])
    for bad in (([1], [1, 2]), ([2, 1], [1, 2]), ([1, 2], None)):
        with pytest.raises(ValueError):
            power.power(F.lit(1.0), *bad)


def test_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 23:10:00' time union all select timestamp_ntz'2021-01-03 00:00:00'").orderBy(F.desc("time"))
    rows = dates.date_names(dates.date_parts(df, "time")).orderBy(F.desc("time")).collect()
    assert [(r.weekday, r.week, r.day, r.hour, r.month, r.year, r.dayofyear, r.weekday_name, r.month_name) for r in rows] == [(3, 9, 29, 23, 2, 2024, 60, "Thursday", "February"), (6, 53, 3, 0, 1, 2021, 3, "Sunday", "January")]
    with pytest.raises(ValueError):
        dates.date_parts(df, "time", ["century"])
    out = dates.date_vars(df)
    assert out.columns == ["time", *(f"{p}_{f}_1" for p in ("month", "hour", "dayofyear") for f in ("sin", "cos"))]
    n = spark.range(4)
    with pytest.warns(UserWarning):
        single = dates.fourier(n, "id", single=True)
    assert dict(single.dtypes)["id_sin_1"] == "float"
    with pytest.raises(ValueError):
        dates.bulk_fourier(n, ["id"], [1, 2])


def test_curve_kinds(spark):
    x, y = [0.0, 1.0, 3.0, 4.0, 6.0], [0.0, 1.0, 9.0, 16.0, 36.0]
    ask = [0.0, 0.5, 0.6, 1.0, 2.0, 3.7, 5.0, 6.0, 6.1, None]
    by = {k: values(spark, lambda c, k=k: power.power(c, x, y, kind=k, fill=-1.0), ask) for k in ("quadratic", "linear", "slinear", "previous", "zero", "next", "nearest", "nearest-up")}
    assert np.allclose(by["quadratic"][:8], [v * v for v in ask[:8]], atol=1e-9)  # a parabola is its own curve
    assert by["linear"] == by["slinear"] and by["previous"] == by["zero"] == [0, 0, 0, 1, 1, 9, 16, 36, -1, None]
    assert by["next"] == [0, 1, 1, 1, 9, 16, 36, 36, -1, None]
    assert by["nearest"] == [0, 0, 1, 1, 1, 16, 16, 36, -1, None] and by["nearest-up"] == [0, 1, 1, 1, 9, 16, 36, 36, -1, None]
    smooth = values(spark, lambda c: power.power(c, [0, 1, 2, 3, 5], [0, 5, 1, 7, 2], kind="quadratic"), [0.0, 1.0, 2.0, 3.0, 5.0, 1.5 - 1e-6, 1.5 + 1e-6])
    assert np.allclose(smooth[:5], [0, 5, 1, 7, 2], atol=1e-9) and abs(smooth[5] - smooth[6]) < 1e-4
    with pytest.raises(Exception, match="outside the curve"):
        values(spark, lambda c: power.power(c, x, y, bounds_error=True), [7.0])
    with pytest.raises(ValueError):
        power.power(F.lit(1.0), x, y, kind="other")
