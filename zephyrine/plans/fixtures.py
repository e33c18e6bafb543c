"""Series for the registered queries, from the driver's tables and from formulas, on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURLY = """SELECT event_type AS source, {hour} AS time, avg(value)/6.0 AS M,
  CAST(CAST(sum(event_id*37) AS BIGINT) % 3600 AS DOUBLE)/10.0 AS Dir FROM events GROUP BY 1, 2"""
DAILY = """SELECT o_orderpriority AS source, {day} AS time, avg(o_totalprice)/30011.0 AS M,
  CAST(CAST(sum(o_orderkey*37) AS BIGINT) % 3600 AS DOUBLE)/10.0 AS Dir FROM orders GROUP BY 1, 2"""

#: The same series as DuckDB sees them: hourly and daily from tables, wind from formulas (10-minute steps of two years for each 75,000 orders (at least once), with gaps).
SQL_HOURLY = HOURLY.format(hour="date_trunc('hour', ts)")
SQL_DAILY = DAILY.format(day="date_trunc('day', o_orderdate)")
SQL_WIND = """SELECT source, time, M, CASE WHEN d >= 360 THEN d - 360 ELSE d END AS Dir FROM (
  SELECT unnest(['ref', 'new']) AS source, time, unnest([m0, m0*0.95 + 0.3 + ((i*6271)%1000)/1000.0::DOUBLE - 0.5]) AS M, unnest([d1, d1 + 5]) AS d FROM (
    SELECT i, time, m0, CASE WHEN d0 >= 360 THEN d0 - 360 ELSE d0 END AS d1 FROM (
      SELECT range AS i, TIMESTAMP '2020-01-01' + to_minutes(10*range) AS time,
        8 + 3*sin(2*pi()*range/144.0::DOUBLE) + 2*sin(2*pi()*range/52560.0::DOUBLE) + ((range*7919)%1000)/1000.0::DOUBLE*2 - 1 AS m0,
        270 + 60*sin(2*pi()*range/1008.0::DOUBLE) + ((range*104729)%360)/12.0::DOUBLE AS d0
      FROM (SELECT unnest(range(105120*n)) AS range FROM (SELECT greatest(1, count(*)//75000) AS n FROM orders)) WHERE (range*31) % 997 >= 5)))"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of hours: sources view, click, ..."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg((F.avg("value") / 6.0).alias("M"), (F.pmod(F.sum(F.col("event_id") * 37), F.lit(3600)).cast("double") / 10.0).alias("Dir"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six years of days: sources 1-URGENT, 2-HIGH, ..."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("source"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time")).agg((F.avg("o_totalprice") / 30011.0).alias("M"), (F.pmod(F.sum(F.col("o_orderkey") * 37), F.lit(3600)).cast("double") / 10.0).alias("Dir"))


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ref and new, 104 592 rows each for every 75,000 orders, and once at least: two years, and more at larger scales."""
    i = F.col("id")
    two_pi = 2 * F.pi()
    times = max(1, spark.read.parquet(f"{sf_dir}/orders.parquet").count() // 75000)
    rows = spark.range(105120 * times).where((i * 31) % 997 >= 5)
    m0 = 8 + 3 * F.sin(two_pi * i / 144.0) + 2 * F.sin(two_pi * i / 52560.0) + ((i * 7919) % 1000) / F.lit(1000.0) * 2 - 1
    d0 = 270 + 60 * F.sin(two_pi * i / 1008.0) + ((i * 104729) % 360) / F.lit(12.0)
    rows = rows.withColumns({"time": F.expr("timestampadd(MINUTE, cast(10 * id as int), timestamp_ntz'2020-01-01 00:00:00')"), "m0": m0, "d0": d0})
    rows = rows.withColumn("d1", F.when(F.col("d0") >= 360, F.col("d0") - 360).otherwise(F.col("d0")))
    pairs = F.array(F.struct(F.lit("ref").alias("source"), F.col("m0").alias("M"), F.col("d1").alias("d")), F.struct(F.lit("new").alias("source"), (F.col("m0") * 0.95 + 0.3 + ((i * 6271) % 1000) / F.lit(1000.0) - 0.5).alias("M"), (F.col("d1") + 5).alias("d")))
    return rows.select("time", F.inline(pairs)).select("source", "time", "M", F.when(F.col("d") >= 360, F.col("d") - 360).otherwise(F.col("d")).alias("Dir"))


#: Rows by orders' keys at three heights, some missing, as a wide table would come.
SQL_WIDE = """SELECT o_orderkey AS sample, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS time,
  o_totalprice/30011.0 AS "U_10.00", CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice/20011.0 END AS "U_50.00", CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice/10007.0 END AS "U_100.00",
  CAST(o_custkey % 17 AS DOUBLE) AS "V_10.00", CAST(o_custkey % 13 AS DOUBLE) AS "V_50.00", CAST(o_custkey % 11 AS DOUBLE) - 5 AS "V_100.00",
  CAST(o_custkey % 7 AS DOUBLE) AS M, CAST(o_orderkey % 360 AS DOUBLE) AS Dir FROM orders"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return o.select(
        k.alias("sample"),
        F.expr("timestampadd(MINUTE, cast(o_orderkey % 1440 as int), o_orderdate)").alias("time"),
        (p / 30011.0).alias("U_10.00"),
        F.when(k % 5 != 0, p / 20011.0).alias("U_50.00"),
        F.when(k % 3 != 0, p / 10007.0).alias("U_100.00"),
        (c % 17).cast("double").alias("V_10.00"),
        (c % 13).cast("double").alias("V_50.00"),
        ((c % 11).cast("double") - 5).alias("V_100.00"),
        (c % 7).cast("double").alias("M"),
        (k % 360).cast("double").alias("Dir"),
    )
