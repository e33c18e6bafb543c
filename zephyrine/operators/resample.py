"""Comparison after resampling to hours, days, months or years."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrine.functions.wind import CIRCULAR, CUMULATIVE

from .align import deduce_frequency
from .stats import GROUP, as_rows, emd, error, pearson

#: Unit and least number of values of a period, for so many values an hour.
UNITS = {"hourly": "hour", "daily": "day", "monthly": "month", "yearly": "year"}
_LEAST = {"hourly": (0.75, 1), "6-hourly": (0.75, 6), "daily": (0.9, 24), "weekly": (0.9, 7 * 24), "monthly": (0.9, 29 * 24), "yearly": (0.9, 365 * 24)}
SUMMED = (*CUMULATIVE, "total_veer")


def min_values_period(period: str, per_hour: int | None) -> int:
    """Values below which a period is not used; none are asked for without a rate."""
    if per_hour is None:
        return 0
    share, hours = _LEAST[period]
    return int(share * hours * per_hour)


def resample(df: DataFrame, unit: str, names: list[str], *, keys=("source",), least: int = 0, summed=SUMMED, function: Callable[[str], Column] | None = None) -> DataFrame:
    """Means (sums of cumulative variables) by period, or function, from a column's name to an aggregate. A period with fewer than `least` rows is null: rows count, whether or not they have a value."""
    enough = F.count(F.lit(1)) >= least
    aggs = [F.when(enough, function(n) if function else F.sum(n) if n in summed else F.avg(n)).alias(n) for n in names]
    return df.groupBy(*keys, F.date_trunc(unit, "time").cast("timestamp_ntz").alias("time")).agg(*aggs)


def resampled_pairs(pairs: DataFrame, period: str, per_hour: int | None, group=GROUP) -> DataFrame:
    """Pairs of periods that have enough rows. Directions go the short way round from the reference before they are averaged."""
    turned = pairs.withColumn("base", F.col("var")).withColumn("new", F.when(F.col("base").isin(*CIRCULAR), F.col("ref") + error()).otherwise(F.col("new")))
    enough = F.count(F.lit(1)) >= min_values_period(period, per_hour)
    total = F.col("var").isin(*SUMMED)
    by = turned.groupBy(*group, F.date_trunc(UNITS[period], "time").alias("time"))
    sides = [F.when(enough, F.when(F.first(total), F.sum(s)).otherwise(F.avg(s))).alias(s) for s in ("ref", "new")]
    return by.agg(*sides)


def resampled_rows(pairs: DataFrame, periods: list[str], per_hour: int | None, group=GROUP) -> DataFrame:
    """(group, period, ref, new): the pairs of several resamplings."""
    return reduce(DataFrame.unionByName, (resampled_pairs(pairs, p, per_hour, group).select(*group, F.lit(p).alias("period"), "ref", "new") for p in periods))


def stats_of_resampled(rows: DataFrame, group=GROUP) -> DataFrame:
    """length, r2 (over 2 periods), rmse, MAE, SAE (summed variables) and EMD (over 5), with the period's name behind an underscore. All periods go through one aggregate."""
    group = list(group)
    keys = [*group, "period"]
    e = F.col("new") - F.col("ref")
    one = rows.groupBy(*keys).agg(F.count("new").alias("n"), F.count("ref").alias("m"), pearson(F.col("new"), F.col("ref")).alias("corr"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(F.abs(e)).alias("sae"))
    metrics = [
        ("length", F.col("n")),
        ("r2", F.when(F.col("m") > 2, F.col("corr") * F.col("corr"))),
        ("rmse", F.col("rmse")),
        ("MAE", F.col("mae")),
        ("SAE", F.when(F.col("var").isin(*SUMMED), F.col("sae"))),
    ]
    distances = emd(rows, keys).join(one.where("m > 5").select(*keys), keys, "left_semi")
    out = as_rows(one, keys, metrics).unionByName(distances.select(*keys, F.lit("EMD").alias("metric"), F.col("emd").alias("value")))
    return out.select(*group, F.concat_ws("_", "metric", "period").alias("metric"), "value")


def stats_in_resampling(pairs: DataFrame, period: str, per_hour: int | None, group=GROUP) -> DataFrame:
    return stats_of_resampled(resampled_rows(pairs, [period], per_hour, group), group)


def per_hour(series: DataFrame, source: str) -> int:
    """Values an hour of a source, from its first 200 times."""
    row = deduce_frequency(series.where(F.col("source") == source), 200).first()
    if row is None:
        raise ValueError(f"{source} has too few times")
    return 60 // row["freq_min"]
