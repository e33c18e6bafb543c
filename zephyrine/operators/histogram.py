"""Counts by speed bin and direction sector, and comparison of their shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrine.functions.wind import derive, sector, truncated_speed

from .stats import as_pairs, compare_stats

GRID = ("speed", "direction")


def least_cells() -> Column:
    """Rows that a comparison needs, by var."""
    return F.when(F.col("var") == "TAB_relpop", 3).otherwise(2)


def distribution(series: DataFrame, *, sectors: int = 16, max_bin: int | None = None, include_top_bin: bool = False) -> DataFrame:
    """(source, speed, direction, n): rows by whole speed (at its middle) and sector, zeros included.

    The bins of a source go up to its largest whole speed; that bin itself is left out unless include_top_bin (Q3 of the survey). max_bin sets the number of bins. Rows without a direction count as north, rows without a speed nowhere.
    """
    m = derive(series, "M")
    cells = series.select("source", truncated_speed(m).alias("bin"), sector(derive(series, "Dir"), sectors).alias("k")).where("bin is not null")
    counts = cells.groupBy("source", "bin", "k").agg(F.count(F.lit(1)).alias("n"))
    top = F.lit(max_bin) if max_bin is not None else F.max("bin") + int(include_top_bin)
    bounds = counts.groupBy("source").agg(top.cast("bigint").alias("bins")).where("bins > 0")
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    full = grid.join(counts, ["source", "bin", "k"], "left")
    return full.select("source", (F.col("bin") + 0.5).alias("speed"), (F.col("k") * (360.0 / sectors)).alias("direction"), F.coalesce("n", F.lit(0)).cast("int").alias("n"))


def reindex_bins(dist: DataFrame, top: float | None = None) -> DataFrame:
    """Every source over the speeds up to `top`, or the largest of any; missing cells have null counts."""
    last = dist.agg(F.max("speed").alias("top")) if top is None else dist.sparkSession.createDataFrame([(float(top),)], "top double")
    cells = dist.select("source", "direction").distinct().crossJoin(F.broadcast(last)).withColumn("speed", F.explode(F.transform(F.sequence(F.lit(0), F.floor("top").cast("int")), lambda j: j + F.lit(0.5))))
    return cells.drop("top").join(dist, ["source", *GRID], "left").select("source", *GRID, "n")


def bin_population(dist: DataFrame, *, top: float | None = None, min_samples: int = 15) -> DataFrame:
    """(source, speed, direction, population): share of all counts in percent; cells with at most min_samples count 0, but stay in the whole (Q4)."""
    full = reindex_bins(dist, top)
    whole = F.sum("n").over(Window.partitionBy("source"))
    return full.select("source", *GRID, F.try_divide(F.when(F.col("n") > min_samples, 100.0 * F.col("n")).otherwise(F.lit(0.0)), whole).alias("population"))


def tabfile_pairs(series: DataFrame, ref: str, *, sectors: int = 16, max_bin: int | None = None, min_samples: int = 15, relative: bool = False) -> DataFrame:
    """Pairs TAB_pop, and TAB_relpop: shares relative to the reference's where that has more than 1 %; the reference side is 100 throughout (Q20), so it has no r2."""
    shares = bin_population(distribution(series, sectors=sectors, max_bin=max_bin), top=max_bin, min_samples=min_samples)
    left = shares.where(F.col("source") == ref).select(*GRID, F.col("population").alias("ref"))
    both = shares.where(F.col("source") != ref).join(left, list(GRID)).select("source", F.lit("TAB_pop").alias("var"), "ref", F.col("population").alias("new")).where("ref is not null and new is not null")
    if relative:
        both = both.unionByName(both.where("ref > 1").select("source", F.lit("TAB_relpop").alias("var"), F.lit(100.0).alias("ref"), (100 * F.col("new") / F.col("ref")).alias("new")))
    return as_pairs(both)


def compare_tabfiles(series: DataFrame, ref: str, *, sectors: int = 16, max_bin: int | None = None, min_samples: int = 15, relative: bool = False, **options) -> DataFrame:
    """Metrics of the pairs of tabfile_pairs; fewer than 3 cells of TAB_relpop give none."""
    rows = tabfile_pairs(series, ref, sectors=sectors, max_bin=max_bin, min_samples=min_samples, relative=relative)
    return compare_stats(rows.drop("weight"), base=F.col("base"), least=least_cells(), **options)
