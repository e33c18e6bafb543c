"""Alignment of series on their timestamps. A series is rows (source, time, variables); missing values are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("source", "time")


def variables(df: DataFrame, keys=KEYS) -> list[str]:
    return [c for c in df.columns if c not in keys]


def drop_duplicates_time(df: DataFrame, order: Column | str | None = None, keys=KEYS) -> DataFrame:
    """The first row of each time. order says which is first; without it the least by all variables is, so that the choice doesn't hang on how rows are dealt."""
    rest = variables(df, keys)
    by = F.struct(*([F.lit(0)] if order is None else [order if isinstance(order, Column) else F.col(order)]), *(F.col(c) for c in rest))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("row"))
    return picked.select(*keys, "row.*")


def dropna_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=columns or variables(df))


def dropna_any(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns or variables(df))


def common_times(df: DataFrame) -> DataFrame:
    """The times that every source has. One partial aggregate; the number of sources is a single row."""
    total = df.agg(F.count_distinct("source").alias("total"))
    times = df.groupBy("time").agg(F.count_distinct("source").alias("n"))
    return times.join(F.broadcast(total), F.col("n") == F.col("total"), "left_semi").select("time")


def select_by_time(df: DataFrame, times: DataFrame) -> DataFrame:
    return df.join(times.select("time").distinct(), "time", "left_semi").select(df.columns)


def time_match_sources(df: DataFrame) -> DataFrame:
    """Rows at times that every source has; rows without any value don't count as had."""
    some = drop_duplicates_time(dropna_all(df))
    return select_by_time(some, common_times(some))


def pairs(df: DataFrame, ref: str, names: list[str] | None = None) -> DataFrame:
    """(source, var, time, ref, new) for each other source and variable: an inner join on time, then one row for each variable."""
    names = names or variables(df)
    left = df.where(F.col("source") == ref).select("time", F.struct(*(F.col(n).cast("double").alias(n) for n in names)).alias("r"))
    right = df.where(F.col("source") != ref).select("source", "time", F.struct(*(F.col(n).cast("double").alias(n) for n in names)).alias("n"))
    both = right.join(left, "time")
    rows = F.array(*(F.struct(F.lit(n).alias("var"), F.col("r")[n].alias("ref"), F.col("n")[n].alias("new")) for n in names))
    return both.select("source", "time", F.inline(rows))


def combine_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Values of first, and of second where first has none, over the keys of either."""
    names = list(dict.fromkeys(c for c in (*first.columns, *second.columns) if c not in keys))
    a, b = first.alias("a"), second.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    joined = a.join(b, on, "full")

    def value(c: str) -> Column:
        have = [F.col(f"{s}.{c}") for s, df in (("a", first), ("b", second)) if c in df.columns]
        return F.coalesce(*have).alias(c)

    return joined.select(*(value(c) for c in (*keys, *names)))


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Variables of several frames over the keys of any."""
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def deduce_frequency(df: DataFrame, first: int | None = None) -> DataFrame:
    """(source, freq_min): the most common step in whole minutes, the earliest of equals; over the first so many times, or all. Steps are taken within days and between the ends of days, so no task holds a source."""
    day = F.to_date("time").alias("day")
    times = df.where("time is not null").select("source", "time", day).distinct()
    across = Window.partitionBy("source").orderBy("day")
    if first is not None:
        # the days that hold the first times: few rows are numbered
        days = times.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
        days = days.withColumn("had", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("had") < first)
        number = F.row_number().over(Window.partitionBy("source", "day").orderBy("time"))
        times = times.join(days.drop("n"), ["source", "day"]).withColumn("i", number + F.col("had")).where(F.col("i") <= first).select("source", "time", "day")
    inside = times.withColumn("before", F.lag("time").over(Window.partitionBy("source", "day").orderBy("time"))).select("source", "time", "before")
    ends = times.groupBy("source", "day").agg(F.min("time").alias("time"), F.max("time").alias("last"))
    between = ends.select("source", "time", F.lag("last").over(across).alias("before"))
    steps = inside.unionByName(between).where("before is not null").select("source", "time", F.expr("timestampdiff(MINUTE, before, time)").alias("step"))
    counts = steps.groupBy("source", "step").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"))
    return counts.groupBy("source").agg(F.min_by("step", F.struct(-F.col("n"), F.col("first"))).cast("int").alias("freq_min"))


def regularize(df: DataFrame, freq_min: int | None = None) -> DataFrame:
    """Every source over its regular grid, with index (steps from its first time) and nulls in gaps. Rows off the grid are left out. The grid is made in chunks, so a long series is made by many tasks."""
    bounds = df.groupBy("source").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    bounds = bounds.withColumn("freq_min", F.lit(freq_min)) if freq_min else bounds.join(deduce_frequency(df), "source")
    chunk = 1 << 16
    steps = F.expr("timestampdiff(MINUTE, t0, t1)") / F.col("freq_min")
    parts = bounds.withColumn("n", F.floor(steps)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / chunk))))
    grid = parts.withColumn("index", F.explode(F.sequence(F.col("part") * chunk, F.least(F.col("n"), F.col("part") * chunk + chunk - 1))))
    grid = grid.withColumn("time", F.expr("timestampadd(MINUTE, cast(index * freq_min as int), t0)"))
    return grid.select("source", "time", "index", "freq_min").join(df, ["source", "time"], "left")
