"""Cycles over months and hours of the day."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import deduce_frequency, variables
from .stats import as_pairs, compare_stats

_STATS = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "std": F.stddev_samp, "count": F.count}


def _stat(name: str) -> callable:
    if name in _STATS:
        return _STATS[name]
    if re.fullmatch(r"q0?\.\d+|q[01]", name):
        return lambda c: F.percentile(c, float(name[1:]))
    raise ValueError(f"unknown statistic {name}")


def seasonal_daily_cycle(series: DataFrame, names: list[str] | None = None, *, stat: str | None = "mean", min_days: int = 20, normalized: bool = False, freq: DataFrame | None = None) -> DataFrame:
    """(source, month, hour, variables, count). A cell has values if its first variable has more than min_days * (60 // step) of them; count is kept anyway.

    Dir is averaged as a number, and left out unless stat is mean or median. normalized: percent above the mean of all cells, without Dir, U and V.
    """
    stat = stat or "mean"
    names = names or variables(series)
    f = _stat(stat)
    kept = [n for n in names if n != "Dir" or stat in ("mean", "median")]
    cells = series.groupBy("source", F.month("time").alias("month"), F.hour("time").alias("hour")).agg(*(f(n).cast("double").alias(n) for n in kept), F.count(names[0]).alias("count"))
    freq = deduce_frequency(series, 200) if freq is None else freq
    good = F.col("count") > min_days * F.floor(60 / F.col("freq_min"))
    cells = cells.join(freq, "source").withColumns({n: F.when(good, F.col(n)) for n in kept})
    if normalized:
        kept = [n for n in kept if n not in ("Dir", "U", "V")]
        whole = Window.partitionBy("source")
        cells = cells.withColumns({n: 100 * (F.try_divide(F.col(n), F.avg(n).over(whole)) - 1) for n in kept})
    return cells.select("source", "month", "hour", *kept, "count")


def cycle_pairs(series: DataFrame, ref: str, names: list[str] | None = None, *, stat: str = "mean", normalized: bool | str = "all", min_days: int = 20) -> DataFrame:
    """Pairs {var}[_norm][_{stat}]_mthhr over cells that both have, and _mth and _hr over the means by month and by hour; normalized `all` gives both forms."""
    if normalized == "all":
        one, two = (cycle_pairs(series, ref, names, stat=stat, normalized=n, min_days=min_days) for n in (False, True))
        return one.unionByName(two)
    cells = seasonal_daily_cycle(series, names, stat=stat, min_days=min_days, normalized=bool(normalized))
    kept = [c for c in cells.columns if c not in ("source", "month", "hour", "count")]
    values = F.array(*(F.struct(F.lit(n).alias("base"), F.col(n).alias("x")) for n in kept))
    # a cell counts for itself if all of its variables have a value; the means take what there is
    whole = F.lit(True)
    for n in kept:
        whole = whole & F.col(n).isNotNull()
    long = cells.select("source", "month", "hour", whole.alias("whole"), F.inline(values))
    parts = [long.where("whole").select("source", "base", "month", "hour", "x", F.lit("_mthhr").alias("kind"))]
    for kind, by in (("_mth", "month"), ("_hr", "hour")):
        other = "hour" if by == "month" else "month"
        parts.append(long.groupBy("source", "base", by).agg(F.avg("x").alias("x")).withColumns({other: F.lit(-1), "kind": F.lit(kind)}).select(*parts[0].columns))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = ["kind", "base", "month", "hour"]
    left = rows.where(F.col("source") == ref).select(*keys, F.col("x").alias("ref"))
    both = rows.where(F.col("source") != ref).join(left, keys)
    middle = ("_norm" if normalized else "") + ("" if stat == "mean" else "_" + stat)
    return as_pairs(both.select("source", F.concat("base", F.lit(middle), "kind").alias("var"), "base", "ref", F.col("x").alias("new")))


def compare_seasonal_daily_cycle(series: DataFrame, ref: str, names: list[str] | None = None, *, stat: str = "mean", normalized: bool | str = "all", min_days: int = 20, **options) -> DataFrame:
    """Metrics of the pairs of cycle_pairs."""
    rows = cycle_pairs(series, ref, names, stat=stat, normalized=normalized, min_days=min_days)
    return compare_stats(rows.drop("weight"), base=F.col("base"), **options)

