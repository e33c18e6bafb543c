"""Ramps (steps from one time to the next) and noise (deviation from the neighbours' mean, smoothed), on the regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrine.functions.wind import wrap180_closed

from .align import pairs, regularize, time_match_sources, variables
from .cycles import compare_seasonal_daily_cycle
from .stats import as_pairs, compare_stats
from .windows import CHUNK, chunked, frame

#: Fixed value: minutes beyond which a series is too coarse for ramps and noise.
COARSEST = 3600


def ramps(series: DataFrame, names: list[str] | None = None, *, freq_min: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(source, time, {var}-ramp): differences to the value one step before; rows with any missing are left out; directions go the short way round."""
    names = names or variables(series)
    grid = regularize(series.select("source", "time", *names), freq_min).where(F.col("freq_min") <= COARSEST)
    rows = chunked(grid, "index", ["source"], 1, chunk)
    before = Window.partitionBy("source", "chunk").orderBy("index")
    out = {}
    for n in names:
        step = F.col(n) - F.lag(n).over(before)
        out[f"{n}-ramp"] = wrap180_closed(step) if n == "Dir" else step
    made = rows.select("source", "time", "own", *(v.alias(k) for k, v in out.items())).where("own")
    return made.drop("own").na.drop("any", subset=list(out))


def noise(series: DataFrame, names: list[str] | None = None, *, inner: int = 3, outer: int = 12, fill: float | str | None = None, freq_min: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(source, time, {var}-noise): |x - mean of `inner` around it| (one may be missing), averaged over `outer` around it (half may be missing), at every time of the grid. fill: a number, or `mean`, for what stays missing."""
    names = names or variables(series)
    grid = regularize(series.select("source", "time", *names), freq_min).where(F.col("freq_min") <= COARSEST)
    rows = chunked(grid, "index", ["source"], inner + outer, chunk)
    near, far = frame(["source"], "index", -(inner // 2), inner - 1 - inner // 2), frame(["source"], "index", -(outer // 2), outer - 1 - outer // 2)
    raw = rows.withColumns({f"{n}-raw": F.abs(F.col(n) - F.when(F.count(n).over(near) >= inner - 1, F.avg(n).over(near))) for n in names})
    out = raw.withColumns({f"{n}-noise": F.when(F.count(f"{n}-raw").over(far) >= outer // 2, F.avg(f"{n}-raw").over(far)) for n in names})
    out = out.where("own").select("source", "time", *(f"{n}-noise" for n in names))
    if fill is None:
        return out
    if fill == "mean":
        means = out.groupBy("source").agg(*(F.avg(f"{n}-noise").alias(f"{n}-mean") for n in names))
        out = out.join(means, "source")
        return out.select("source", "time", *(F.coalesce(f"{n}-noise", f"{n}-mean").alias(f"{n}-noise") for n in names))
    return out.na.fill(float(fill), subset=[f"{n}-noise" for n in names])


def least_steps() -> Column:
    """Rows that a comparison needs, by var."""
    return F.when(F.col("var").endswith("-ramp"), 10).otherwise(2)


def change_pairs(made: DataFrame, ref: str) -> DataFrame:
    """Pairs of ramps or noise at times that all have; the variable that they are of is the base."""
    rows = pairs(time_match_sources(made), ref)
    return as_pairs(rows.withColumn("base", F.regexp_replace("var", "-(ramp|noise)$", "")))


def _compare(made: DataFrame, ref: str, cycle: bool, options: dict) -> DataFrame:
    out = compare_stats(change_pairs(made, ref).drop("weight"), base=F.col("base"), least=least_steps(), **options)
    return out.unionByName(compare_seasonal_daily_cycle(time_match_sources(made), ref)) if cycle else out


def compare_ramps(series: DataFrame, ref: str, names: list[str] | None = None, *, cycle: bool = False, **options) -> DataFrame:
    """Metrics of ramps; variables with fewer than 10 have none."""
    return _compare(ramps(series, names), ref, cycle, options)


def compare_noise(series: DataFrame, ref: str, names: list[str] | None = None, *, cycle: bool = False, **options) -> DataFrame:
    return _compare(noise(series, names), ref, cycle, options)
