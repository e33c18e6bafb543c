"""Frames over a regular grid without one task for each series: the grid is cut into chunks, and each chunk borrows the rows next to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a chunk.
CHUNK = 1 << 16


def chunked(df: DataFrame, index: str, keys: list[str], halo: int, chunk: int = CHUNK) -> DataFrame:
    """df with `chunk`, and `own`: false for rows lent to a neighbouring chunk because they lie within `halo` steps of it."""
    at, c = F.col(index), F.floor(F.col(index) / chunk)
    inside = at - c * chunk
    targets = F.array_compact(F.array(c, F.when(inside < halo, c - 1), F.when(inside >= chunk - halo, c + 1)))
    lent = df.withColumn("chunk", F.explode(targets))
    return lent.withColumn("own", F.col("chunk") == F.floor(F.col(index) / chunk))


def frame(keys: list[str], index: str, low: int, high: int):
    return Window.partitionBy(*keys, "chunk").orderBy(index).rowsBetween(low, high)
