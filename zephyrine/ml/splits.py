"""Ordered splits and folds, as columns; nothing is shuffled."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrine.sources.series import number


def holdout_split(df: DataFrame, share: float = 0.3, time: str = "time") -> DataFrame:
    """df with row (by time, from 0) and part: `test` for the last ceil(share x n) rows, `train` before."""
    n = df.count()
    test = math.ceil(share * n)
    return number(df, time, "row").withColumn("part", F.when(F.col("row") >= n - test, "test").otherwise("train"))


def timeseries_folds(df: DataFrame, splits: int = 8, time: str = "time") -> DataFrame:
    """A row for each fold (from 0) that a row is in: fold i tests the i-th of the last `splits` stretches of n // (splits + 1) rows and trains on all before. ValueError with too few rows."""
    n = df.count()
    size = n // (splits + 1)
    if size == 0:
        raise ValueError(f"{n} rows for {splits} splits")
    rows = number(df, time, "row").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    begin = n - (splits - F.col("fold")) * size
    part = F.when(F.col("row") < begin, "train").when(F.col("row") < begin + size, "test")
    return rows.withColumn("part", part).where("part is not null")


def kfold_folds(df: DataFrame, splits: int = 8, time: str = "time") -> DataFrame:
    """df with row and fold: the contiguous stretch in which a row is tested; the first n % splits folds have one row more."""
    n = df.count()
    if n < splits:
        raise ValueError(f"{n} rows for {splits} splits")
    size, more = divmod(n, splits)
    row, edge = F.col("row"), more * (size + 1)
    fold = F.when(row < edge, F.floor(row / (size + 1))).otherwise(more + F.floor((row - edge) / size))
    return number(df, time, "row").withColumn("fold", fold.cast("int"))
