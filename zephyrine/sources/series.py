"""Reading and writing series."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from zephyrine.functions.wind import derive
from zephyrine.operators.reshape import add_level, drop_targets, level_interp, levels, nan_to_null, select_uv

TARGET_HEIGHT = 70.0
#: Variables at heights and without one; the units of the common variables.
AT_HEIGHTS, WITHOUT_HEIGHT, TARGETS = ("U", "V", "W", "T", "P", "RH", "SD"), ("RMOL", "UST", "PBLH", "HFX"), ("M", "Dir")
METADATA = {
    "M": {"long_name": "Wind speed", "units": "m/s"},
    "Dir": {"long_name": "Wind direction", "units": "degrees"},
    "U": {"long_name": "Zonal wind", "units": "m/s"},
    "V": {"long_name": "Meridional wind", "units": "m/s"},
    "power": {"long_name": "Wind power", "units": "kW"},
    "energy": {"long_name": "Wind energy", "units": "kWh"},
}


def csv_schema(heights: list[float], names=AT_HEIGHTS, *, targets: bool = False) -> T.StructType:
    columns = ["sample bigint", "time timestamp_ntz"] + [f"`{v}_{h:.2f}` double" for v in names for h in heights] + [f"{v} double" for v in (*WITHOUT_HEIGHT, *(TARGETS if targets else ()))]
    return T.StructType.fromDDL(", ".join(columns))


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header and a column time. Without a schema the header is read and all but sample and time are doubles, so that the data are scanned once. NaN becomes null."""
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(n, T.LongType() if n == "sample" else T.TimestampNTZType() if n == "time" else T.DoubleType()) for n in names])
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path))


def check_inputs(spark: SparkSession, folder: str, names: list[str]) -> None:
    """FileNotFoundError unless the folder and every file in it exist, in whatever store the path names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in (folder, *(os.path.join(folder, n) for n in names)):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            raise FileNotFoundError(path)


def dataset_build(df: DataFrame, *, targets: bool = False, only_uv: bool = True, height: float = TARGET_HEIGHT, wind: bool = True) -> DataFrame:
    """Features at all heights and at the target height, one row for each time; or the targets, with their height. wind adds M and Dir at the target height."""
    if targets:
        return add_level(df.select("time", *TARGETS), height)
    out = drop_targets(df)
    out = select_uv(out) if only_uv else out
    out = level_interp(out, height)
    out = out.toDF(*(_named(c) for c in out.columns)) if _renames(out) else out
    if wind:
        u, v = f"`U_{height}`", f"`V_{height}`"
        at = out.select("*", F.col(u).alias("U"), F.col(v).alias("V"))
        out = at.withColumns({f"M_{height}": derive(at, "M"), f"Dir_{height}": derive(at, "Dir")}).drop("U", "V")
    return out


def _named(column: str) -> str:
    variable, _, h = column.partition("_")
    try:
        return f"{variable}_{float(h)}"
    except ValueError:
        return column


def _renames(df: DataFrame) -> bool:
    names = [_named(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns of one variable and height")
    return names != df.columns


def get_train_x(spark: SparkSession, folder: str, **options) -> DataFrame:
    return dataset_build(read_series_csv(spark, f"{folder}/train.csv"), **options)


def get_test_x(spark: SparkSession, folder: str, **options) -> DataFrame:
    return dataset_build(read_series_csv(spark, f"{folder}/test.csv"), **options)


def get_train_y(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_build(read_series_csv(spark, f"{folder}/train.csv"), targets=True)


def frame_from_memory(spark: SparkSession, rows, schema) -> DataFrame:
    return nan_to_null(spark.createDataFrame(rows, schema))


def prepare_submission(df: DataFrame, time: str = "time") -> DataFrame:
    """sample (number by time, from 0), time, M and Dir, the latter two from U and V where they are not stored. ValueError without a time or wind.

    Rows are numbered within ranges of time and then offset, so no task holds the whole series.
    """
    if time not in df.columns:
        raise ValueError("a submission needs a time")
    ready = nan_to_null(df.select(F.col(time).cast("timestamp_ntz").alias("time"), derive(df, "M").alias("M"), derive(df, "Dir").alias("Dir")))
    return number(ready, "time", "sample")


def number(df: DataFrame, by: str, name: str, *, start: int = 0) -> DataFrame:
    """Rows numbered in order of a column: by its values' counts, so that a day's rows are numbered together and days are offset. Equal values are numbered in no set order."""
    from pyspark.sql import Window

    day = F.to_date(by)
    counts = df.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__day", F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = df.withColumn("__day", day).withColumn("__i", F.row_number().over(Window.partitionBy("__day").orderBy(by)))
    # a row for each day of the calendar: some ten thousand at most
    return rows.join(F.broadcast(before), rows["__day"].eqNullSafe(before["__day"])).select((F.col("__before") + F.col("__i") - 1 + start).alias(name), *df.columns)


def write_parquet(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").parquet(path, **options)


def heights_of(df: DataFrame) -> list[float]:
    return sorted({h for x in levels(df).values() for h in x})


def get_logger(name: str, path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, with a path, to a file; asked for again it is the same."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not logger.handlers:
        for handler in (logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            logger.addHandler(handler)
    return logger
