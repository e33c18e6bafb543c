"""Session defaults and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("zephyrine")
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "6g",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset; on {master or 'a cluster'} it must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="zephyrine-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df, name: str = "cut"):
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df):
    """df if it reads the same rows in the same order each time (files and what is computed of each row), else its cut."""
    return cut(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the driver runs in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
