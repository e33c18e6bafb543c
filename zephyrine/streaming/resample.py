"""The resampling of series over a stream: tumbling windows with a watermark. Rolling statistics need rows on both sides and stay with batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_resample(rows: DataFrame, names: list[str], *, every: str = "1 hour", late: str = "2 hours", least: int = 0, time: str = "time") -> DataFrame:
    """(source, time, means, n) of a stream (source, time, variables). Rows later than `late` are dropped; a window is final, and its state is given up, once the watermark has passed it. Windows with fewer than `least` rows have nulls."""
    timed = rows.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    enough = F.count(F.lit(1)) >= least
    out = timed.groupBy("source", F.window("__t", every).alias("w")).agg(*(F.when(enough, F.avg(n)).alias(n) for n in names), F.count(F.lit(1)).alias("n"))
    return out.select("source", F.col("w.start").cast("timestamp_ntz").alias("time"), *names, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Write what is there to Parquet and stop; called again it goes on with what is new. Mode complete overwrites the result."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
