"""Job stage events: latest stage per job and window, and stalled jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress_by_window(events: DataFrame, width: str = "1 day", stalled_below: float = 100.0) -> DataFrame:
    """Latest stage and progress of each job in each window; the same for batch and stream.

    A job is stalled in a window when its progress moved by nothing and is not complete.
    """
    last = F.max(F.struct("ts", "seq", "stage", "progress"))
    return events.groupBy(F.window("ts", width).alias("w"), "job_id").agg(
        last.alias("l"), F.min("progress").alias("lo"), F.max("progress").alias("hi"), F.count(F.lit(1)).alias("events")
    ).select(
        F.col("w.start").alias("window_start"), "job_id", F.col("l.stage").alias("stage"), F.col("l.progress").alias("progress"), "events",
        ((F.col("lo") == F.col("hi")) & (F.col("hi") < stalled_below)).alias("stalled"),
    )


def stream_job_progress(events: DataFrame, root: str, delay: str = "1 day", width: str = "1 day"):
    """Run the windows as an append stream into parquet under ``root``; windows close at the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        progress_by_window(timed, width).writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/progress").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
