"""Registered streaming queries over the event table, checked against batch SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from acreage.plans import views as v
from acreage.plans.business import _DECIDED
from acreage.plans.sql import with_views
from acreage.session import fresh_folder
from acreage.sources.tables import read_table
from acreage.streaming.bookings import last_states, stream_plot_state
from acreage.streaming.jobs import progress_by_window, stream_job_progress

ARRIVALS = 6
#: Events a file of an arrival holds, about.
FILE_EVENTS = 250_000
#: More than two arrivals apart: the latest event of one and the earliest of the next.
DELAY = "11 days"


def _arrivals(s, d, root):
    """The event table as arrivals one after the other, five days each; a fifth of the events comes one arrival late.

    Every arrival has as many files, which one micro-batch reads, so the number of micro-batches does not grow with the table.
    A last file holds one event that is no command and no stage of a job, far enough ahead for the watermark to pass all others.
    """
    events = read_table(s, d, "events")
    first = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    span = (F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))) / ARRIVALS + 1
    late = F.when(F.col("event_id") % 5 == 2, 1).otherwise(0)
    lo, step, n = first.select(F.unix_timestamp(F.col("first").cast("timestamp")), span, "n").first()
    files = max(1, math.ceil(n / ARRIVALS / FILE_EVENTS))
    arrival = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - lo) / step) + late
    for i in range(ARRIVALS + 1):
        events.filter(arrival == i).repartition(files, "event_id").write.mode("append").parquet(f"{root}/arrivals")
    close = first.select((F.col("last").cast("timestamp") + F.expr(f"INTERVAL {DELAY}") + F.expr("INTERVAL 2 days")).cast(events.schema["ts"].dataType).alias("ts"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name != "ts"]
    close.select("ts", *blank).select(*events.columns).write.mode("append").parquet(f"{root}/arrivals")
    return s.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/arrivals")


def _plot_state(s, d):
    root = fresh_folder(s, "plot-state")
    stream_plot_state(v.commands_of(_arrivals(s, d, root)), root, DELAY).awaitTermination()
    return last_states(s, root)


def _stages(events):
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress")
    )


def _progress(s, d):
    """Windows as the stream put them out."""
    root = fresh_folder(s, "job-progress")
    stream_job_progress(_stages(_arrivals(s, d, root)), root, DELAY).awaitTermination()
    return s.read.parquet(f"{root}/progress").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _progress_batch(s, d):
    events = _stages(s.read.parquet(f"{d}/events.parquet"))
    return progress_by_window(events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {"stream_plot_state": _plot_state, "stream_job_progress": _progress, "job_progress": _progress_batch}

_WINDOWS = """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id AS job_id, arg_max(event_type, (ts, event_id)) AS stage, arg_max(value, (ts, event_id)) AS progress,
  count(*) AS events, min(value) = max(value) AND max(value) < 100 AS stalled FROM events GROUP BY 1, 2"""

ORACLE = {
    "stream_plot_state": with_views(
        "SELECT plot_id, arg_max(state_after, (ts, seq)) AS status, count(*) AS commands, count(*) FILTER (NOT accepted) AS rejected FROM decided GROUP BY 1",
        "v_commands", extra=_DECIDED),
    "stream_job_progress": _WINDOWS,
    "job_progress": _WINDOWS,
}
