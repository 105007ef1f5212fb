"""Booking command stream: decisions in event-time order from keyed state, and current plot states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from acreage.operators import bookings as B

DECIDED = "seq long, {} plot_id {}, command string, patch_status string, state_before string, accepted boolean, state_after string"
#: A plot's state and the commands that wait for the watermark, in order of their time.
_STATE = "status string, at array<long>, seq array<long>, command array<string>, patch array<string>, after array<string>"


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold the plot's commands until the watermark has passed them, then decide them by (ts, seq); a repeated command counts once."""
    status, *waiting = state.get if state.exists else ("AVAILABLE", [], [], [], [], [])
    held = {row[1]: row for row in zip(*waiting)}
    for batch in batches:
        texts = [[v if isinstance(v, str) else None for v in batch[c]] for c in ("command", "patch_status", "state_after")]
        for row in zip(batch["at"].tolist(), batch["seq"].tolist(), *texts):
            held.setdefault(row[1], row)
    rows = sorted(held.values(), key=lambda r: r[:2])
    passed = state.getCurrentWatermarkMs() * 1000
    ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
    out = []
    for at, seq, command, patch, after in ready:
        accepted = not (command == "book" and status == "BOOKED")
        out.append((seq, at, key[0], command, patch, status, accepted, after))
        status = after
    state.update((status, *([list(c) for c in zip(*rest)] if rest else [[] for _ in range(5)])))
    if rest:
        state.setTimeoutTimestamp(rest[0][0] // 1000 + 1)
    if out:
        yield pd.DataFrame(out, columns=["seq", "at", "plot_id", "command", "patch_status", "state_before", "accepted", "state_after"])


def decisions(commands: DataFrame, delay: str = "1 day") -> DataFrame:
    """Every command of the stream with the state before and after it, once the watermark has passed it.

    State is kept by plot, in Spark's state store: its status and the commands that still wait. A command that comes up to ``delay``
    late is decided in its place, so the decisions are those of ``replay_bookings``; later ones are dropped, like repeats. Events that
    are no command only move the watermark. A micro-batch touches the plots it has commands or due timers for. Further columns of
    ``commands`` can be joined by seq.
    """
    timed = commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # the state names ts, so the filter stays above the watermark, which all events move
    named = F.when(F.col("ts").isNotNull() & F.col("seq").isNotNull(), B.state_after(F.col("command"), F.col("patch_status")))
    moves = timed.withColumn("state_after", named).filter(F.col("state_after").isNotNull())
    typed = moves.select("ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "plot_id", "command", "patch_status", "state_after")
    schema = DECIDED.format("at long,", commands.schema["plot_id"].dataType.simpleString())
    decided = typed.groupBy("plot_id").applyInPandasWithState(_decide, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def stream_plot_state(commands: DataFrame, root: str, delay: str = "1 day"):
    """Start the stream over all available commands; returns the running query. Decisions are appended to ``root/decisions``."""
    return (
        decisions(commands, delay).writeStream.outputMode("append").format("parquet").option("path", f"{root}/decisions")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )


def last_states(spark: SparkSession, root: str, plot_id: str = "long") -> DataFrame:
    """Current state of each plot, from the decisions so far; ``plot_id`` is the type of that column."""
    return B.final_states(spark.read.schema(DECIDED.format("ts timestamp,", plot_id)).parquet(f"{root}/decisions"))
