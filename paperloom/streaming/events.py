"""Task events as a stream: duplicate-free log, numbered log with a bounded tail, state by task, event-time counts, cancellation.

State is bounded: repeats are dropped within the watermark, a task keeps its number and the last events alone, and a task without
events for ``idle`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_log(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeated deliveries; state is dropped once the watermark has passed."""
    return events.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["task_id", "id"])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and event-time window, late ones counted until the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def task_states(events: DataFrame) -> DataFrame:
    """Last event, progress and number of events of each task; works on streams (complete or update mode) and tables."""
    return events.groupBy("task_id").agg(F.max_by("type", "id").alias("state"), F.max("progress").alias("progress"), F.max("id").alias("last_id"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what there is and ends; batches are written once each."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def numbered_log(events: DataFrame, keep: int = 100, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Events (task_id, type, message) as an append-only log with numbers that rise by one per task, each with the numbers of the last ``keep``
    events its task still holds (for replay after a number)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def number(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for kind, message in zip(pdf["type"], pdf["message"]):
                last += 1
                out.append((key[0], last, kind, message, max(1, last - keep + 1)))
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["task_id", "id", "type", "message", "first_kept"])

    return events.select("task_id", "type", "message").groupBy("task_id").applyInPandasWithState(
        number, "task_id string, id long, type string, message string, first_kept long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def not_cancelled(events: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Events of tasks that are not cancelled: a stream against a table of task ids, read again with every batch."""
    return events.join(cancelled.select("task_id").distinct(), "task_id", "left_anti")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n): events of a user without a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
