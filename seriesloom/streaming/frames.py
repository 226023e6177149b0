"""Event-time frames and sessions; the same code serves batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less timestamps become instants (the session zone is UTC): watermarks need them."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def with_lateness(events: DataFrame, lateness: str | None, column: str = "ts") -> DataFrame:
    """Rows later than ``lateness`` behind the newest event are dropped."""
    events = event_time(events, column)
    return events.withWatermark(column, lateness) if lateness and events.isStreaming else events


def with_end(events: DataFrame, ends: DataFrame, column: str = "ts") -> DataFrame:
    """The events and, marked ``closing``, the times at which nothing is awaited any more (``ends`` has only the column
    ``column``). A time past the last frame plus the lateness moves the watermark over all that is still open."""
    ends = ends.select(F.col(column).cast(events.schema[column].dataType).alias(column), F.lit(True).alias("closing"))
    return events.withColumn("closing", F.lit(False)).unionByName(ends, allowMissingColumns=True)


def _sums(rows: DataFrame) -> list:
    counted = ~F.col("closing") if "closing" in rows.columns else F.lit(True)
    return [F.count_if(counted).alias("events"), F.sum(F.when(counted, F.col("value"))).alias("total")]


def sliding_frames(events: DataFrame, win: str, hop: str, lateness: str | None = "1 hour") -> DataFrame:
    """Count and sum per event type in overlapping frames (equal ``win`` and ``hop`` tumble).

    Rows marked ``closing`` (see ``with_end``) move the time on but are in no frame.
    """
    rows = with_lateness(events, lateness)
    out = rows.groupBy("event_type", F.window("ts", win, hop)).agg(*_sums(rows)).where("events > 0")
    return out.select("event_type", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "total")


def sessions(events: DataFrame, gap: str, lateness: str | None = "1 hour") -> DataFrame:
    """Per user: runs of events with less than ``gap`` of silence between them; ``closing`` rows as in ``sliding_frames``."""
    rows = with_lateness(events, lateness)
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(*_sums(rows)).where("events > 0")
    return out.select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "total"
    )
