"""Incremental counts for the co-occurrence index: an extension for event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(window, event_type, n)`` of ``events(event_id, ts, event_type)``, each event once; works on streams and tables."""
    once = events.withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", window).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"))
