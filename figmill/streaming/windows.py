"""Streams (an extension: the figure pipeline itself is a batch).

The functions take a batch or a stream, so a stream's result can be checked
against the batch over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, sum and greatest value per window and key; rows later than ``late`` are left out of a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")).select(F.col("w.start").alias("window_start"), key, "n", "total", "top")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of events of a key without a longer pause."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "n")


def first_of_each(rows: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key once; a stream forgets keys older than the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
