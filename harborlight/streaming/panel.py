"""Streaming counterparts of the panel: windowed counts with a watermark, and duplicates dropped within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """(window_start, keys, n) by tumbling windows; rows later than the watermark are left out. late=None keeps a watermark set before. Batch input works alike."""
    w = F.window(F.col(time), window)
    source = events.withWatermark(time, late) if events.isStreaming and late else events
    return source.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def once(events: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Events delivered again within the watermark count once."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
