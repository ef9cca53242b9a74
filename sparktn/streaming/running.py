"""A tensor that events add to: Structured Streaming with a watermark, a window of event time as the first axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, coordinates: list[str], value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, the coordinates and v; works on a stream and on a table alike."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", window).alias("w"), *coordinates).agg(F.sum(value).alias("v"))
    return grouped.select(F.col("w.start").alias("start"), *coordinates, "v")
