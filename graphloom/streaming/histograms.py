"""Windowed event-type histograms of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_histogram(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and event type; events later than `late` behind the newest are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
