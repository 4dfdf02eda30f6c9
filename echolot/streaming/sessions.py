"""Streaming forms: an extension; the batch operators define the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_events(events: DataFrame, gap: str, late: str, time: str = "ts", by: str = "file") -> DataFrame:
    """W3 as session windows: events no further apart than gap become one."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")


def active_seconds(frames: DataFrame, on: float, window: str, late: str, time: str = "ts", by: str = "file", value: str = "prob") -> DataFrame:
    """A30 in tumbling windows: frames above the threshold."""
    return frames.withWatermark(time, late).groupBy(by, F.window(time, window).alias("w")).agg(F.count_if(F.col(value) > on).alias("n"), F.count("*").alias("of")).select(by, F.col("w.start").alias("start"), "n", "of")
