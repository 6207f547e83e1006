"""Counts over windows of event time; the same functions serve tables and streams (with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, at: str, late: str | None) -> DataFrame:
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, late) if late else stamped


def tumbling(events: DataFrame, at: str, width: str, key: str, value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events and mean value for each key and window; sliding windows if slide is given."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = _timed(events, at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.avg(value).alias("mean_value"))
    return out.select(key, F.unix_micros(F.col("w.start")).alias("window_start_us"), "events", "mean_value")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of each key, which end after a gap without events."""
    out = _timed(events, at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
