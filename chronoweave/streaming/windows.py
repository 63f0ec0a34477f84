"""Streaming twins of batch windows, and per-session state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time with time zone, as watermarks need it."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return d.withWatermark(ts, late) if d.isStreaming else d


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and key; on a stream, rows later than ``late`` are dropped."""
    d = _timed(events, ts, late)
    w = d.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Start, end and size of each session of a key, closed after ``gap`` without a row."""
    d = _timed(events, ts, late)
    w = d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
