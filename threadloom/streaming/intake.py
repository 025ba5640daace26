"""Incremental intake: late rows, repeated rows, and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intake(stream: DataFrame, key: list[str], ts: str = "ts", late: str = "48 hours") -> DataFrame:
    """Rows once for each key, as long as a repeat is not later than the look-back."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def window_counts(rows: DataFrame, by: str, ts: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "48 hours") -> DataFrame:
    """(start, by, n) for tumbling windows, or sliding ones if `slide` is given; batch or stream."""
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(ts, length, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(rows: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", late: str = "48 hours") -> DataFrame:
    """(by, start, end, n) of runs of events with no gap as long as `gap`."""
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return marked.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
