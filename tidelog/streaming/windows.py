"""Streaming counterparts of the windowed detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_volume_stream(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Closed hours of each template; later events are dropped by the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "template_text").agg(F.count("*").alias("n")).select("template_text", F.col("window.start").alias("start"), "n")


def error_window_stream(events: DataFrame, window: str = "60 seconds", lateness: str = "0 seconds") -> DataFrame:
    """Totals and errors of closed windows."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window)).agg(F.count("*").alias("total"), F.count_if(F.col("level").isin("error", "critical")).alias("errors")).select(F.col("window.start").alias("start"), "total", "errors")
