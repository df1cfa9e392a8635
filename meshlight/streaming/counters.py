"""Event-time counters over a stream of device events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"


def windowed_counters(events: DataFrame, length: str = "24 hours", slide: str | None = None) -> DataFrame:
    """Counts per device and window of (device_id, ts, type, severity); late rows within an hour
    still count. In append mode a window is emitted once, when it can no longer change."""
    kind, severity = F.col("type"), F.col("severity")
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = (
        events.withWatermark("ts", LATENESS)
        .groupBy("device_id", window.alias("w"))
        .agg(
            F.count_if(severity == "critical").alias("critical"),
            F.count_if(severity == "warning").alias("warning"),
            F.count_if(kind == "connection_lost").alias("connection_lost"),
            F.count(F.lit(1)).alias("total"),
        )
    )
    return counted.select("device_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                          "critical", "warning", "connection_lost", "total")
