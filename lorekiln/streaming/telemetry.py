"""Windowed telemetry over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rollup(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and mean value by event type and window of ``ts``; events later than ``late`` no longer count. Works on a
    batch table as on a stream."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = g.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
