"""Windows over a stream of readings. An addition: the batch operators have no streaming counterpart elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(readings: DataFrame, thick: str, step: str, late: str) -> DataFrame:
    """Sum and count of absolute values in sliding windows of event time, by event_type."""
    windows = F.window("ts", thick, step)
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(windows.alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.abs("value")), 6).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(readings: DataFrame, gap: str, late: str) -> DataFrame:
    """Readings of a profile in sessions that a gap ends."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
