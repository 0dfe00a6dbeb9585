"""Event-time windows. Each works on a batch frame and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """ts as a timestamp with a watermark; rows later than that are dropped by stateful operators."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _counted(events: DataFrame, window) -> DataFrame:
    x = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return x.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", "value")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return _counted(events, F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _counted(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    x = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return x.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")
