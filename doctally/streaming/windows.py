"""Event-time windows; each works on a batch and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as a timestamp with zone, and a watermark if they are a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def tumbling(events: DataFrame, width: str) -> DataFrame:
    out = events.groupBy(F.window("ts", width).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("_w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    out = events.groupBy(F.window("ts", width, step).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("_w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("_w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("_w.start").alias("start"), "n")
