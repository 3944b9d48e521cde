"""Event-time windows, a Spark feature that catalogs of events use: late rows are dropped beyond the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    got = timed(events)
    got = got.withWatermark("ts", late) if got.isStreaming else got
    got = got.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    got = timed(events)
    got = got.withWatermark("ts", late) if got.isStreaming else got
    return got.groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    got = timed(events)
    got = got.withWatermark("ts", late) if got.isStreaming else got
    got = got.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
