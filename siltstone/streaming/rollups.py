"""Streaming counterparts of the ledger operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, value: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Count and sum of a stream by tumbling windows; rows later than lateness behind the newest are left out."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def once(events: DataFrame, key: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Count of each user's sessions' rows; a session ends after gap without a row."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.col(user), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
