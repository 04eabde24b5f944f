"""Streaming counterparts of batch operators. An extension: nothing here is needed for parity.

Keys and states are bounded by watermarks; late rows beyond them are dropped by
definition, which the batch operators never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_crawls(comments: DataFrame, late: str = "2 days") -> DataFrame:
    """Comments once per id within the watermark (as C1)."""
    return comments.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["comment_id"])


def hourly_activity(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and value per hour and type (as H10), emitted when the hour is closed."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    )


def co_temporal_pairs(events: DataFrame, minutes: int = 9, late: str = "30 minutes") -> DataFrame:
    """Pairs of accounts on one video within the window (as C6): a stream-stream interval join whose state ends with the watermark."""
    a = events.select(F.col("video").alias("video"), F.col("username").alias("a"), F.col("ts").alias("ta")).withWatermark("ta", late)
    b = events.select(F.col("video").alias("video_b"), F.col("username").alias("b"), F.col("ts").alias("tb")).withWatermark("tb", late)
    near = (F.col("video") == F.col("video_b")) & (F.col("a") != F.col("b")) & (F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + F.expr(f"interval {minutes} minutes"))
    return a.join(b, near).select("video", F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "ta", "tb")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per account, closed after a gap."""
    return (
        events.withWatermark("ts", late).groupBy("username", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n")).select("username", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
