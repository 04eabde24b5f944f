"""Tag and time profiles of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_profile(seen: DataFrame, video_tags: DataFrame, members: DataFrame) -> DataFrame:
    """``(hcc_id, hashtag, frequency, n_videos, n_users_exposed)`` from (username, video), (video, tag) and (username, hcc_id) (H1, H6)."""
    pairs = seen.join(members, "username").select("hcc_id", "username", "video").distinct()
    rows = pairs.join(video_tags.select("video", F.col("tag").alias("hashtag")).distinct(), "video")
    videos = rows.groupBy("hcc_id", "hashtag", "video").agg(F.count(F.lit(1)).alias("_n")).groupBy("hcc_id", "hashtag").agg(F.count(F.lit(1)).alias("n_videos"))
    users = rows.groupBy("hcc_id", "hashtag", "username").agg(F.count(F.lit(1)).alias("_n")).groupBy("hcc_id", "hashtag").agg(F.count(F.lit(1)).alias("n_users_exposed"))
    return videos.join(users, ["hcc_id", "hashtag"]).select("hcc_id", "hashtag", F.col("n_videos").alias("frequency"), "n_videos", "n_users_exposed")


def ranked_tags(profile: DataFrame) -> DataFrame:
    """The profile with the rate per exposed account and two ranks within the group; ties go to the smaller tag (H2)."""
    rate = F.round(F.try_divide(F.col("frequency"), F.col("n_users_exposed")), 3)
    by = Window.partitionBy("hcc_id")
    return profile.withColumn("rate", rate).withColumns({
        "rank_frequency": F.row_number().over(by.orderBy(F.desc("frequency"), "hashtag")), "rank_exposed": F.row_number().over(by.orderBy(F.desc("n_users_exposed"), "hashtag")),
    })


def top_tags(profile: DataFrame, k: int) -> DataFrame:
    """The k most frequent tags of each group, with rank (H5); Spark keeps k rows a group already before the shuffle."""
    order = Window.partitionBy("hcc_id").orderBy(F.desc("frequency"), "hashtag")
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_summary(profile: DataFrame, k: int = 5) -> DataFrame:
    """``(hcc_id, n_tags, total, top_tag, top_list, dominant_share)`` (H3)."""
    totals = profile.groupBy("hcc_id").agg(F.count(F.lit(1)).alias("n_tags"), F.sum("frequency").alias("total"), F.max("frequency").alias("top"))
    tops = top_tags(profile, k).groupBy("hcc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hashtag"))).alias("a"))
    return totals.join(tops, "hcc_id").select("hcc_id", "n_tags", "total", F.col("a")[0]["hashtag"].alias("top_tag"), F.array_join(F.col("a.hashtag"), ";").alias("top_list"), F.round(F.try_divide("top", "total"), 3).alias("dominant_share"))


def matrix(profile: DataFrame, columns: Sequence[str], value: str = "frequency") -> DataFrame:
    """Groups by named tags, 0 where absent (H4)."""
    return profile.groupBy("hcc_id").pivot("hashtag", list(columns)).agg(F.coalesce(F.sum(value), F.lit(0))).na.fill(0)


def local_parts(ts: Column, zone: str = "Asia/Jakarta") -> tuple[Column, Column]:
    """Weekday 1..7 from Monday and hour of a UTC time in a zone."""
    local = F.from_utc_timestamp(ts, zone)
    return (F.weekday(local) + 1).alias("weekday_number"), F.hour(local).alias("hour_local")


def time_grid(comments: DataFrame, scope: str, zone: str = "Asia/Jakarta") -> DataFrame:
    """Comments, accounts, videos and share for each scope, weekday and hour: all 168 hours of every scope, 0 where nothing happened.

    ``scope`` names the column of the scope (a row of several scopes occurs once for each). Unreadable times are left out.
    """
    day, hour = local_parts(F.col("ts"), zone)
    given = comments.where("ts is not null").select(scope, day, hour, "username", "video")
    keys = [scope, "weekday_number", "hour_local"]
    counts = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_comments"), F.count_distinct("username").alias("n_accounts"), F.count_distinct("video").alias("n_unique_videos"))
    spark = comments.sparkSession
    hours = spark.range(168).select((F.col("id") / 24).cast("int").alias("d"), (F.col("id") % 24).cast("int").alias("hour_local")).select((F.col("d") + 1).alias("weekday_number"), "hour_local")
    domain = given.select(scope).distinct().crossJoin(F.broadcast(hours))  # 168 rows
    full = domain.join(counts, keys, "left").na.fill(0, ["n_comments", "n_accounts", "n_unique_videos"])
    total = F.sum("n_comments").over(Window.partitionBy(scope))
    return full.withColumn("share_percent", F.round(100.0 * F.col("n_comments") / total, 3))


def active_groups(comments: DataFrame, group: str, zone: str = "Asia/Jakarta") -> DataFrame:
    """Groups active in each weekday and hour: their number and sorted list (H11). Group and hour are reduced to distinct rows first."""
    day, hour = local_parts(F.col("ts"), zone)
    once = comments.where("ts is not null").select(day, hour, F.col(group).cast("bigint").alias("g")).where("g is not null").distinct()
    return once.groupBy("weekday_number", "hour_local").agg(F.count(F.lit(1)).alias("n_groups"), F.array_join(F.array_sort(F.collect_list("g")), ";").alias("groups"))


def group_rhythm(comments: DataFrame, group: str, zone: str = "Asia/Jakarta") -> DataFrame:
    """Each group's dominant hour, its share and the weekend share in percent (H12). Ties go to the earlier hour."""
    day, hour = local_parts(F.col("ts"), zone)
    hours = comments.where("ts is not null").select(group, day, hour).where(F.col(group).isNotNull()).groupBy(group, "hour_local").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weekday_number") >= 6).alias("w"))
    best = F.max(F.struct("n", (-F.col("hour_local")).alias("h")))
    return hours.groupBy(group).agg(F.sum("n").alias("n_comments"), best.alias("b"), F.sum("w").alias("w")).select(
        group, "n_comments", (-F.col("b.h")).alias("dominant_hour"), F.round(F.col("b.n") / F.col("n_comments"), 3).alias("concentration"), F.round(100.0 * F.col("w") / F.col("n_comments"), 3).alias("weekend_percent")
    )
