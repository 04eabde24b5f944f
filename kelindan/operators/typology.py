"""Accounts in relation to groups: reply validation, association scores, winners, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelindan.functions.normalize import lossy_id_key
from kelindan.operators.evidence import band_pairs


def with_parent(comments: DataFrame, lossy: bool = False) -> DataFrame:
    """Replies with their parent's author, video and time, null where the parent isn't there.

    With ``lossy`` a parent id that lost digits finds its parent by the
    rounded id, if exactly one comment of the same video has it.
    """
    parent = comments.select(F.col("comment_id").alias("parent_comment_id"), F.col("username").alias("p_user"), F.col("video").alias("p_video"), F.col("ts").alias("p_ts"))
    out = comments.where("parent_comment_id is not null").join(parent, "parent_comment_id", "left").withColumn("match", F.when(F.col("p_video").isNotNull(), "exact"))
    if not lossy:
        return out
    rounded = parent.groupBy(lossy_id_key(F.col("parent_comment_id")).alias("_k"), F.col("p_video").alias("video")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("p_user").alias("q_user"), F.min("p_ts").alias("q_ts")
    ).where("_n = 1 and _k is not null").drop("_n")
    both = out.withColumn("_k", F.when(F.col("match").isNull(), lossy_id_key(F.col("parent_comment_id")))).join(rounded, ["_k", "video"], "left")
    hit = F.col("match").isNull() & F.col("q_ts").isNotNull()
    return both.withColumns({
        "p_user": F.when(hit, F.col("q_user")).otherwise(F.col("p_user")), "p_ts": F.when(hit, F.col("q_ts")).otherwise(F.col("p_ts")),
        "p_video": F.when(hit, F.col("video")).otherwise(F.col("p_video")), "match": F.when(hit, "rounded").otherwise(F.col("match")),
    }).drop("_k", "q_user", "q_ts")


def reply_status(parented: DataFrame, inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Replies with a status: the first that holds of unresolved parent, other video, other author, verified between the sides, other pair."""
    side = inside.select("username", F.lit("in").alias("s")).unionByName(outside.select("username", F.lit("out").alias("s")))
    a, b = side.withColumnRenamed("s", "_s"), side.withColumnsRenamed({"username": "p_user", "s": "_p"})
    joined = parented.join(a, "username", "left").join(b, "p_user", "left")
    status = (
        F.when(F.col("p_video").isNull(), "UNRESOLVED_PARENT")
        .when(~F.col("video").eqNullSafe(F.col("p_video")), "INVALID_PARENT_REFERENCE")
        .when(F.col("parent_user").isNotNull() & ~F.col("parent_user").eqNullSafe(F.col("p_user")), "PROBABLE_REPLY_REFERENCE")
        .when(F.col("_s") != F.col("_p"), "VERIFIED_DIRECT_REPLY")
        .otherwise("VALID_PARENT_OTHER_ACTOR_PAIR")
    )
    lag = F.when(F.col("p_ts").isNotNull(), (F.unix_micros("ts") - F.unix_micros("p_ts")) / 60e6)
    return joined.withColumns({"status": status, "lag_minutes": lag}).drop("_s", "_p")


def direct_pairs(replies: DataFrame) -> DataFrame:
    """Directed pairs of valid replies: counts, first and last time, lags, and whether the other direction exists."""
    valid = replies.where(F.col("status").isin("VERIFIED_DIRECT_REPLY", "VALID_PARENT_OTHER_ACTOR_PAIR") & F.col("username").isNotNull() & F.col("p_user").isNotNull())
    pairs = valid.groupBy("username", "p_user").agg(
        F.count(F.lit(1)).alias("n_replies"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.percentile("lag_minutes", 0.5).alias("median_lag"), F.min("lag_minutes").alias("min_lag"), F.max("lag_minutes").alias("max_lag"),
    )
    back = pairs.select(F.col("p_user").alias("username"), F.col("username").alias("p_user"), F.lit(True).alias("reciprocal"))
    return pairs.join(back, ["username", "p_user"], "left").withColumn("reciprocal", F.coalesce("reciprocal", F.lit(False)))


def shared_videos(outside_seen: DataFrame, group_seen: DataFrame) -> DataFrame:
    """``(username, hcc_id, shared)``: videos that an account and a group both commented on (A10). The group's videos are made distinct first."""
    groups = group_seen.select("hcc_id", "video").distinct()
    return outside_seen.select("username", "video").distinct().join(groups, "video").groupBy("username", "hcc_id").agg(F.count(F.lit(1)).alias("shared"))


def temporal_association(outside: DataFrame, group: DataFrame, minutes: int = 60) -> DataFrame:
    """``(username, hcc_id, temporal_comments, nearest, median_lag)``: comments that follow a group's comment on the video within the window; the median is that of the comments' medians."""
    a = group.where("ts is not null").select("video", "hcc_id", F.unix_micros("ts").alias("t0"))
    b = outside.where("ts is not null").select("video", "username", "comment_id", F.unix_micros("ts").alias("t1"))
    near = band_pairs(a, b, ["video"], "t0", "t1", minutes * 60_000_000).withColumn("lag", (F.col("t1") - F.col("t0")) / 60e6)
    each = near.groupBy("username", "hcc_id", "comment_id").agg(F.min("lag").alias("nearest"), F.percentile("lag", 0.5).alias("median"))
    return each.groupBy("username", "hcc_id").agg(F.count(F.lit(1)).alias("temporal_comments"), F.min("nearest").alias("nearest"), F.percentile("median", 0.5).alias("median_lag"))


def association_scores(direct: DataFrame, temporal: DataFrame, shared: DataFrame) -> DataFrame:
    """All associations of an account and a group, with strong = 3 direct + 2 temporal and contextual = strong + shared (A12). Inputs are keyed (username, hcc_id)."""
    keys = ["username", "hcc_id"]
    rows = (
        direct.select(*keys, F.col("direct"), F.lit(0).alias("temporal"), F.lit(0).alias("shared"))
        .unionByName(temporal.select(*keys, F.lit(0).alias("direct"), F.col("temporal_comments").alias("temporal"), F.lit(0).alias("shared")))
        .unionByName(shared.select(*keys, F.lit(0).alias("direct"), F.lit(0).alias("temporal"), F.col("shared")))
    )
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("direct", "temporal", "shared")])
    strong = 3 * F.col("direct") + 2 * F.col("temporal")
    return sums.withColumns({"strong": strong, "contextual": strong + F.col("shared")})


def primary_group(scores: DataFrame) -> DataFrame:
    """Each account's group by the first tier that has a score: direct, temporal, shared. Several winners leave no primary group.

    Columns (username, n_groups, tier, n_winners, primary_group, ambiguous, fractional_weight).
    """
    tops = scores.groupBy("username").agg(F.count(F.lit(1)).alias("n_groups"), *[F.max(c).alias(f"top_{c}") for c in ("direct", "temporal", "shared")])
    tier = F.when(F.col("top_direct") > 0, "direct").when(F.col("top_temporal") > 0, "temporal").when(F.col("top_shared") > 0, "shared").otherwise("none")
    joined = scores.join(tops.withColumn("tier", tier), "username")
    wins = F.when(F.col("tier") == "direct", F.col("direct") == F.col("top_direct")).when(F.col("tier") == "temporal", F.col("temporal") == F.col("top_temporal")).when(F.col("tier") == "shared", F.col("shared") == F.col("top_shared")).otherwise(False)
    out = joined.groupBy("username", "n_groups", "tier").agg(F.count_if(wins).alias("n_winners"), F.min(F.when(wins, F.col("hcc_id"))).alias("_w"))
    one = F.col("n_winners") == 1
    return out.select("username", "n_groups", "tier", "n_winners", F.when(one, F.col("_w")).alias("primary_group"), (F.col("n_winners") > 1).alias("ambiguous"), (1.0 / F.col("n_groups")).alias("fractional_weight"))


def crosstab(df: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts by row and named column values, with a Total row and a total column."""
    base = df.select(F.coalesce(F.col(row), F.lit("(none)")).alias(row), column)
    cells = [F.count_if(F.col(column) == c).alias(c) for c in columns]
    body = base.groupBy(row).agg(*cells, F.count_if(F.col(column).isin(*columns)).alias("total"))
    foot = base.agg(*cells, F.count_if(F.col(column).isin(*columns)).alias("total")).withColumn(row, F.lit("Total"))
    return body.unionByName(foot)


def group_mode(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent non-null value per group, the smallest of several (A5), by two mergeable aggregates."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(best, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(column).alias("mode"))


def overlap_audit(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """``(in_sets, n)``: how many keys lie in exactly which sets (A23), by one union and group."""
    rows = None
    for i, (_, df) in enumerate(sorted(sets.items())):
        one = df.select(F.col(key).alias("k"), F.lit(1 << i).alias("bit")).where("k is not null").distinct()
        rows = one if rows is None else rows.unionByName(one)
    names = F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) > 0, name) for i, name in enumerate(sorted(sets))])
    return rows.groupBy("k").agg(F.sum("bit").cast("int").alias("bits")).groupBy(F.array_join(F.array_compact(names), "+").alias("in_sets")).agg(F.count(F.lit(1)).alias("n"))


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows numbered within their group in a stated order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
