"""Coordination evidence between accounts: shared items, replies and nearness in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelindan.functions.normalize import account, utc_time
from kelindan.operators.quantiles import exact_quantile
from kelindan.operators.textsim import packed_blocks
from kelindan.session import stage


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (P9); state a total order for a defined result. Null keys form a group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order`` (P9); nulls in the order come before all values."""
    return keep_first(df, keys, [c.desc_nulls_last() for c in order])


def keep_first_of_few(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``keep_first`` on one key that seldom repeats: only the keys are counted, and only rows of repeated ones are ordered. Rows without a key are dropped.

    The repeated keys are staged, so the planner knows their size.
    """
    given = df.where(F.col(key).isNotNull())
    again = stage(given.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    return given.join(again, key, "left_anti").unionByName(keep_first(given.join(again, key, "left_semi"), [key], order))


def prepare_comments(df: DataFrame, few: bool = False) -> DataFrame:
    """Comments once per id (first crawl), with account names normalised and time in UTC.

    The first crawl is the least (crawled_at, source_file, text). Rows without an id are dropped. With ``few``, repeated ids are found first.
    """
    order = [F.col("crawled_at"), F.col("source_file"), F.coalesce("text", F.lit(""))]
    first = keep_first_of_few(df, "comment_id", order) if few else keep_first(df.where("comment_id is not null"), ["comment_id"], order)
    return first.select(
        "comment_id", account(F.col("username")).alias("username"), account(F.col("parent_user")).alias("parent_user"), F.col("video_url").alias("video"),
        utc_time(F.col("comment_timestamp")).alias("ts"), F.coalesce("text", F.lit("")).alias("text"), "product_category", "source_file", "parent_comment_id", "video_id",
    ).withColumn("is_reply", F.col("parent_user").isNotNull())


def remaining_accounts(comments: DataFrame, *others: DataFrame) -> DataFrame:
    """Accounts that comment and belong to none of ``others`` (each with ``username``)."""
    left = comments.where("username is not null").select("username").distinct()
    for o in others:
        left = left.join(o.select("username"), "username", "left_anti")
    return left


def incidence(comments: DataFrame) -> DataFrame:
    """Distinct (username, video)."""
    return comments.where("username is not null and video is not null").select("username", "video").distinct()


def canonical(a: Column, b: Column) -> list[Column]:
    """An unordered pair as (source, target), the smaller in code-point order first (G1)."""
    return [F.least(a, b).alias("source"), F.greatest(a, b).alias("target")]


def _ranked(seen: DataFrame, least: int) -> DataFrame:
    """Distinct ``seen`` (username, video) with ``skip``: whether the video is among the account's ``least - 1`` most popular, in one order of all videos. Staged."""
    popularity = seen.groupBy("video").agg(F.count(F.lit(1)).alias("_p"))
    rank = F.row_number().over(Window.partitionBy("username").orderBy(F.desc("_p"), F.desc("video")))
    return stage(seen.join(popularity, "video").select("username", "video", (rank < least).alias("skip")), "ranked")


def _skipped(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(source, target, video)``: the common videos of given pairs that one or both of the accounts skip. A pair is looked up by its few skipped videos, not by all of an account."""
    pairs, few = pairs.select("source", "target"), ranked.where("skip").select("username", "video")
    mine = pairs.join(few.withColumnRenamed("username", "source"), "source").join(ranked.select(F.col("username").alias("target"), "video"), ["target", "video"])
    theirs = pairs.join(few.withColumnRenamed("username", "target"), "target").join(ranked.where("not skip").select(F.col("username").alias("source"), "video"), ["source", "video"])
    return mine.select("source", "target", "video").unionByName(theirs.select("source", "target", "video"))


def co_conv(seen: DataFrame, left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """``(source, target, co_conv_weight)``: pairs of a left and a right account with at least ``least`` common videos.

    Each account's ``least - 1`` most popular videos are not indexed: a pair with ``least`` common
    videos still shares one that both index (the rarest of them at the latest). So the accounts of a hot video
    aren't paired for being there, and an account with fewer than ``least`` videos pairs with none. The
    pairs that meet are counted where they meet, and their skipped videos are looked up. An account on both sides pairs with the others once.
    """
    ranked = _ranked(seen, least)
    sides = left.select("username", F.lit(1).alias("s")).unionByName(right.select("username", F.lit(2).alias("s"))).groupBy("username").agg(F.bit_or("s").alias("s"))
    kept = ranked.where("not skip").join(sides, "username")
    a = kept.where("s & 1 > 0").select(F.col("username").alias("a"), "video", F.col("s").alias("sa"))
    b = kept.where("s & 2 > 0").select(F.col("username").alias("b"), "video", F.col("s").alias("sb"))
    # a pair of two accounts that are both on both sides meets in either order
    met = a.join(b, "video").where("a <> b and (a < b or sa <> 3 or sb <> 3)").groupBy(*canonical(F.col("a"), F.col("b"))).agg(F.count(F.lit(1)).alias("n"))
    met = stage(met, "met")
    every = met.unionByName(_skipped(met, ranked).select("source", "target", F.lit(1).cast("long").alias("n")))
    return every.groupBy("source", "target").agg(F.sum("n").alias("co_conv_weight")).where(F.col("co_conv_weight") >= least)


def shared_items(seen: DataFrame, least: int = 3, block: int = 2048) -> DataFrame:
    """``co_conv`` of all accounts with all, for ``seen`` (username, video) distinct and staged.

    Where accounts would meet more often than there are pairs of accounts, each pair is taken once: two blocks of accounts
    at a time, whose common items are a product of two matrices of zeros and ones. Only pairs of the result leave a task.
    """
    popularity = seen.groupBy("video").agg(F.count(F.lit(1)).alias("p"))
    meetings = popularity.agg(F.sum(F.col("p").cast("double") * (F.col("p") - 1)).alias("n")).first().n or 0.0
    accounts = seen.select("username").distinct().count()
    if meetings <= accounts * (accounts - 1):
        every = seen.select("username").distinct()
        return co_conv(seen, every, every, least)
    some = max(1, min(block, accounts // 16))
    vectors = seen.select(F.col("username").alias("text_id"), F.col("video").alias("gram"), F.lit(1).alias("df"), F.lit(1.0).alias("w"))
    held = stage(packed_blocks(vectors, some), "blocks")
    one, two = (held.select(*[F.col(c).alias(f"{c}{k}") for c in ("b", "ids", "sizes", "g")]) for k in (1, 2))
    one = one.repartition(max(1, min(256, accounts // some)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sizes, g = ([np.frombuffer(batch.column(f"{c}{k}")[r].as_buffer(), dtype=t) for k in (1, 2)] for c, t in (("sizes", np.int32), ("g", np.int64)))
                same = batch.column("b1")[r].as_py() == batch.column("b2")[r].as_py()
                terms, at = np.unique(np.concatenate(g), return_inverse=True)
                at = (at[: len(g[0])], at[len(g[0]) :])
                row = [np.repeat(np.arange(len(x)), x) for x in sizes]
                counts = np.zeros((len(sizes[0]), len(sizes[1])), dtype=np.float32)  # exact below 2^24
                for low in range(0, len(terms), 2048):
                    wide = min(2048, len(terms) - low)
                    halves = []
                    for x, i, n in zip(at, row, sizes, strict=True):
                        half, here = np.zeros((len(n), wide), dtype=np.float32), (x >= low) & (x < low + wide)
                        half[i[here], x[here] - low] = 1.0
                        halves.append(half)
                    counts += halves[0] @ halves[1].T
                for low in range(0, len(counts), 128):
                    part = counts[low : low + 128]
                    i, j = np.nonzero(part >= least)
                    if same:
                        i, j = i[j > i + low], j[j > i + low]
                    ids = [batch.column(f"ids{k}")[r].values.take(pa.array(x)) for k, x in ((1, i + low), (2, j))]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(part[i, j].astype(np.int64))], names=["a", "b", "n"])

    kind = seen.schema["username"].dataType.simpleString()
    found = one.join(two, F.col("b1") <= F.col("b2")).mapInArrow(search, f"a {kind}, b {kind}, n long")
    return found.select(*canonical(F.col("a"), F.col("b")), F.col("n").alias("co_conv_weight"))


def shared_videos_of(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """``(source, target, co_conv_weight)`` of given pairs, also below any threshold: two equi-joins on what each account saw."""
    a = seen.select(F.col("username").alias("source"), "video")
    b = seen.select(F.col("username").alias("target"), "video")
    return pairs.select("source", "target").distinct().join(a, "source").join(b, ["target", "video"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("co_conv_weight"))


def co_reply(comments: DataFrame, least: int = 2) -> DataFrame:
    """``(source, target, reply_count, co_reply_weight, passes)``: replies between two accounts (C4).

    Both directions are counted apart, then replies are summed and the weight is
    the greater number of videos. Replies to oneself and blank names are dropped.
    """
    given = comments.where("username is not null and parent_user is not null and username <> parent_user")
    directed = given.groupBy("username", "parent_user").agg(F.count("comment_id").alias("n"), F.count_distinct("video").alias("v"))
    both = directed.groupBy(*canonical(F.col("username"), F.col("parent_user"))).agg(F.sum("n").alias("reply_count"), F.max("v").alias("co_reply_weight"))
    return both.withColumn("passes", F.col("co_reply_weight") >= least)


def time_gaps(comments: DataFrame, bucket_minutes: int = 1440) -> DataFrame:
    """``(g)``: microseconds between consecutive comments of each video.

    Gaps within a bucket of time come from its sorted rows, gaps between buckets from their first and last time; so no task
    sorts all comments of a hot video, but one bucket's, and then one row a bucket.
    """
    width = bucket_minutes * 60_000_000
    given = comments.where("ts is not null and video is not null").select("video", F.unix_micros("ts").alias("t")).withColumn("b", F.floor(F.col("t") / width))
    inside = given.select((F.col("t") - F.lag("t").over(Window.partitionBy("video", "b").orderBy("t"))).alias("g"))
    ends = given.groupBy("video", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    between = ends.select((F.col("lo") - F.lag("hi").over(Window.partitionBy("video").orderBy("b"))).alias("g"))
    return inside.unionByName(between).where("g is not null")


def calibrated_window(comments: DataFrame) -> DataFrame:
    """One row ``window_minutes``: the median gap between consecutive comments of a video, rounded half to even, at least 1."""
    gap = exact_quantile(time_gaps(comments), "g", 0.5)
    return comments.sparkSession.createDataFrame([(max(1, round((gap or 0) / 60e6)),)], "window_minutes bigint")


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], t_left: str, t_right: str, width: int) -> DataFrame:
    """Equi-join on ``keys`` with 0 <= t_right - t_left <= width (J10), by buckets of that width.

    A right row lies in its left row's bucket or the next, so each left row is
    posted to two buckets and the join is an equi-join on (keys, bucket) that
    hashes evenly over a hot key's time range. Both bounds are inclusive. Null times match nothing.
    """
    a = left.where(F.col(t_left).isNotNull()).withColumn("_b", F.explode(F.array(F.floor(F.col(t_left) / width), F.floor(F.col(t_left) / width) + 1)))
    b = right.where(F.col(t_right).isNotNull()).withColumn("_b", F.floor(F.col(t_right) / width))
    return a.join(b, [*keys, "_b"]).where((F.col(t_right) >= F.col(t_left)) & (F.col(t_right) - F.col(t_left) <= width)).drop("_b")


def co_temporal(comments: DataFrame, window_minutes: int, left: DataFrame | None = None, right: DataFrame | None = None, least: int = 3) -> DataFrame:
    """``(source, target, co_temporal_weight)``: videos on which two accounts commented within the window, at least ``least``.

    Accounts on fewer videos than ``least`` leave first. With ``left`` and
    ``right``, one account of a pair is of each.

    As in ``co_conv``, each account's ``least - 1`` most popular videos aren't indexed; times on these are compared
    only for pairs that meet on another video. So the comments of a hot video don't all meet.
    """
    given = comments.where("username is not null and video is not null and ts is not null").select("username", "video", F.unix_micros("ts").alias("t")).distinct()
    if left is not None and right is not None:
        sides = left.select("username", F.lit(1).alias("s")).unionByName(right.select("username", F.lit(2).alias("s"))).distinct()
        given = given.join(sides.select("username").distinct(), "username", "left_semi")
    else:
        sides = None
    given = stage(given, "times")
    ranked = _ranked(given.select("username", "video").distinct(), least)
    kept = given.join(ranked.where("not skip"), ["username", "video"])
    kept = kept.join(sides, "username") if sides is not None else kept.withColumn("s", F.lit(0))
    width = window_minutes * 60_000_000
    a = kept.select("video", F.col("username").alias("a"), F.col("t").alias("ta"), F.col("s").alias("sa"))
    b = kept.select("video", F.col("username").alias("b"), F.col("t").alias("tb"), F.col("s").alias("sb"))
    near = band_pairs(a, b, ["video"], "ta", "tb", width).where("a <> b and (sa <> sb or sa = 0)")
    met = near.select(*canonical(F.col("a"), F.col("b")), "video").distinct().groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    met = stage(met, "met")
    one, two = (given.select(F.col("username").alias(side), "video", F.col("t").alias(t)) for side, t in (("source", "ta"), ("target", "tb")))
    late = _skipped(met, ranked).join(one, ["source", "video"]).join(two, ["target", "video"]).where(F.abs(F.col("ta") - F.col("tb")) <= width)
    every = met.unionByName(late.select("source", "target", "video").distinct().select("source", "target", F.lit(1).cast("long").alias("n")))
    return every.groupBy("source", "target").agg(F.sum("n").alias("co_temporal_weight")).where(F.col("co_temporal_weight") >= least)


def shared_and_near(comments: DataFrame, sides: DataFrame, window_minutes: int, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """``co_conv`` and ``co_temporal`` of two disjoint sides, from one meeting of the accounts (C3 and C6 for C7). ``sides`` is (username, s), s is 1 or 2.

    A video on which two accounts comment within the window is one of their common videos, so only pairs with ``least`` common
    videos are held against the clock. As in ``co_conv``, each account's ``least - 1`` most popular videos aren't indexed. A pair that
    meets on fewer than ``least`` others must have one among those: 64 bits of hashed videos an account tell most pairs that
    can't, before any video is looked up. Times of a pair on a video are merged, not multiplied: the least gap between the two lies between neighbours.
    """
    seen = incidence(comments).join(sides, "username")
    own = Window.partitionBy("username")
    seen = seen.withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_n") >= least).drop("_n")
    popularity = seen.groupBy("video").agg(F.count(F.lit(1)).alias("_p"))
    rank = F.row_number().over(own.orderBy(F.desc("_p"), F.desc("video")))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(video), 64) as int))")
    ranked = seen.join(popularity, "video").select("username", "video", "s", (rank < least).alias("skip"), bit.alias("_bit"))
    ranked = ranked.select("username", "video", "s", "skip", F.bit_or("_bit").over(own).alias("every"), F.bit_or(F.when(F.col("skip"), F.col("_bit")).otherwise(F.lit(0).cast("long"))).over(own).alias("few"))
    ranked = stage(ranked, "ranked")
    a, b = (ranked.where(f"not skip and s = {k}").select(F.col("username").alias(x), "video", F.col("every").alias(f"every_{x}"), F.col("few").alias(f"few_{x}")) for k, x in ((1, "a"), (2, "b")))
    pair = Window.partitionBy("a", "b")
    met = a.join(b, "video").select("a", "b", "video", ((F.col("few_a").bitwiseAND(F.col("every_b")) != 0) | (F.col("few_b").bitwiseAND(F.col("every_a")) != 0)).alias("more"))
    met = stage(met.withColumn("n", F.count(F.lit(1)).over(pair)).where(f"more or n >= {least}").select(F.col("a").alias("source"), F.col("b").alias("target"), "video"), "met")
    every = met.unionByName(_skipped(met.select("source", "target").distinct(), ranked))
    common = stage(every.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source", "target"))).where(F.col("n") >= least).drop("n"), "common")
    ends = common.select("source", "target", "video", F.explode(F.array(*[F.struct(F.col(x).alias("username"), F.lit(k).alias("s")) for k, x in ((1, "source"), (2, "target"))])).alias("e")).select("source", "target", "video", "e.*")
    times = comments.where("username is not null and video is not null and ts is not null").select("username", "video", F.unix_micros("ts").alias("t"))
    line = Window.partitionBy("source", "target", "video").orderBy("t", "s")
    gap = F.when(F.lag("s").over(line) != F.col("s"), F.col("t") - F.lag("t").over(line))
    near = ends.join(times, ["username", "video"]).select("source", "target", "video", gap.alias("gap")).where(F.col("gap") <= window_minutes * 60_000_000)
    near = near.select("source", "target", "video").distinct()
    weight = lambda df, name: df.groupBy(*canonical(F.col("source"), F.col("target"))).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= least)
    return weight(common, "co_conv_weight"), weight(near, "co_temporal_weight")


def combine(conv: DataFrame, reply: DataFrame, temporal: DataFrame) -> DataFrame:
    """All evidence of a pair side by side, each divided by its maximum, and their sum.

    Inputs have (source, target, weight). Missing evidence is 0, a maximum of 0 gives 0.
    The maxima come from one aggregate over the rows, a single row.
    """
    names = ("co_conv", "co_reply", "co_temporal")
    rows = None
    for name, df in zip(names, (conv, reply, temporal), strict=True):
        one = df.select("source", "target", *[(F.col("weight").cast("double") if n == name else F.lit(0.0)).alias(n) for n in names])
        rows = one if rows is None else rows.unionByName(one)
    joined = stage(rows.groupBy("source", "target").agg(*[F.max(n).alias(n) for n in names]), "evidence")  # read twice
    top = joined.agg(*[F.max(n).alias(f"max_{n}") for n in names])
    out = joined.crossJoin(F.broadcast(top))  # one row
    norm = {n: F.when(F.col(f"max_{n}") > 0, F.col(n) / F.col(f"max_{n}")).otherwise(0.0) for n in names}
    present = F.array_compact(F.array(*[F.when(F.col(n) > 0, label) for n, label in zip(names, ("Co-conv", "Co-reply", "Co-temporal"), strict=True)]))
    label = F.when(F.size(present) == 1, F.concat(present[0], F.lit(" only"))).when(F.size(present) == 3, "All three evidence").otherwise(F.array_join(present, " + "))
    return out.select(
        "source", "target", *names, *[v.alias(f"{n}_norm") for n, v in norm.items()],
        (norm["co_conv"] + norm["co_reply"] + norm["co_temporal"]).alias("final_weight"), F.size(present).alias("n_evidence"), label.alias("evidence"),
    ).where("n_evidence > 0")


def above_percentile(edges: DataFrame, weight: str = "final_weight", share: float = 0.5) -> DataFrame:
    """Edges whose weight reaches the exact percentile of all weights (C9); none of no edges."""
    cut = exact_quantile(edges, weight, share)
    return edges.where(F.col(weight) >= F.lit(cut if cut is not None else 0.0) - 1e-12)


def co_tags(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """``(source, target, co_hashtag)``: common tags of given pairs, 0 without any (C10). ``tags`` has (username, tag)."""
    own = tags.select("username", "tag").distinct()
    a, b = own.select(F.col("username").alias("source"), "tag"), own.select(F.col("username").alias("target"), "tag")
    both = pairs.select("source", "target").join(a, "source").join(b, ["target", "tag"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("co_hashtag"))
    return pairs.select("source", "target").join(both, ["source", "target"], "left").na.fill(0, ["co_hashtag"])
