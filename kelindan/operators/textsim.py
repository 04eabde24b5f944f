"""Text similarity by character-gram TF-IDF, exact groups and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelindan.operators.components import connected_components
from kelindan.session import stage


def grams_of(text: Column, n: int = 5) -> Column:
    """Character n-grams within blank-padded words; a padded word shorter than n is one gram (T4)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.length(w) - n, F.lit(0))), lambda i: F.substring(w, i + 1, F.lit(n)))))


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """``(text_id, text, n_rows)``: each non-empty text once; its id is a 64-bit hash. Everything expensive runs on these."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.xxhash64("text").alias("text_id"), "text", "n_rows")


def tfidf(texts: DataFrame, n: int = 5, min_df: int = 2) -> DataFrame:
    """``(text_id, gram, df, w)``: sublinear tf, smooth idf, unit norm, grams in at least ``min_df`` texts (T4).

    An id may have several rows: its grams are summed, so long texts needn't be put together.

    Texts are brought together by id before they are cut, so texts are shuffled and not their grams, of which there are many
    times as many bytes. Grams with their counts are staged: where the planner can broadcast them, no gram of a text is shuffled at all.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is kept: coalesced by their size, texts would make tasks of too many grams
    tf = texts.select("text_id", "text").repartition(parts, "text_id").select("text_id", F.explode(grams_of(F.col("text"), n)).alias("gram")).groupBy("text_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = stage(tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df), "df")
    total = texts.select("text_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = tf.join(df, "gram").crossJoin(F.broadcast(total)).select("text_id", "gram", "df", ((1 + F.log("tf")) * idf).alias("v"))  # one row
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("text_id")))
    return raw.select("text_id", "gram", "df", (F.col("v") / norm).alias("w"))


def packed_blocks(vectors: DataFrame, block: int) -> DataFrame:
    """``(b, ids, sizes, g, w)``: up to ``block`` texts a row, as arrays in binary; a text's grams stand one after the other, the rarest first."""
    kind = vectors.schema["text_id"].dataType.simpleString()
    one = vectors.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("gram").alias("g"), "w"))).alias("v")).select("text_id", F.col("v.g").alias("g"), F.col("v.w").alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, k = TaskContext.get().partitionId(), [], 0, 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            g, w = (t[c].combine_chunks() for c in ("g", "w"))
            arrays = (np.asarray(g.value_lengths(), dtype=np.int32), np.asarray(g.flatten(), dtype=np.int64), np.asarray(w.flatten(), dtype=np.float64))
            ids = pa.array([t["text_id"].to_pylist()], pa.list_(t.schema.field("text_id").type))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), ids, *(pa.array([x.tobytes()]) for x in arrays)], names=["b", "ids", "sizes", "g", "w"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, block - n)
                held.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == block:
                    yield row()
                    held, n, k = [], 0, k + 1
        if n:
            yield row()

    return one.mapInArrow(pack, f"b long, ids array<{kind}>, sizes binary, g binary, w binary")


def meetings(left: tuple, right: tuple, m: int, n: int, terms: int, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(low, part)``: for some rows from ``low`` on, the products with each of ``n`` others over the grams that both index. left: (start, row, gram, weight, indexed), right without start."""
    (s0, r0, g0, w0, f0), (r1, g1, w1, f1) = left, right
    order = np.flatnonzero(f1)
    order = order[np.argsort(g1[order], kind="stable")]
    length = np.bincount(g1[order], minlength=terms)
    begin = np.r_[0, np.cumsum(length)]
    col, weight = r1[order], w1[order]
    # meetings before each row: rows are taken as long as these and the cells fit
    work = np.r_[0, np.cumsum(np.bincount(r0[f0], length[g0[f0]], minlength=m))]
    low = 0
    while low < m:
        high = int(min(np.searchsorted(work, work[low] + cells, side="right") - 1, low + max(1, cells // n), m))
        high = max(high, low + 1)
        here = np.flatnonzero(f0[s0[low] : s0[high]]) + s0[low]
        many = length[g0[here]]
        ends = np.cumsum(many)
        post = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[g0[here]] - (ends - many), many)
        cell = np.repeat((r0[here] - low) * n, many) + col[post]
        yield low, np.bincount(cell, np.repeat(w0[here], many) * weight[post], minlength=(high - low) * n).reshape(high - low, n)
        low = high


def _block_pairs(left: tuple, right: tuple | None, least: float, bound: float, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, score)`` of the pairs of two blocks' texts, or of one block's, with a cosine of at least ``least``; a block is (sizes, g, w)."""
    blocks = [left] if right is None else [left, right]
    terms, every = np.unique(np.concatenate([b[1] for b in blocks]), return_inverse=True)
    made, at = [], 0
    for sizes, g, w in blocks:
        ids, at = every[at : at + len(g)], at + len(g)
        start = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # the norm of a gram and all that are more common, summed from the most common on
        back = np.cumsum((w * w)[::-1])[::-1]
        tail = np.sqrt(np.maximum(back - np.r_[back, 0.0][start[1:]][row], 0.0))
        first = tail >= bound
        rest = np.zeros(len(sizes))
        np.maximum.at(rest, row[~first], tail[~first])
        made.append((start, row, ids, w, first, rest))
    (s0, r0, g0, w0, f0, rest0), (s1, r1, g1, w1, f1, rest1) = made[0], made[-1]
    m, n = len(rest0), len(rest1)
    out = []
    for low, part in meetings((s0, r0, g0, w0, f0), (r1, g1, w1, f1), m, n, len(terms), cells):
        high = low + len(part)
        i, j = np.nonzero((part > 0) & (part + np.maximum(rest0[low:high, None], rest1[None, :]) >= least - 1e-9))
        if right is None:
            i, j = i[j > i + low], j[j > i + low]
        for at in range(0, len(i), max(1, cells // 128)):
            a, b = i[at : at + max(1, cells // 128)], j[at : at + max(1, cells // 128)]
            score = dots(a + low, b, (s0, g0, w0), (s1, g1, w1), len(terms))
            hit = score >= least
            out.append((a[hit] + low, b[hit], np.minimum(score[hit], 1.0)))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=t) for k, t in enumerate((np.int64, np.int64, np.float64)))


def dots(i: np.ndarray, j: np.ndarray, left: tuple, right: tuple, terms: int) -> np.ndarray:
    """Dot products of given pairs, ordered by i."""
    (s0, g0, w0), (s1, g1, w1) = left, right
    score, wide = np.zeros(len(i)), max(1, (1 << 20) // terms)
    rows, own = np.unique(i, return_inverse=True)
    for low in range(0, len(rows), wide):
        some = rows[low : low + wide]
        dense = np.zeros((len(some), terms))
        for k, r in enumerate(some):
            dense[k, g0[s0[r] : s0[r + 1]]] = w0[s0[r] : s0[r + 1]]
        one = np.flatnonzero((own >= low) & (own < low + wide))
        many = s1[j[one] + 1] - s1[j[one]]
        ends = np.cumsum(many)
        post = np.arange(ends[-1]) + np.repeat(s1[j[one]] - (ends - many), many)
        score[one] = np.add.reduceat(dense[np.repeat(own[one] - low, many), g1[post]] * w1[post], ends - many)
    return score


def block_join(vectors: DataFrame, block: int, pairs: Callable[[tuple, tuple | None], tuple]) -> DataFrame:
    """``(a, b, score)``, a < b, of what ``pairs`` finds in every two blocks of texts, and in each (then its second block is None); a block is (sizes, g, w)."""
    held = stage(packed_blocks(vectors, block), "blocks")
    kind = vectors.schema["text_id"].dataType.simpleString()
    columns = ("b", "ids", "sizes", "g", "w")
    one, two = (held.select(*[F.col(c).alias(f"{c}{k}") for c in columns]) for k in (1, 2))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t, batch=batch, r=r: np.frombuffer(batch.column(c)[r].as_buffer(), dtype=t)
                left, right = (tuple(get(f"{c}{k}", t) for c, t in (("sizes", np.int32), ("g", np.int64), ("w", np.float64))) for k in (1, 2))
                same = batch.column("b1")[r].as_py() == batch.column("b2")[r].as_py()
                i, j, score = pairs(left, None if same else right)
                ids = [batch.column(f"ids{k}")[r].values.take(pa.array(x)) for k, x in ((1, i), (2, j))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(score)], names=["a", "b", "score"])

    found = one.join(two, F.col("b1") <= F.col("b2")).mapInArrow(search, f"a {kind}, b {kind}, score double")
    spark, rows = vectors.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "1")  # a row is two blocks: more at once only take memory
    try:
        return stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"), "pairs")
    finally:
        spark.conf.set(rows, before)


def similar_texts(vectors: DataFrame, least: float = 0.70, slack: float = 0.12, block: int = 2048) -> DataFrame:
    """``(a, b, score)``: all pairs with a cosine of at least ``least``, a < b.

    Only a prefix of each vector is indexed: its rarest grams, until the norm of
    what is left falls below ``least - slack``. Of two vectors, the common grams outside both prefixes lie in
    the rest of the one whose prefix ends first, so they add at most the norm of that rest: the
    product over common indexed grams must make up the difference to ``least``. Few pairs pass that
    sum, and only those are multiplied out. Common grams, whose lists are quadratic, are rarely indexed. No pair is lost.

    Texts lie in the shared folder in blocks, one copy; every two blocks are a row of a product, whose meetings are summed and
    multiplied out where they are met. So only the pairs found leave a task, and nothing quadratic is shuffled or spilled.
    """
    bound = max(least - slack, 0.0)
    return block_join(vectors, block, lambda left, right: _block_pairs(left, right, least, bound))


#: Cells of the histogram of cosines.
CELLS = 10_000


def group_similarity(vectors: DataFrame, groups: DataFrame, cuts: tuple[float, float] = (0.70, 0.85), block: int = 2048) -> DataFrame:
    """``(group_id, n_texts, n_pairs, mean, median, most, n_070, n_085)`` over all n(n-1)/2 pairs of each group (H8).

    ``groups`` is (text_id, group_id), a text may be in several groups. A text without a gram that another
    has is orthogonal to all. A group of fewer than two texts has no pairs, and null for mean, median and most.

    Each group is dealt into blocks of some ``block`` texts; a task multiplies two blocks and gives back a
    histogram of ``CELLS`` cells. A second pass gives the cosines, at nine decimals, of the cells that hold the
    middle ranks, and the median is exact among these.
    """
    members = groups.select("text_id", "group_id").distinct()
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_texts"))
    dealt = members.join(sizes.select("group_id", F.ceil(F.col("n_texts") / block).cast("int").alias("_nb")), "group_id").withColumn("_b", F.pmod(F.xxhash64("text_id", F.lit(7)), F.col("_nb")).cast("int"))
    # every unordered pair of blocks (i <= j) is one task; a text goes to those that its block is in
    packed = vectors.groupBy("text_id").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), "w")).alias("v")).select("text_id", F.col("v.g").alias("g"), F.col("v.w").alias("w"))
    sent = packed.join(dealt, "text_id").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    sent = sent.select("group_id", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), F.col("_b").alias("b"), "g", "w")

    def multiply(key: tuple, f: pd.DataFrame) -> Iterator[np.ndarray]:
        _, i, j = key
        terms, g = np.unique(np.concatenate(f["g"].to_list()), return_inverse=True)
        w, t = np.concatenate(f["w"].to_list()), np.repeat(np.arange(len(f)), f["g"].map(len))
        own = f["b"].to_numpy() == i
        first, rows, others = own[t], np.cumsum(own) - 1, np.cumsum(~own) - 1
        m, n = own.sum(), (~own).sum()
        dots = np.zeros((m, m if i == j else n))
        for at in range(0, len(terms), 2048):  # the vocabulary in slices, so a slice is a small dense matrix
            here = (g >= at) & (g < at + 2048)
            wide = min(2048, len(terms) - at)
            a = np.zeros((m, wide))
            one = here & first
            a[rows[t[one]], g[one] - at] = w[one]
            if i == j:
                dots += a @ a.T
            else:
                b = np.zeros((n, wide))
                two = here & ~first
                b[others[t[two]], g[two] - at] = w[two]
                dots += a @ b.T
        for r in range(m):
            yield np.clip(np.round(dots[r, r + 1 :] if i == j else dots[r], 9), 0.0, 1.0)

    def summary(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        n, total, most = np.zeros(CELLS + 1, dtype=np.int64), np.zeros(CELLS + 1), np.zeros(CELLS + 1)
        above = np.zeros((2, CELLS + 1), dtype=np.int64)
        for v in multiply(key, f):
            cell = (v * CELLS).astype(np.int64)
            n += np.bincount(cell, minlength=CELLS + 1)
            total += np.bincount(cell, v, minlength=CELLS + 1)
            np.maximum.at(most, cell, v)
            for a, cut in zip(above, cuts, strict=True):
                a += np.bincount(cell[v >= cut - 1e-9], minlength=CELLS + 1)
        c = np.nonzero(n)[0]
        return pd.DataFrame({"group_id": [key[0]] * len(c), "cell": c, "n": n[c], "s": total[c], "most": most[c], "n_070": above[0][c], "n_085": above[1][c]})

    def values(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        wanted, out = np.array(sorted({f["c0"].iloc[0], f["c1"].iloc[0]})), [np.zeros(0)]
        for v in multiply(key, f):
            out.append(v[np.isin((v * CELLS).astype(np.int64), wanted)])
        score, many = np.unique(np.concatenate(out), return_counts=True)
        return pd.DataFrame({"group_id": [key[0]] * len(score), "score": score, "n": many})

    kind, by = members.schema["group_id"].dataType.simpleString(), ("group_id", "i", "j")
    parts = sent.groupBy(*by).applyInPandas(summary, f"group_id {kind}, cell long, n long, s double, most double, n_070 long, n_085 long")
    counts = stage(parts.groupBy("group_id", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "s", "n_070", "n_085")], F.max("most").alias("most")), "cells")
    # pairs with a text that has no gram: they are not met, their cosine is 0
    pairs = sizes.select("group_id", "n_texts", (F.col("n_texts") * (F.col("n_texts") - 1) / 2).cast("bigint").alias("n_pairs"))
    done = counts.groupBy("group_id").agg(F.sum("n").alias("_done"))
    rest = pairs.join(done, "group_id", "left").select("group_id", (F.col("n_pairs") - F.coalesce("_done", F.lit(0))).alias("n")).where("n > 0")
    every = counts.unionByName(rest.select("group_id", F.lit(0).cast("bigint").alias("cell"), "n", F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n_070"), F.lit(0).cast("bigint").alias("n_085"), F.lit(0.0).alias("most")))
    every = every.groupBy("group_id", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "s", "n_070", "n_085")], F.max("most").alias("most"))
    stats = every.groupBy("group_id").agg(*[F.sum(c).alias(c) for c in ("s", "n_070", "n_085")], F.max("most").alias("most"))
    before = Window.partitionBy("group_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # ranks from 0 of the two middle values, the same one for an odd number of pairs
    lo, hi = F.floor((F.col("n_pairs") - 1) / 2), F.floor(F.col("n_pairs") / 2)
    ranked = every.withColumn("_from", F.coalesce(F.sum("n").over(before), F.lit(0))).join(pairs, "group_id")
    first = lambda r, c: F.max(F.when((F.col("_from") <= r) & (F.col("_from") + F.col("n") > r), F.col(c)))
    held = stage(ranked.groupBy("group_id").agg(first(lo, "cell").alias("c0"), first(hi, "cell").alias("c1"), first(lo, "_from").alias("_f0"), F.first(lo).alias("_lo"), F.first(hi).alias("_hi")), "middle")
    found = sent.join(held.select("group_id", "c0", "c1"), "group_id").groupBy(*by).applyInPandas(values, f"group_id {kind}, score double, n long")
    inside = found.unionByName(rest.join(held.where("c0 = 0 or c1 = 0"), "group_id", "left_semi").select("group_id", F.lit(0.0).alias("score"), "n")).groupBy("group_id", "score").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("group_id").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.withColumn("_at", F.coalesce(F.sum("n").over(run), F.lit(0))).join(held, "group_id").withColumn("_at", F.col("_at") + F.col("_f0"))
    holds = lambda r: F.max(F.when((F.col("_at") <= r) & (F.col("_at") + F.col("n") > r), F.col("score")))
    middle = placed.groupBy("group_id").agg(((holds(F.col("_lo")) + holds(F.col("_hi"))) / 2).alias("median"))
    sizes = pairs
    total = F.col("n_pairs")
    out = sizes.join(stats, "group_id", "left").join(middle, "group_id", "left")
    return out.select("group_id", "n_texts", total.alias("n_pairs"), F.try_divide("s", total).alias("mean"), "median", "most", F.coalesce("n_070", F.lit(0)).alias("n_070"), F.coalesce("n_085", F.lit(0)).alias("n_085"))


def nearest(pairs: DataFrame, k: int = 20) -> DataFrame:
    """Pairs that either text ranks among its k nearest (T5, J17); ties go to the smaller id."""
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b"))
    kept = both.withColumn("r", rank).where(F.col("r") <= k)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def band(score: Column, exact: Column) -> Column:
    """Similarity band of a pair."""
    return F.when(exact, "EXACT_DUPLICATE").when(score >= 0.92, "NEAR_EXACT").when(score >= 0.85, "HIGH_SIMILARITY").when(score >= 0.75, "MODERATE_SIMILARITY").otherwise("WEAK_SIMILARITY")


def exact_groups(df: DataFrame, column: str, account: str, item: str) -> DataFrame:
    """``(text, n_rows, n_accounts, n_videos, n_pairs, n_same_account_pairs, n_cross_account_pairs)`` of texts that occur twice or more.

    The pairs of a text are counted, not listed: n(n-1)/2 in all and per account. A
    text with a third of all rows costs one row per account and video.
    """
    given = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("text"), F.col(account).alias("u"), F.col(item).alias("v"))
    per = given.groupBy("text", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    users = per.groupBy("text", "u").agg(F.sum("n").alias("n")).groupBy("text").agg(F.sum("n").alias("n_rows"), F.count("u").alias("n_accounts"), F.sum(F.when(F.col("u").isNotNull(), F.col("n") * (F.col("n") - 1) / 2)).cast("bigint").alias("same"))
    videos = per.groupBy("text", "v").agg(F.count(F.lit(1)).alias("_")).groupBy("text").agg(F.count("v").alias("n_videos"))
    total = (F.col("n_rows") * (F.col("n_rows") - 1) / 2).cast("bigint")
    same = F.coalesce("same", F.lit(0))
    return users.where("n_rows > 1").join(videos, "text").select("text", "n_rows", "n_accounts", "n_videos", total.alias("n_pairs"), same.alias("n_same_account_pairs"), (total - same).alias("n_cross_account_pairs"))


def clusters(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """``(text_id, cluster)`` by connected components over pairs of at least ``least``."""
    return connected_components(pairs.where(F.col("score") >= least), "a", "b").withColumnsRenamed({"node": "text_id", "component": "cluster"})


def cluster_summary(members: DataFrame, pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """Size, links, edge density and cohesion (least score of a link) per cluster, with a priority."""
    links = pairs.where(F.col("score") >= least).join(members.withColumnRenamed("text_id", "a"), "a").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_links"), F.min("score").alias("cohesion"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_texts"))
    n = F.col("n_texts")
    return sizes.join(links, "cluster").select("cluster", "n_texts", "n_links", F.round(F.try_divide(2.0 * F.col("n_links"), n * (n - 1)), 9).alias("density"), F.round("cohesion", 6).alias("cohesion"), F.round(F.log(1 + n) * F.col("cohesion"), 6).alias("priority"))


def numbered(df: DataFrame, order: list[Column], prefix: str, width: int, out: str = "number", buckets: int = 64) -> DataFrame:
    """Rows numbered in a total order, as ``prefix`` and zero-padded digits (T8, T10), without one task for all.

    Rows are range-partitioned by the order; each partition numbers its rows
    from the rows before it, whose counts are at most ``buckets`` rows on the driver.
    """
    spark = df.sparkSession
    placed = stage(df.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = {r._p: r.n for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, rows = 0, []
    for p in sorted(counts):
        rows.append((p, start))
        start += counts[p]
    offsets = spark.createDataFrame(rows, "_p int, _o long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    n = (rank + F.col("_o")).cast("string")
    return placed.join(F.broadcast(offsets), "_p").withColumn(out, F.concat(F.lit(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n))).drop("_p", "_o")


def common_values(df: DataFrame, key: str, value: str, k: int = 4) -> DataFrame:
    """The k most common non-blank values per key, joined by `` || ``; ties go to the smaller value."""
    counts = df.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))).alias("a")).select(key, F.array_join(F.col("a.v"), " || ").alias("common"))


def bounded_lists(df: DataFrame, key: str, value: str, k: int = 12) -> DataFrame:
    """``(key, values)``: the first k distinct values per key joined by ``;``, the number of others as ``;...(+n)``.

    Only k values of a key leave a task; the others are counted.
    """
    once = df.where(F.col(value).isNotNull() & (F.col(value) != "")).select(key, value).distinct()
    totals = once.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = once.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("_r") <= k)
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("_a"))
    more = F.when(F.col("_n") > k, F.concat(F.lit(";...(+"), (F.col("_n") - k).cast("string"), F.lit(")"))).otherwise("")
    return lists.join(totals, key).select(key, F.concat(F.array_join("_a", ";"), more).alias("values"))
