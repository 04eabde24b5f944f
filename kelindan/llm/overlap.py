"""Records of evaluation splits that repeat training records (problem 4).

A weighted cosine join between the splits. A text is a vector over its distinct words; the squared weight of a
word falls with its frequency, from 2 (``HEAVY``) to 1 (``LIGHT``), so the norm of a vector and the dot product of two are sums of whole
sixteenths and exact. The required result is stated on unweighted words (num/den of the joint words in common). Because
weights are clipped, that implies a least dot product for any two vectors (``least_dot``), and nothing is lost by joining on it:

* residual norm: words are indexed from the heaviest to the lightest. What is left of a vector may supply all of a
  partner's dot product but for the words indexed; it is cut off where its squared norm falls below what a partner needs, the
  sum of the vector's lightest ``needed`` weights less those of the indexed words in common (``setindex``: as the lightest words come last, that is a number of words);
* maximum weight: no word counts more than ``HEAVY`` nor less than ``LIGHT``, so the sizes, norms and word maps of two vectors in a
  list bound their dot product from above; pairs below their least dot product leave within the join.

Inverted lists are kept for pairs of indexed words of a group (``setindex``), which keeps them short where lists of single words
grow with the corpus. Candidates get their exact dot product and cosine; the stated similarity decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.llm import setindex as X
from kelindan.llm.words import kept_text, word_set
from kelindan.session import stage

#: Least and greatest squared weight of a word, in sixteenths.
LIGHT, HEAVY = 16, 32
TRAINING = "development_v2"
EVALUATION = ("locked_test_v2", "locked_test_v2_replacement", "validation_v2", "challenge_v2")


def role_name(role: Column) -> Column:
    """A split's name however it is written: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(role, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[-\s\p{Z}_]+", "_")


def id_digits(value: Column) -> Column:
    """The digits of an id however it is written (quotes, blanks, a decimal .0); null if they are no whole id.

    An id in scientific notation has lost digits and names no record.
    """
    bare = F.regexp_replace(value, r"[\s\p{Z}\"'`]", "")
    digits = F.regexp_extract(bare, r"^\+?0*([0-9]+)(?:\.0*)?$", 1)
    return F.nullif(digits, F.lit(""))


def weights(order: X.Order, hashes: np.ndarray) -> np.ndarray:
    """Squared weights of words in sixteenths, from ``LIGHT`` for the commonest word to ``HEAVY`` for all that aren't common: an inverse document frequency, clipped."""
    if not len(order.counts):
        return np.full(len(hashes), HEAVY, dtype=np.int64)
    top, low = math.log(order.counts.max()), math.log(max(2, X.LEAST_SHARE * order.total))
    level = LIGHT + (HEAVY - LIGHT) * (top - np.log(order.counts)) / max(top - low, 1e-9)
    return order.lookup(hashes, np.clip(np.rint(level), LIGHT, HEAVY).astype(np.int64), HEAVY)


def least_dot(na: Column, wa: Column, nb: Column, wb: Column, num: int, den: int) -> Column:
    """The least dot product (before normalising) of two vectors whose words are similar.

    At least s words are shared; those that aren't take at most ``HEAVY`` each from either squared norm.
    """
    s = F.ceil((na + nb) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))
    return F.greatest(s * LIGHT, wa - (na - s) * HEAVY, wb - (nb - s) * HEAVY)


def text_links(sets: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """``(a, b, cosine)``: training and evaluation word sets with num/den of their joint words in common, and their weighted cosine.

    ``sets`` has ``(rid, h, in_training, in_evaluation)`` with one row per word set. A set that
    occurs on both sides is linked to itself.
    """
    order = X.word_order(sets)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, starts = X.flat_sets(b.column(1))
            owner, keys, _, _ = X.index_keys(flat, starts, order, num, den)
            rid, maps = b.column(0).to_numpy(zero_copy_only=False), X.bitmaps(flat, starts).view(np.int64)
            norms, sizes = np.add.reduceat(weights(order, flat), starts), np.diff(np.append(starts, len(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((keys.view(np.int64), pa.int64()), (rid[owner], pa.int64()), (sizes[owner], pa.int32()), (norms[owner], pa.int32()), (maps[owner], pa.int64()))], ["pk", "rid", "n", "w", "bm"])

    def side(which: str, x: str) -> DataFrame:
        lists = sets.where(which).select("rid", "h").mapInArrow(post, "pk long, rid long, n int, w int, bm long")
        return lists.select("pk", *[F.col(c).alias(f"{c}_{x}") for c in ("rid", "n", "w", "bm")])

    na, nb, wa, wb, ma, mb = (F.col(c) for c in ("n_a", "n_b", "w_a", "w_b", "bm_a", "bm_b"))
    # what is left of either squared norm without the words that the other map rules out, at their least weight
    most = F.least(wa - LIGHT * F.bit_count(ma.bitwiseAND(F.bitwise_not(mb))), wb - LIGHT * F.bit_count(mb.bitwiseAND(F.bitwise_not(ma))))
    maybe = X.may_be_similar_column(na, nb, ma, mb, num, den) & (most >= least_dot(na, wa, nb, wb, num, den))
    near = side("in_training", "a").join(side("in_evaluation", "b"), "pk").where((F.col("rid_a") != F.col("rid_b")) & maybe)
    candidates = near.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")).distinct()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, cosines = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                shared = np.array(sorted(set(x) & set(y)), dtype=np.int64).view(np.uint64)
                u, v = np.array(x, dtype=np.int64).view(np.uint64), np.array(y, dtype=np.int64).view(np.uint64)
                dot, norms = int(weights(order, shared).sum()), (int(weights(order, u).sum()), int(weights(order, v).sum()))
                keep.append(len(shared) * (num + den) >= num * (len(x) + len(y)))
                cosines.append(dot / math.sqrt(norms[0] * norms[1]))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (b.column(0), b.column(1), pa.array(cosines, pa.float64()))], ["a", "b", "cosine"])

    ha, hb = sets.select(F.col("rid").alias("a"), F.col("h").alias("ha")), sets.select(F.col("rid").alias("b"), F.col("h").alias("hb"))
    exact = candidates.join(ha, "a").join(hb, "b").select("a", "b", "ha", "hb").mapInArrow(products, "a long, b long, cosine double")
    same = sets.where("in_training and in_evaluation").select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(1.0).alias("cosine"))
    return exact.unionByName(same)


def split_overlaps(df: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """``(training_id, evaluation_id, by_id, by_text, cosine)``: record pairs across the splits that carry one comment id or nearly one text.

    ``df`` has record_id, comment_id, sample_role, comment_text_original; other
    columns are ignored. Roles outside the two sides, null ids and removed
    texts match nothing; texts without words match only verbatim copies. The cosine is null for pairs by id alone. Copies of a text meet once,
    as word sets, and are expanded at the end, for the result names every pair.
    """
    if 2 * num <= den:
        raise ValueError("the similarity must be above a half")
    role = role_name(F.col("sample_role"))
    hashed = F.array_sort(F.transform(word_set("text"), lambda w: F.xxhash64(w)))
    given = df.select("record_id", id_digits(F.col("comment_id")).alias("cid"), role.alias("role"), kept_text(F.col("comment_text_original")).alias("text"))
    given = given.where(F.col("role").isin(TRAINING, *EVALUATION)).withColumns({"training": F.col("role") == TRAINING, "h": hashed})
    rid = F.when(F.size("h") > 0, F.xxhash64("h")).when(F.col("text").isNotNull(), F.xxhash64(F.lit("verbatim"), "text"))
    rows = stage(given.select("record_id", "cid", "training", "h", rid.alias("rid")), "ov-rows")

    sides = rows.where("rid is not null").groupBy("rid").agg(F.max("training").alias("in_training"), F.max(~F.col("training")).alias("in_evaluation"), F.first("h").alias("h"))
    sets = stage(sides, "ov-sets")
    worded = text_links(sets.where(F.size("h") > 0), num, den)
    mute = sets.where("size(h) = 0 and in_training and in_evaluation").select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(1.0).alias("cosine"))
    links = worded.unionByName(mute)

    train, test = rows.where("training"), rows.where("not training")
    by_text = (
        links.join(train.select(F.col("rid").alias("a"), F.col("record_id").alias("training_id")), "a")
        .join(test.select(F.col("rid").alias("b"), F.col("record_id").alias("evaluation_id")), "b")
        .select("training_id", "evaluation_id", F.lit(False).alias("by_id"), F.lit(True).alias("by_text"), "cosine")
    )
    by_id = (
        train.where("cid is not null").select("cid", F.col("record_id").alias("training_id"))
        .join(test.select("cid", F.col("record_id").alias("evaluation_id")), "cid")
        .select("training_id", "evaluation_id", F.lit(True).alias("by_id"), F.lit(False).alias("by_text"), F.lit(None).cast("double").alias("cosine"))
    )
    return by_text.unionByName(by_id).groupBy("training_id", "evaluation_id").agg(F.max("by_id").alias("by_id"), F.max("by_text").alias("by_text"), F.max("cosine").alias("cosine"))


def overlap_report(df: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``(sample_role, source_file, n_rows, n_overlapping, n_by_id, n_by_text, n_pairs)`` of the evaluation rows."""
    each = overlaps.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("by_id").alias("by_id"), F.max("by_text").alias("by_text"))
    rows = df.select(F.col("record_id").alias("evaluation_id"), role_name(F.col("sample_role")).alias("sample_role"), "source_file")
    rows = rows.where(F.col("sample_role").isin(*EVALUATION)).join(each, "evaluation_id", "left")
    return rows.groupBy("sample_role", "source_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("n_overlapping"),
        F.count_if(F.coalesce("by_id", F.lit(False))).alias("n_by_id"), F.count_if(F.coalesce("by_text", F.lit(False))).alias("n_by_text"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
    )
