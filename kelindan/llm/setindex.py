"""Inverted lists that no similar pair of word sets can miss; shared by problems 2 and 4.

Words get one global order, rarest first. Two sets with num/den of their joint words in common
share at least ceil(num/den * n) words of the one with n words, so if all but the last
``needed - L`` words of each set are indexed, the first L common words are indexed on
both sides (L is ``groups + 1``). Words fall by hash into ``groups`` groups; L common words in fewer groups leave two in
one group. So a set is posted under every pair of its indexed words that fall in one group - some
20 postings for 20 words, in lists that stay short because they name two rare words. Words that half of
all texts contain come last in the order and are hardly ever indexed.

The number of groups follows the size of the sets, by size classes (of the larger set of a pair), so a long
text has postings in proportion to its words. A posting carries the set's size and a 64-bit map of its
words: each bit that only one of two sets has stands for a word that they don't share, which
rules out nearly all chance meetings before anything is fetched.

The order needs word counts only for common words. Words that make up at least 1/10,000 of all are at most
10,000, whatever the corpus; those are sent to the tasks, all others are taken as equally rare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size classes: up to so many words, so many groups. Beyond the last, sizes double with each class, and groups from ``LARGE`` on.
#: Sets of the smaller sizes of a class share more words than it has groups; more groups mean fewer, but commoner, pairs.
CLASSES = ((5, 1), (10, 3), (80, 6))
LARGE = 24
LEAST_SHARE = 1e-4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def size_class(n: int) -> int:
    """The class of a set of ``n`` words."""
    for c, (top, _) in enumerate(CLASSES):
        if n <= top:
            return c
    return len(CLASSES) - 1 + ((n - 1) // CLASSES[-1][0]).bit_length()


def groups_of(c: int) -> int:
    """The number of word groups of a class."""
    return CLASSES[c][1] if c < len(CLASSES) else LARGE << (c - len(CLASSES))


def needed(n: int, num: int, den: int) -> int:
    """The least number of words that a set of ``n`` words shares with any similar one."""
    return -(-num * n // den)


def indexed(n: int, c: int, num: int, den: int, shared: int = 0) -> int:
    """How many of a set's n words, from the rarest, are indexed in class c, so that a partner shares groups + 1 of them, or ``shared`` if that is more."""
    return min(n, max(0, n - needed(n, num, den)) + max(groups_of(c) + 1, shared))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Order:
    """The common words (sorted hashes), their place from rare to common, their counts, and the size classes that occur."""

    hashes: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    total: int
    present: frozenset[int]

    def lookup(self, flat: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
        """``values`` of the common words among ``flat``, ``other`` for all the rest."""
        if not len(self.hashes):
            return np.full(len(flat), other, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        return np.where(self.hashes[at] == flat, values[at], other)


def word_order(sets: DataFrame, least_share: float = LEAST_SHARE) -> Order:
    """The order of the words of ``sets(h)``: one pass for the sizes, one that sums counts by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            words, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    sizes = sets.groupBy(F.size("h").alias("n")).agg(F.count(F.lit(1)).alias("c")).where("n > 0")
    top = CLASSES[-1][0]
    doublings = F.when(F.col("n") > top, F.length(F.bin(F.floor((F.col("n") - 1) / top)))).otherwise(-F.col("n"))
    rows = sizes.groupBy(doublings).agg(F.sum(F.col("n") * F.col("c")).alias("words"), F.max("n").alias("n")).collect()
    total, present = sum(r.words for r in rows), frozenset(size_class(r.n) for r in rows)
    counts = sets.select("h").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    common = sorted(counts.where(F.col("n") >= max(2, math.ceil(least_share * total))).collect(), key=lambda r: (r.n, r.w))
    hashes = np.array([r.w for r in common], dtype=np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return Order(hashes[by_hash], by_hash.astype(np.int64) + 1, np.array([r.n for r in common], dtype=np.int64)[by_hash], total, present)


def bitmaps(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit map of words per set."""
    return np.bitwise_or.reduceat(np.uint64(1) << (_mixed(flat) & np.uint64(63)), starts) if len(starts) else np.zeros(0, dtype=np.uint64)


def _ordered(flat: np.ndarray, starts: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each set from rare to common, their sets, their places from 0, and the sizes of the sets."""
    sizes = np.diff(np.append(starts, len(flat)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    return flat[np.lexsort((flat, order.lookup(flat, order.places, 0), owner))], owner, np.arange(len(flat)) - np.repeat(starts, sizes), sizes


def index_keys(flat: np.ndarray, starts: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(set number, key, word, word)`` of all postings of sets given as flat word hashes; no set is empty."""
    flat, owner, place, sizes = _ordered(flat, starts, order)
    spans = {int(n): range(size_class(int(n)), size_class(int(n) * den // num) + 1) for n in np.unique(sizes) if n > 1}
    out: list[tuple[np.ndarray, ...]] = []
    for c in sorted({c for span in spans.values() for c in span if c in order.present}):
        cut = np.zeros(int(sizes.max()) + 1, dtype=np.int64)
        for n, span in spans.items():
            if c in span:
                cut[n] = indexed(n, c, num, den)
        kept = place < np.repeat(cut[sizes], sizes)
        words, own = flat[kept], owner[kept]
        group = _mixed(words ^ np.uint64(c + 1)) % np.uint64(groups_of(c))
        by = np.lexsort((words, group, own))
        words, own, group = words[by], own[by], group[by]
        for d in range(1, len(words)):
            same = np.flatnonzero((own[d:] == own[:-d]) & (group[d:] == group[:-d]))
            if not len(same):
                break
            u, v = words[same], words[same + d]
            out.append((own[same], _mixed(_mixed(u + np.uint64(c)) ^ v), u, v))
    if not out:
        return np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def further_words(flat: np.ndarray, starts: np.ndarray, order: Order, num: int, den: int) -> list[np.ndarray]:
    """Of each set, its rarest words, of which any similar set shares at least three (if they have three words in common)."""
    flat, _, _, sizes = _ordered(flat, starts, order)
    last = {int(n): indexed(int(n), size_class(int(n) * den // num), num, den, 3) for n in np.unique(sizes)}
    return [flat[at : at + last[int(n)]] for at, n in zip(starts, sizes, strict=True)]


def may_be_similar(na, nb, ma, mb, num: int, den: int) -> np.ndarray:
    """Whether two sets may be similar, by sizes and maps (numpy arrays)."""
    most = np.minimum(na - np.bitwise_count(ma & ~mb), nb - np.bitwise_count(mb & ~ma))
    return most * (num + den) >= num * (na + nb)


def may_be_similar_column(na: Column, nb: Column, ma: Column, mb: Column, num: int, den: int) -> Column:
    """``may_be_similar`` for columns."""
    most = F.least(na - F.bit_count(ma.bitwiseAND(F.bitwise_not(mb))), nb - F.bit_count(mb.bitwiseAND(F.bitwise_not(ma))))
    return most * (num + den) >= num * (na + nb)


def flat_sets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and first positions of the sets of a list column without nulls and empty lists."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
