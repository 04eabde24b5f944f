"""Groups of records that are one text with small edits (problem 2).

A signature-coordinate inverted join. A text's signature has one coordinate per word group of
``setindex``; the values of a coordinate are the pairs of the text's indexed (rarest) words in that group.
Documents are posted under (coordinate, value), and two documents that share num/den of their joint words
collide at least once: unlike minimum hashes, this signature loses no link. Every collision is held against the
match threshold by the sizes and word maps in the postings; what remains is compared exactly, by words.

Posting lists are merged in order of document, each in one pass:

* a *short* list (up to ``SHORT`` documents) is merged in full;
* a longer one by its *prefix*: every document is paired with the list's least document only, one pair a
  posting, also in a list with a third of all documents. Map tasks do this for their own share of a list before the
  shuffle and send on one document, so no task ever merges a hot list alone;
* long lists whose documents then lie in one group are *skipped*. The others are split by a third word of their
  documents, skipped again where one group is left, and documents of different groups are paired.

Exact copies share one word set and are posted once by each task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.llm import setindex as X
from kelindan.operators.components import connected_components, merge_components
from kelindan.session import stage, unstage

#: Lists of up to so many documents are merged in full.
SHORT = 4096
#: Postings that a task merges at once.
CHUNK = 200_000
_WORD = re.compile(r"[^\W_]+")
#: Kinds of merged rows: a posting, a posting of a long list, a pair (pk, rid) to compare.
POSTING, LONG, PAIR = 0, 1, 2
MERGED = "kind int, pk long, rid long, n int, bm long, rep boolean"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
_NAMES = ["kind", "pk", "rid", "n", "bm", "rep"]


class _WordHashes(dict):
    """Word -> 64-bit hash, salted by source; filled on demand."""

    def __init__(self, src: str) -> None:
        self.seed = zlib.crc32(src.encode("utf-8", "replace"))

    def __missing__(self, w: str) -> int:
        h = self[w] = _signed(xxhash.xxh64_intdigest(w, self.seed))
        return h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def text_words(text: str | None) -> list[str]:
    """The sorted distinct lower-cased runs of letters and digits."""
    return sorted(set(_WORD.findall(text.lower()))) if text else []


def _identified(df: DataFrame) -> DataFrame:
    """``(src, key, rid, h)`` in one Arrow pass: the hashes of a text's words, and the id of their set within the source.

    A text without words is known by itself; null and blank texts have no id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _WordHashes] = {}
        for b in batches:
            rids, sets = [], []
            for src, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not text or text.isspace():
                    rids.append(None)
                    sets.append(None)
                    continue
                name = src or ""
                if name not in held:
                    held[name] = _WordHashes(name)
                h = sorted(map(held[name].__getitem__, set(_WORD.findall(text.lower()))))
                rids.append(_signed(xxhash.xxh64_intdigest(array("q", h).tobytes() if h else f"{name}\x00{text}".encode("utf-8", "replace"), bool(h))))
                sets.append(h or None)
            for table in held.values():
                if len(table) > 1_000_000:
                    table.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["src", "key", "rid", "h"])

    given = df.select(*[F.col(c).cast("string").alias(c) for c in ("src", "key", "text")])
    return given.mapInArrow(run, "src string, key string, rid long, h array<long>")


class _Lists:
    """Postings as parallel arrays, sorted by (pk, rid), one row per document of a list."""

    def __init__(self, pk: np.ndarray, rid: np.ndarray, n: np.ndarray, bm: np.ndarray, rep: np.ndarray) -> None:
        by = np.lexsort((rid, pk))
        pk, rid, n, bm, rep = pk[by], rid[by], n[by], bm[by], rep[by]
        first = np.flatnonzero(np.r_[True, (pk[1:] != pk[:-1]) | (rid[1:] != rid[:-1])]) if len(pk) else np.zeros(0, dtype=np.int64)
        self.pk, self.rid, self.n, self.bm = pk[first], rid[first], n[first], bm[first]
        self.rep = np.logical_or.reduceat(rep, first) if len(first) else rep
        self.starts = np.flatnonzero(np.r_[True, self.pk[1:] != self.pk[:-1]]) if len(first) else first
        self.sizes = np.diff(np.append(self.starts, len(first)))

    def long(self, short: int) -> np.ndarray:
        """Of each posting, whether its list is long: more than ``short`` documents, or one of them stands for others."""
        if not len(self.starts):
            return np.zeros(0, dtype=bool)
        return np.repeat((self.sizes > short) | np.logical_or.reduceat(self.rep, self.starts), self.sizes)

    def leads(self) -> np.ndarray:
        return np.repeat(self.starts, self.sizes)


def _rows(kind: int, pk: np.ndarray, rid: np.ndarray, n: np.ndarray | None = None, bm: np.ndarray | None = None, rep: np.ndarray | None = None) -> list[np.ndarray]:
    size = len(pk)
    none = np.zeros(size, dtype=np.int64)
    return [np.full(size, kind), pk, rid, none if n is None else n, none if bm is None else bm.view(np.int64), np.zeros(size, dtype=bool) if rep is None else rep]


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]), t) for i, t in enumerate(_TYPES)], _NAMES)


def _paired(x: _Lists, i: np.ndarray, j: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The collisions of postings i and j that may reach the threshold, the smaller document first."""
    ok = X.may_be_similar(x.n[i].astype(np.int64), x.n[j].astype(np.int64), x.bm[i], x.bm[j], num, den)
    a, b = x.rid[i[ok]], x.rid[j[ok]]
    return _rows(PAIR, np.minimum(a, b), np.maximum(a, b))


def postings(rows: DataFrame, order: X.Order, num: int, den: int, short: int = SHORT) -> DataFrame:
    """``MERGED`` rows of sets in ``(rid, h)``: postings, where lists that are long already within a batch are merged by their prefix."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            if not len(rid):
                continue
            flat, starts = X.flat_sets(b.column(1).take(pa.array(at)))
            owner, keys, _, _ = X.index_keys(flat, starts, order, num, den)
            sizes, maps = np.diff(np.append(starts, len(flat))), X.bitmaps(flat, starts)
            x = _Lists(keys.view(np.int64), rid[owner], sizes[owner], maps[owner], np.zeros(len(owner), dtype=bool))
            long, lead = x.long(short), x.leads()
            i = np.flatnonzero(~long)
            j = np.flatnonzero(long & (np.arange(len(long)) != lead))
            heads = np.unique(lead[long])
            held = np.flatnonzero(long)
            yield _batch([
                _rows(POSTING, x.pk[i], x.rid[i], x.n[i], x.bm[i]), _rows(POSTING, x.pk[heads], x.rid[heads], x.n[heads], x.bm[heads], np.ones(len(heads), dtype=bool)),
                _rows(LONG, x.pk[held], x.rid[held], x.n[held], x.bm[held]), _paired(x, lead[j], j, num, den),
            ])

    return rows.select("rid", "h").mapInArrow(post, MERGED)


def merged(posted: DataFrame, num: int, den: int, short: int = SHORT) -> DataFrame:
    """``MERGED`` rows without postings: the pairs of all lists and the documents of long lists.

    Each task reads its lists in order and holds one unfinished list, of which a long one is kept as its least document.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, bool)]
        kept = empty

        def close(x: _Lists, upto: int) -> pa.RecordBatch:
            """All lists before position ``upto``, merged."""
            here = np.arange(len(x.pk)) < upto
            long, lead = x.long(short) & here, x.leads()
            j = np.flatnonzero(long & (np.arange(len(long)) != lead))
            held = np.flatnonzero(long & ~x.rep)
            parts = [_rows(LONG, x.pk[held], x.rid[held], x.n[held], x.bm[held]), _paired(x, lead[j], j, num, den)]
            after = np.repeat(x.starts + x.sizes, x.sizes) - np.arange(len(x.pk))
            i, d = np.flatnonzero(here & ~long), 1
            while len(i := i[after[i] > d]):
                parts.append(_paired(x, i, i + d, num, den))
                d += 1
            return _batch(parts)

        def add(new: list[list[np.ndarray]]) -> pa.RecordBatch:
            """Merge all lists but the last, which may go on; of a long one only the least document is kept."""
            nonlocal kept
            x = _Lists(*[np.concatenate(c) for c in zip(kept, *new, strict=True)])
            at = int(x.starts[-1])
            if x.long(short)[-1]:
                kept = [v[at : at + 1] for v in (x.pk, x.rid, x.n, x.bm)] + [np.ones(1, dtype=bool)]
                return close(x, len(x.pk))
            kept = [v[at:] for v in (x.pk, x.rid, x.n, x.bm, x.rep)]
            return close(x, at)

        waiting: list[list[np.ndarray]] = []
        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False)
            own = kind == POSTING
            if not own.all():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(~own)) for c in b.columns], _NAMES)
            if own.any():
                new = [b.column(i).to_numpy(zero_copy_only=False)[own] for i in range(1, 6)]
                waiting.append([*new[:3], new[3].view(np.uint64), new[4]])
            if sum(len(w[0]) for w in waiting) >= CHUNK:
                yield add(waiting)
                waiting = []
        if waiting:
            yield add(waiting)
        if len(kept[0]):
            x = _Lists(*kept)
            yield close(x, len(x.pk))

    where = F.when(F.col("kind") == POSTING, F.col("pk")).otherwise(F.xxhash64("pk", "rid"))
    return posted.repartition(where).sortWithinPartitions("kind", "pk", "rid").mapInArrow(merge, MERGED)


def _compare(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose word sets share num/den of their joint words."""
    need = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    known = rows.where("h is not null").select("rid", "h").join(need, "rid", "left_semi").groupBy("rid").agg(F.first("h").alias("h"))
    left, right = known.withColumnsRenamed({"rid": "a", "h": "ha"}), known.withColumnsRenamed({"rid": "b", "h": "hb"})
    shared = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(shared * (num + den) >= num * (F.size("ha") + F.size("hb"))).select("a", "b")


def _across(lists: DataFrame, found: DataFrame, rows: DataFrame, order: X.Order, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of different groups that share a long list and may be similar.

    Similar sets share a third word of their rarest ones, by which the lists are split; only sets of two and
    three words may share no more than the two words of the list.
    """
    of = found.select(F.col("node").alias("rid"), F.col("component").alias("g"))
    grouped = lists.join(of, "rid", "left").withColumn("g", F.coalesce("g", "rid"))
    mixed = grouped.groupBy("pk").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("pk")
    rest = stage(grouped.join(mixed, "pk", "left_semi"), "nd-mixed")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list[int], ...] = ([], [], [])
            if b.num_rows:
                flat, starts = X.flat_sets(b.column(1))
                words = X.further_words(flat, starts, order, num, den)
                rids, wanted = b.column(0).to_pylist(), [set(x) for x in b.column(2).to_pylist()]
                for i, key, u, v in zip(*(x.tolist() for x in X.index_keys(flat, starts, order, num, den)), strict=True):
                    if (pk := _signed(key)) in wanted[i]:
                        third = [_signed(w) for w in words[i].tolist() if w not in (u, v)]
                        out[0].extend([rids[i]] * len(third))
                        out[1].extend([pk] * len(third))
                        out[2].extend(third)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rid", "pk", "w"])

    wanted = rest.groupBy("rid").agg(F.collect_set("pk").alias("pks"))  # at most the postings of one set
    known = rows.where("h is not null").select("rid", "h").join(wanted.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("h").alias("h"))
    thirds = known.join(wanted, "rid").select("rid", "h", "pks").mapInArrow(split, "rid long, pk long, w long").distinct()
    each = rest.join(thirds, ["rid", "pk"]).select(F.xxhash64("pk", "w").alias("tk"), "rid", "n", "bm", "g")
    mixed3 = each.groupBy("tk").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("tk")
    each = stage(each.join(mixed3, "tk", "left_semi"), "nd-thirds")

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias("k"), *[F.col(c).alias(f"{c}_{name}") for c in ("rid", "n", "bm", "g")])

    maybe = (F.col("g_x") != F.col("g_y")) & X.may_be_similar_column(*[F.col(c) for c in ("n_x", "n_y", "bm_x", "bm_y")], num, den)
    near = side(each, "tk", "x").join(side(each, "tk", "y"), "k").where(maybe & (F.col("rid_x") < F.col("rid_y")))
    tiny = side(rest.where("n = 2"), "pk", "x").join(side(rest.where("n = 3"), "pk", "y"), "k").where(maybe)
    pairs = near.select("rid_x", "rid_y").unionByName(tiny.select("rid_x", "rid_y"))
    return pairs.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()


def near_duplicate_classes(df: DataFrame, num: int = 3, den: int = 5, short: int = SHORT) -> DataFrame:
    """``(src, key, class)`` for each row of ``df(src, key, text)``: rows in one class are one text with edits.

    Two rows of one ``src`` with at least num/den (more than a half) of their joint distinct words in
    common share a class, also through other rows; so do verbatim copies without words
    (emoji only). Null and blank texts have a null class. Keys may repeat. An
    empty table gives an empty result. The class is a 64-bit id.
    """
    if 2 * num <= den:
        raise ValueError("the similarity must be above a half")
    rows = stage(_identified(df), "nd-rows")
    sets = rows.where("h is not null")
    order = X.word_order(sets)
    lists = stage(merged(postings(sets, order, num, den, short), num, den, short), "nd-merged")
    pairs = lists.where(F.col("kind") == PAIR).select(F.col("pk").alias("a"), F.col("rid").alias("b")).distinct()
    links = stage(_compare(pairs, rows, num, den), "nd-links")
    found = stage(connected_components(links, "a", "b"), "nd-comps")

    long = lists.where(F.col("kind") == LONG).select("pk", "rid", "n", "bm").distinct()
    if not lists.where(F.col("kind") == LONG).isEmpty():
        extra = stage(_compare(_across(long, found, rows, order, num, den), rows, num, den), "nd-extra")
        if not extra.isEmpty():
            found = stage(merge_components(found, extra, "a", "b"), "nd-comps")
        unstage(extra)
    comps = found.select(F.col("node").alias("rid"), F.col("component"))
    unstage(lists)
    unstage(links)
    return rows.select("src", "key", "rid").join(comps, "rid", "left").select("src", "key", F.coalesce("component", "rid").alias("class"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """``(src_table, key_1, key_2)``: all pairs of keys in one class, the smaller key first.

    Classes of one key leave by a min/max aggregate before the join on the class.
    """
    held = stage(classes.where("class is not null and key is not null").select("src", "class", "key"), "nd-classes")
    several = held.groupBy("class").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("class")
    some = held.join(several, "class", "left_semi")
    a, b = some.select("src", "class", F.col("key").alias("key_1")), some.select("class", F.col("key").alias("key_2"))
    return a.join(b, "class").where("key_1 < key_2").select(F.col("src").alias("src_table"), "key_1", "key_2").distinct()
