"""Near-duplicate groups (problem 2)."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelindan.llm import neardup, setindex


def brute(rows, num=3, den=5):
    keys = [(i, set(neardup.text_words(t)), t, s) for i, (s, _, t) in enumerate(rows) if t and t.strip()]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a, s, p), (j, b, t, q) in itertools.combinations(keys, 2):
        near = len(a & b) * (num + den) >= num * (len(a) + len(b)) if a and b else s == t
        if p == q and near:
            parent[find(i)] = find(j)
    live = {i for i, *_ in keys}
    return {(rows[i][0], *sorted((rows[i][1], rows[j][1]))) for i, j in itertools.combinations(range(len(rows)), 2) if i in live and j in live and find(i) == find(j) and rows[i][1] != rows[j][1]}


def make(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(20)]
        for _ in range(rng.randrange(1, 5)):
            edited = [w for w in base if rng.random() > 0.1] + [rng.choice(words) for _ in range(rng.randrange(3))]
            rng.shuffle(edited)
            out.append(("t", f"k{len(out):04d}", " ".join(edited)))
    return out


def found(spark, data):
    df = spark.createDataFrame(data, "src string, key string, text string").withColumn("rid", F.lit(1)).withColumn("class", F.lit("x"))
    return {tuple(r) for r in neardup.class_pairs(neardup.near_duplicate_classes(df)).collect()}


def test_equals_brute_force(spark):
    data = make(5)
    assert found(spark, data) == brute(data)


def edge_cases(seed=9):
    """Texts of sizes on both sides of the size classes, and edited copies at and beside the threshold."""
    rng = random.Random(seed)
    data = []
    for i in range(150):
        n = rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 8, 10, 11, 20, 45, 80, 81, 130])
        vocabulary = [f"w{j}" for j in range(max(8, n * 2))]
        data.append((rng.choice("ab"), f"k{i:03d}", " ".join(rng.sample(vocabulary, n))))
    for i in range(60):
        src, _, text = rng.choice(data)
        words = text.split()
        rng.shuffle(words)
        kept = words[: max(1, round(len(words) * rng.choice([0.6, 0.65, 0.7, 0.8, 1])))]
        data.append((src, f"e{i:03d}", " ".join([*kept, *[f"n{rng.random()}"[:6] for _ in range(rng.choice([0, 0, 1]))]])))
    return data


@pytest.mark.parametrize("short", [neardup.SHORT, 2])
def test_sizes_and_long_lists_equal_brute_force(spark, short):
    """With ``short`` 2 nearly every list is long: merged by its prefix, skipped, or split by a third word."""
    data = edge_cases()
    df = spark.createDataFrame(data, "src string, key string, text string")
    assert {tuple(r) for r in neardup.class_pairs(neardup.near_duplicate_classes(df, short=short)).collect()} == brute(data)


@pytest.mark.parametrize(("num", "den"), [(3, 5), (4, 5)])
def test_no_similar_pair_is_missed_by_the_index(num, den):
    """Random pairs at the threshold always share a posting, and their sizes and maps never rule them out."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        joint = int(rng.integers(2, 140))
        shared = -(-num * joint // den)
        words = rng.integers(0, 2**63, joint, dtype=np.uint64)
        cut = shared + int(rng.integers(0, joint - shared + 1))
        a, b = words[:cut], np.concatenate((words[:shared], words[cut:]))
        flat, starts = np.concatenate((a, b)), np.array([0, len(a)])
        common = np.sort(rng.choice(words, joint // 2, replace=False))
        order = setindex.Order(common, rng.permutation(len(common)) + 1, np.ones(len(common), dtype=np.int64), 1, frozenset(range(9)))
        own, keys, _, _ = setindex.index_keys(flat, starts, order, num, den)
        assert len(a) == len(b) == shared or set(keys[own == 0]) & set(keys[own == 1])
        maps, n = setindex.bitmaps(flat, starts), np.array([len(a), len(b)])
        assert setindex.may_be_similar(n[:1], n[1:], maps[:1], maps[1:], num, den).all()


def test_unrelated_texts_with_one_opening_stay_in_short_lists(spark):
    """2,000 texts that share 14 of 28 words: the common words come last in the order, so no list grows with the texts."""
    data = [("t", f"k{i}", " ".join([*[f"pembuka{j}" for j in range(14)], *[f"u{i}x{j}" for j in range(14)]])) for i in range(2000)]
    rows = neardup._identified(spark.createDataFrame(data, "src string, key string, text string"))
    order = setindex.word_order(rows)
    lists = neardup.postings(rows, order, 3, 5).where("kind = 0").groupBy("pk").count()
    assert lists.agg({"count": "max"}).first()[0] < 20 and len(order.hashes) == 14


def test_the_map_side_merges_a_hot_list(spark):
    """Of a list that is long within a batch only its least document is posted; the others are paired with it."""
    base = [f"kata{i}" for i in range(30)]
    data = [("t", f"k{i:03d}", " ".join([*base, f"u{i}"])) for i in range(200)]
    rows = neardup._identified(spark.createDataFrame(data, "src string, key string, text string").coalesce(1))
    posted = neardup.postings(rows, setindex.word_order(rows), 3, 5, short=20)
    assert posted.where("kind = 0 and rep").groupBy("pk").count().agg({"count": "max"}).first()[0] == 1
    classes = neardup.near_duplicate_classes(spark.createDataFrame(data, "src string, key string, text string"), short=20)
    assert classes.select("class").distinct().count() == 1


def test_defined_cases(spark):
    data = [
        ("a", "1", "satu dua tiga"), ("a", "2", "tiga, DUA satu!"), ("b", "3", "satu dua tiga"), ("a", "4", None), ("a", "5", ""), ("a", "6", "  "), ("a", "7", "👍"), ("a", "8", "👍"), ("a", "9", "👎"),
        ("a", "2", "tiga, DUA satu!"), ("a", None, "satu dua tiga"), ("a", "10", "lain sekali " * 20_000),
    ]
    assert found(spark, data) == {("a", "1", "2"), ("a", "7", "8")}
    classes = neardup.near_duplicate_classes(spark.createDataFrame(data, "src string, key string, text string"))
    assert classes.count() == len(data) and classes.where("class is null").count() == 3
    assert found(spark, [("a", "1", "x")][:0] or [("a", "1", None)]) == set()


def test_empty_table(spark):
    df = spark.createDataFrame([], "src string, key string, text string")
    assert neardup.near_duplicate_classes(df).count() == 0


def test_one_group_of_many_variants(spark):
    rng = random.Random(1)
    base = [f"kata{i}" for i in range(30)]
    data = [("t", f"k{i:03d}", " ".join([*base[: rng.randrange(26, 30)], f"u{i}"])) for i in range(120)]
    classes = neardup.near_duplicate_classes(spark.createDataFrame(data, "src string, key string, text string"))
    assert classes.select("class").distinct().count() == 1
