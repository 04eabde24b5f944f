"""Overlaps between splits (problem 4)."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelindan.llm import overlap, setindex

SCHEMA = "record_id long, comment_id string, sample_role string, comment_text_original string, source_file string"


def words(t):
    import re

    return set(re.findall(r"[^\W_]+", t.lower()))


def test_equals_brute_force(spark, rows):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    data = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 90]))]
        for _ in range(2):
            text = " ".join([w for w in base if rng.random() > 0.12] + [rng.choice(vocabulary)] * rng.randrange(2))
            data.append((len(data), str(10**7 + rng.randrange(40)), rng.choice(["development_v2", "Locked-Test V2", "validation_v2 ", "other", None]), text, "f"))
    got = {(a, b) for a, b in rows(overlap.split_overlaps(spark.createDataFrame(data, SCHEMA)), "training_id", "evaluation_id")}
    want = set()
    for x, y in itertools.product(data, data):
        if x[2] == "development_v2" and y[2] in ("Locked-Test V2", "validation_v2 "):
            a, b = words(x[3]), words(y[3])
            if x[1] == y[1] or (a and b and 5 * len(a & b) >= 3 * len(a | b)):
                want.add((x[0], y[0]))
    assert got == want and want


@pytest.mark.parametrize(("text", "digits"), [(" 71 ", "71"), ('"71"', "71"), ("'71", "71"), ("71.0", "71"), ("71\t", "71"), ("7.1E+18", None), ("nan", None), ("", None), (None, None), ("0071", "71")])
def test_ids(spark, text, digits):
    assert spark.range(1).select(overlap.id_digits(F.lit(text).cast("string")).alias("v")).first().v == digits


def test_defined_cases(spark, rows):
    data = [
        (1, "5", "development_v2", "satu dua tiga", "f"), (2, '"5.0"', "LOCKED-TEST-V2", None, "f"), (3, None, "challenge v2", "tiga dua satu", "f"), (4, None, "validation_v2", "[deleted]", "f"),
        (5, "8", "development_v2", "[deleted]", "f"), (6, "9", "development_v2", "👍", "f"), (7, None, "challenge_v2", "👍", "f"), (8, "5", "nan", "satu dua tiga", "f"), (9, "5", None, "satu dua tiga", "f"),
        (10, None, "validation_v2", "", "f"), (11, "77", "development_v2", "kata " * 50_000, "f"), (12, None, "validation_v2", "kata", "f"),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumn("rid", F.lit("clash")).withColumn("words", F.lit(1))
    got = overlap.split_overlaps(df)
    assert sorted(rows(got, "training_id", "evaluation_id", "by_id", "by_text")) == [(1, 2, True, False), (1, 3, False, True), (6, 7, False, True), (11, 12, False, True)]
    report = {r.sample_role: r for r in overlap.overlap_report(df, got).collect()}
    assert report["challenge_v2"].n_overlapping == 2 and report["validation_v2"].n_rows == 3 and report["locked_test_v2"].n_by_id == 1
    assert overlap.split_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_sizes_around_the_classes_equal_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    data = []
    for _ in range(70):
        base = rng.sample(vocabulary, rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 39, 80, 81]))
        for _ in range(2):
            kept = base[: max(1, round(len(base) * rng.choice([0.6, 0.65, 0.8, 1])))] + rng.sample(vocabulary, rng.randrange(2))
            data.append((len(data), None, rng.choice(["development_v2", "validation_v2"]), " ".join(kept), "f"))
    got = {(r.training_id, r.evaluation_id): r.cosine for r in overlap.split_overlaps(spark.createDataFrame(data, SCHEMA)).collect()}
    want = {(x[0], y[0]) for x, y in itertools.product(data, data) if x[2] != y[2] and x[2] == "development_v2" and 5 * len(words(x[3]) & words(y[3])) >= 3 * len(words(x[3]) | words(y[3]))}
    assert set(got) == want and want
    # squared weights lie between 1 and 2, so a similarity of 0.6 has a cosine of 0.6 or more
    assert all(0.6 - 1e-9 <= c <= 1 + 1e-9 for c in got.values())


def test_weights_fall_with_frequency_and_bound_the_dot_product(spark):
    counts = np.array([1000, 10, 100, 2], dtype=np.int64)
    hashes = np.array([1, 2, 3, 4], dtype=np.uint64)
    order = setindex.Order(hashes, np.array([4, 2, 3, 1]), counts, 20_000, frozenset())
    w = overlap.weights(order, np.array([1, 3, 2, 4, 9], dtype=np.uint64))
    assert w[0] == overlap.LIGHT and list(w) == sorted(w) and w[-1] == overlap.HEAVY
    rng = np.random.default_rng(0)
    cases = []
    for _ in range(500):
        joint = int(rng.integers(1, 40))
        shared = -(-3 * joint // 5)
        cut = shared + int(rng.integers(0, joint - shared + 1))
        u = rng.integers(overlap.LIGHT, overlap.HEAVY + 1, joint)
        cases.append((cut, int(u[:cut].sum()), joint - cut + shared, int(u[:shared].sum() + u[cut:].sum()), int(u[:shared].sum())))
    df = spark.createDataFrame(cases, "na int, wa int, nb int, wb int, dot int")
    assert df.where(F.col("dot") < overlap.least_dot(*[F.col(c) for c in ("na", "wa", "nb", "wb")], 3, 5)).count() == 0
