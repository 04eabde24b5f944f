"""Consensus labels (problem 6)."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kelindan.llm import consensus

SCHEMA = "item string, annotator string, label string"


@pytest.mark.parametrize(("x", "y"), [(1.0, -0.5772156649), (0.5, -1.9635100260), (10.0, 2.2517525890), (0.01, -100.5608854578)])
def test_digamma(x, y):
    assert abs(consensus.digamma(np.array([x]))[0] - y) < 1e-8


def simulated(seed=0, items=400):
    rng = random.Random(seed)
    truth = {f"i{k}": rng.choice(consensus.CLASSES) for k in range(items)}
    votes = []
    for item, t in truth.items():
        for a in range(5):
            if a < 3:
                label = t if rng.random() < 0.8 else rng.choice(consensus.CLASSES)
            elif a == 3:  # swaps the ends
                label = {"Negative": "Positive", "Positive": "Negative"}.get(t, t) if rng.random() < 0.9 else rng.choice(consensus.CLASSES)
            else:  # always the same
                label = "Neutral"
            votes.append((item, f"a{a}", label))
    return truth, votes


def test_beats_the_majority(spark):
    truth, votes = simulated()
    model, items = consensus.fit(spark.createDataFrame(votes, SCHEMA))
    got = {r.item: r.label for r in consensus.consensus(model, items).collect()}
    accuracy = sum(got[i] == t for i, t in truth.items()) / len(truth)
    by: dict[str, list[str]] = {}
    for i, _, label in votes:
        by.setdefault(i, []).append(label)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in by.items()) / len(truth)
    assert accuracy > majority and accuracy > 0.9
    r = {(x.annotator_id, x.true_label): x for x in consensus.reliability(model, spark).collect()}
    assert r["a0", "all"].p_correct > 0.7 and r["a3", "Negative"].p_correct < 0.3 and r["a4", "Neutral"].p_correct > 0.9
    assert all(0 <= x.p_low <= x.p_correct <= x.p_high <= 1 for x in r.values())


def test_order_of_rows_does_not_matter(spark):
    _, votes = simulated(2, 60)
    out = []
    for data in (votes, votes[::-1]):
        model, items = consensus.fit(spark.createDataFrame(data, SCHEMA).repartition(3))
        out.append(sorted((r.item, r.label, round(r.p, 6)) for r in consensus.consensus(model, items).collect()))
    assert out[0] == out[1]


def test_latest_votes(spark, rows):
    data = [
        ("c", "a", "pos", 1, 1), ("c", "a", "Negatif ", 2, 2), ("c", "b", "neu", 1, 3), ("c", "b", "", 2, 4), ("c", "d", "No Text", 1, 5), ("c", "e", None, None, 6), ("c", "f", "NETRAL", 1, 7), ("c", "f", "pos", 1, 8),
        (None, "a", "pos", 1, 9), ("c", None, "pos", 1, 10), ("d", "a", "pos", None, 11),
    ]
    df = spark.createDataFrame(data, "c string, w string, l string, at int, id int")
    assert rows(consensus.latest_votes(df, "c", "w", "l", "at", "id")) == [("c", "a", "Negative"), ("c", "f", "Positive"), ("d", "a", "Positive")]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model, items = consensus.fit(empty)
    assert consensus.consensus(model, items).count() == 0 and consensus.reliability(model, spark).count() == 0
    assert consensus.krippendorff(empty).first().alpha is None
    model, items = consensus.fit(spark.createDataFrame([("i", "a", "Neutral")], SCHEMA))
    assert consensus.consensus(model, items).first().label == "Neutral"
    with pytest.raises(ValueError):
        consensus.fit(spark.createDataFrame([("i", "a", "Neutral"), ("i", "b", "Neutral")], SCHEMA), max_annotators=1)


def test_alpha_extremes(spark):
    same = [(f"i{k}", f"a{j}", consensus.CLASSES[k % 3]) for k in range(9) for j in range(3)]
    assert consensus.krippendorff(spark.createDataFrame(same, SCHEMA)).first().alpha == 1.0
    one = [(f"i{k}", f"a{j}", "Neutral") for k in range(3) for j in range(2)]
    assert consensus.krippendorff(spark.createDataFrame(one, SCHEMA)).first().alpha is None
