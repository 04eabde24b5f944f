"""Hot keys, exact quantiles, folds, flags and search strings."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelindan.functions import textflags as X
from kelindan.operators import evidence as E
from kelindan.operators import graph as G
from kelindan.operators import models
from kelindan.operators import sampling as S
from kelindan.operators import skew
from kelindan.operators import textsim as T
from kelindan.operators.quantiles import exact_quantile


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, share):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=501), np.r_[np.zeros(400), rng.exponential(size=100) * 1e9], np.array([3.0]), np.array([1.0, 1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert exact_quantile(df, "v", share) == pytest.approx(float(np.quantile(values, share)), rel=1e-12)
    assert exact_quantile(df.limit(0), "v", share) is None


def test_gaps_of_a_hot_video_are_those_of_its_sorted_comments(spark):
    rng = random.Random(1)
    times = sorted(rng.randrange(0, 40 * 86_400) for _ in range(300))
    df = spark.createDataFrame([("v", t) for t in times] + [("w", 5), (None, 6), ("w", None)], "video string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = Counter(r.g for r in E.time_gaps(df).collect())
    assert got == Counter((b - a) * 1_000_000 for a, b in zip(times, times[1:]))
    plan = E.time_gaps(df)._jdf.queryExecution().toString()
    assert "hashpartitioning(video" in plan and "SinglePartition" not in plan


def test_no_single_partition_window(spark):
    """Allocation ranks no strata in one task, and the sample keeps a bounded number of rows a stratum before the shuffle."""
    df = spark.createDataFrame([(str(i % 7), i) for i in range(200)], "s string, k long")
    sample = S.stratified_sample(df, "s", "k", 10, 1)
    assert sample.count() == 10
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    head = S.head_and_fill(df, "s", [F.col("k")], 2, 5)
    assert Counter(r.part for r in head.collect()) == {"head": 14, "fill": 5} and "WindowGroupLimit" in head._jdf.queryExecution().executedPlan().toString()


def test_capped_pick_equals_the_greedy_walk(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("aaab"), rng.choice("xyyy") if rng.random() > 0.1 else None) for i in range(200)]
    df = spark.createDataFrame(data, "k long, c string, d string")
    caps, used, want = {"c": 6, "d": 5}, Counter(), []
    for k, c, d in data:
        if len(want) < 12 and used["c", c] < 6 and used["d", d] < 5:
            want.append(k)
            used["c", c] += 1
            used["d", d] += 1
    assert [r.k for r in S.capped_pick(df, [F.col("k")], caps, 12).collect()] == want


@pytest.mark.parametrize("ranked", [5000, 10])
def test_stratified_group_folds(spark, ranked):
    rng = random.Random(2)
    rows = [(f"g{g}", rng.choice(["p", "p", "n", None])) for g in range(400) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "g string, l string")
    folds = {r.g: r.fold for r in S.stratified_group_folds(df, "g", "l", 4, ranked_up_to=ranked).collect()}
    assert set(folds) == {g for g, _ in rows} and set(folds.values()) == set(range(4))
    for label in ("p", "n", None):
        sizes = Counter(folds[g] for g, x in rows if x == label)
        assert max(sizes.values()) - min(sizes.values()) <= (4 if ranked == 5000 else 0.5 * sum(sizes.values()) / 4)


def test_ties_outside_their_room_fail(spark):
    df = spark.createDataFrame([(10**15,)], "t long")
    with pytest.raises(Exception, match="tie lies outside"):
        df.select(skew.row_order(F.lit(None).cast("timestamp"), F.col("t"))).collect()


def test_bounded_lists_flags_and_maps(spark, rows):
    df = spark.createDataFrame([("k", f"v{i:02d}") for i in range(20)] + [("j", "a"), ("j", "a"), ("j", None), ("j", "")], "k string, v string")
    got = dict(rows(T.bounded_lists(df, "k", "v")))
    assert got["j"] == "a" and got["k"] == ";".join(f"v{i:02d}" for i in range(12)) + ";...(+8)"
    flags = G.pair_flags(F.col("a"), F.col("b"))
    one = spark.createDataFrame([(True, None), (True, True), (None, False)], "a boolean, b boolean").select(*[c.alias(n) for n, c in flags.items()])
    assert [tuple(r) for r in one.collect()] == [(True, False, False), (False, True, False), (False, False, True)]
    graph = spark.createDataFrame([("a", "b", 4), ("a", "c", 1), ("b", "c", 4)], "source string, target string, weight long")
    assert rows(G.visual_maps(graph), "target", "visual_rank", "opacity") == [("b", 1, 1.0), ("c", 1, 1.0), ("c", 2, 0.4)]


def test_search_strings_and_terms(spark):
    df = spark.createDataFrame([('kata "satu"  dua',), ("x" * 70,), ("kata " * 20,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(X.search_string(F.col("t"))).collect()]
    assert got == ['"kata satu dua"', '"' + "x" * 60 + '"', '"' + ("kata " * 12).strip() + '"', None, None]
    pattern = X.any_term(["a+b", "c.d"])
    assert [r[0] for r in spark.createDataFrame([("x a+b",), ("aab",), ("c.d!",), ("cxd",)], "t string").select(F.col("t").rlike(pattern)).collect()] == [True, False, True, False]


def test_models_are_saved_and_the_mean_of_two_must_gain(spark, tmp_path):
    df = spark.createDataFrame([(i, ("bagus sekali", "jelek sekali")[i % 2] + f" {i % 5}", float(i % 2)) for i in range(40)], "k long, text string, label double")
    model = models.fit(df, iterations=3)
    models.save(model, f"file://{tmp_path}/m")
    a, b = (models.probabilities(m, df) for m in (model, models.load(f"file://{tmp_path}/m")))
    assert a.orderBy("k").collect() == b.orderBy("k").collect()
    good = spark.createDataFrame([(0, 0.0, [0.9, 0.1]), (1, 1.0, [0.2, 0.8]), (2, 0.0, [0.4, 0.6])], "k long, label double, p array<double>")
    other = spark.createDataFrame([(0, 0.0, [0.4, 0.6]), (1, 1.0, [0.3, 0.7]), (2, 0.0, [0.9, 0.1])], "k long, label double, p array<double>")
    got = {r.model: r.chosen for r in models.top_two({"a": good, "b": other}, "k", ("n", "p")).collect()}
    assert got == {"a": False, "b": False, "a+b": True}
    assert {r.model: r.chosen for r in models.top_two({"a": good, "c": good}, "k", ("n", "p")).collect()} == {"a": True, "c": False, "a+c": False}
