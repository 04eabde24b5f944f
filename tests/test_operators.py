"""Boundary cases of the core operators."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kelindan.functions import normalize as N
from kelindan.functions.stats import bin_of, cut_right, softmax, wilson
from kelindan.operators import checks, evidence, graph, joins, metrics, profiles, sampling, textsim, typology
from kelindan.operators.components import connected_components, merge_components


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "name"), [("@ A b", "ab"), (" @@X ", "x"), ("nan", None), ("", None), (None, None), ("<NA>", None), ("@", None)])
def test_account(spark, text, name):
    assert one(spark, N.account(F.lit(text).cast("string"))) == name


def test_account_without_sentinels(spark):
    assert one(spark, N.account(F.lit("nan"), sentinels=False)) == "nan"


@pytest.mark.parametrize(("text", "key"), [("7237380000000000000", "7.23738E+18"), ("7.2E+18", "7.2E+18"), ("7000000000000000000", "7E+18"), ("x", None), (None, None)])
def test_lossy_id_key(spark, text, key):
    assert one(spark, N.lossy_id_key(F.lit(text).cast("string"))) == key


def test_times(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:01Z",), ("2024-01-01 07:00:01+07:00",), ("2024-01-01T00:00:01.000Z",), ("2024-01-01",), ("0000-00-00",), ("baru saja",), (None,)], "t string")
    assert [r.v for r in df.select(F.unix_seconds(N.utc_time(F.col("t"))).alias("v")).collect()] == [1704067201] * 3 + [None] * 4


def test_text_dialects(spark):
    t = F.lit("Lihat https://x.y/z @Ünï  #Tag !!!! +62 812 3456 789 aaaaaa")
    assert one(spark, N.display_text(t)) == "Lihat [URL] @USER #Tag !!!! [NUMBER] aaaaaa"
    assert one(spark, N.model_text(t)).startswith("Lihat URL USERMENTION Tag")
    assert "aaa" in one(spark, N.model_text(t, "squeezed")) and "aaaa" not in one(spark, N.model_text(t, "squeezed"))
    assert one(spark, N.similarity_text(F.lit("Ａ​B??  c"))) == "ab? c"
    assert one(spark, N.model_text(F.lit("a &amp; b\x07"), "plain")) == "a & b"


def test_url_param_and_joins_of_values(spark):
    assert one(spark, N.url_with_param(F.lit("https://v/x?b=2&comment_id=9#f"), "comment_id", F.lit("7"))) == "https://v/x?b=2&comment_id=7#f"
    assert one(spark, N.bounded_join(F.array(*map(F.lit, "cab")), 2)) == "a;b;...(+1)"
    assert one(spark, N.token_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, N.token_jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


def test_stats(spark):
    lo, hi = wilson(F.lit(0), F.lit(0))
    assert one(spark, lo) is None and one(spark, hi) is None
    assert one(spark, wilson(F.lit(0), F.lit(10))[0]) == 0.0
    assert [one(spark, x) for x in softmax([F.lit(0.0), F.lit(0.0)])] == [0.5, 0.5]
    assert one(spark, bin_of(F.lit(1.0))) == 9 and one(spark, bin_of(F.lit(0.1))) == 1 and one(spark, bin_of(F.lit(0.1), closed="right")) == 0
    assert one(spark, cut_right(F.lit(100), [0, 100, 200], ["a", "b"])) == "a"


COLUMNS = "comment_id string, username string, parent_user string, video string, ts timestamp"


def comments(spark, rows):
    return spark.createDataFrame(rows, "comment_id string, username string, parent_user string, video string, t long").withColumn("ts", F.timestamp_micros("t"))


def test_reply_weight_is_the_greater_direction(spark, rows):
    c = comments(spark, [("1", "a", "b", "v1", 0), ("2", "a", "b", "v1", 0), ("3", "b", "a", "v2", 0), ("4", "a", "a", "v1", 0), ("5", None, "a", "v1", 0)])
    assert rows(evidence.co_reply(c)) == [("a", "b", 3, 1, False)]


@pytest.mark.parametrize(("gaps", "window"), [([24], 1), ([150], 2), ([210], 4), ([], 1)])
def test_window_rounds_half_to_even(spark, gaps, window):
    times = [0, *itertools.accumulate(gaps)]
    c = comments(spark, [(str(i), "a", None, "v", t * 1_000_000) for i, t in enumerate(times)])
    assert evidence.calibrated_window(c).first().window_minutes == window


def test_window_edges(spark, rows):
    w = 9 * 60_000_000
    c = comments(spark, [("1", "a", None, "v", 0), ("2", "b", None, "v", w), ("3", "c", None, "v", 2 * w + 1), ("4", "a", None, "v", 5), ("5", "d", None, None, 0), ("6", "e", None, "v", None)])
    assert rows(evidence.co_temporal(c, 9, least=1)) == [("a", "b", 1)]


def test_band_join_equals_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("xy"), rng.randrange(0, 200)) for i in range(60)]
    right = [(i, rng.choice("xy"), rng.randrange(0, 200)) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, ta long"), spark.createDataFrame(right, "j int, k string, tb long")
    got = {(r.i, r.j) for r in evidence.band_pairs(a, b, ["k"], "ta", "tb", 17).collect()}
    assert got == {(i, j) for i, k, t in left for j, m, u in right if k == m and 0 <= u - t <= 17}


def test_co_conv_needs_least_common_videos(spark, rows):
    seen = spark.createDataFrame([(u, v) for u, vs in (("a", "123"), ("b", "1234"), ("c", "12")) for v in vs], "username string, video string")
    side = lambda *u: spark.createDataFrame([(x,) for x in u], "username string")
    assert rows(evidence.co_conv(seen, side("a"), side("b", "c"))) == [("a", "b", 3)]
    assert rows(evidence.co_conv(seen, side("a", "b"), side("a", "b"))) == [("a", "b", 3)]


def test_combine_with_an_empty_kind(spark):
    w = lambda *r: spark.createDataFrame(list(r), "source string, target string, weight double")
    got = {(r.source, r.target): r for r in evidence.combine(w(("a", "b", 4.0), ("a", "c", 2.0)), w(("a", "b", 1.0)), w()).collect()}
    assert got["a", "b"].final_weight == 2.0 and got["a", "b"].evidence == "Co-conv + Co-reply" and got["a", "c"].final_weight == 0.5 and got["a", "c"].evidence == "Co-conv only"
    assert not math.isnan(got["a", "c"].co_temporal_norm)


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5)], [(7, 7)], [(1, 2), (2, 1), (1, 2)], [], [(None, 1), (5, 6)], [(9, x) for x in range(50)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and b is not None:
            want.setdefault(a, {a})
            want.setdefault(b, {b})
            group = want[a] | want[b]
            for x in group:
                want[x] = group
    assert got == {k: min(v) for k, v in want.items()}


def test_components_random(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent}


def test_components_merge(spark):
    first = [(1, 2), (3, 4), (5, 6), (8, 9)]
    more = [(4, 6), (7, 2), (11, 12), (12, 13), (8, 9)]
    df = lambda e: spark.createDataFrame(e, "src long, dst long")
    got = {r.node: r.component for r in merge_components(connected_components(df(first)), df(more)).collect()}
    assert got == {r.node: r.component for r in connected_components(df(first + more)).collect()}


def test_betweenness_and_louvain():
    path = [("a", "b", 1.0), ("b", "c", 1.0)]
    assert graph.betweenness_of(path) == {"a": 0.0, "b": 1.0, "c": 0.0}
    clique = lambda names: [(x, y, 1.0) for x, y in itertools.combinations(names, 2)]
    got = graph.louvain_of([*clique("abcd"), *clique("wxyz"), ("d", "w", 1.0)])
    assert {got[x] for x in "abcd"} == {"a"} and {got[x] for x in "wxyz"} == {"w"}
    members, mean = graph.focal_of([*clique("abc"), ("c", "d", 0.1)], 0.9)
    assert members == ["a", "b", "c"] and mean == 1.0
    assert graph.focal_of([], 1.0) == ([], 0.0)


def test_graph_tables(spark, rows):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("b", "c", 1.0), ("x", "x", 1.0), ("", "c", 1.0)], "source string, target string, w double")
    assert ("a", 2, 1, 3.0) in rows(graph.degrees(e, "w"))
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert rows(graph.topology_audit(e, nodes)) == [(5, 1, 1, 1, 3)]
    reasons = {r.source + r.target: r.reasons for r in graph.clean_edges(e, nodes, spark.createDataFrame([("c",)], "node string")).collect()}
    assert reasons["ab"] == "" and reasons["bc"] == "artefact node; missing node" and reasons["xx"] == "self loop; missing node"
    assert graph.structural_hash(e, "source", "target").first() == graph.structural_hash(e.orderBy(F.desc("w")), "source", "target").first()


def test_per_group_refuses_large_groups(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "source string, target string, w double")
    groups = spark.createDataFrame([(x, "a") for x in "abc"], "node string, component string")
    assert graph.per_group(e, groups, "betweenness", "w").count() == 3
    with pytest.raises(ValueError):
        graph.per_group(e, groups, "louvain", "w", largest=1)


def test_winner_ties_and_tiers(spark):
    s = spark.createDataFrame([("u", 1, 0, 2, 0), ("u", 2, 0, 2, 9), ("v", 1, 1, 0, 0), ("v", 2, 0, 5, 9)], "username string, hcc_id long, direct long, temporal long, shared long")
    got = {r.username: r for r in typology.primary_group(s).collect()}
    assert got["u"].primary_group is None and got["u"].ambiguous and got["u"].fractional_weight == 0.5
    assert got["v"].primary_group == 1 and got["v"].tier == "direct"


def test_backward_window_edges(spark, rows):
    m = spark.createDataFrame([(1, "v", 100)], "id int, v string, t1 long")
    h = spark.createDataFrame([("g", "v", 40), ("g", "v", 100), ("g", "v", 101), ("g", "v", 39)], "g string, v string, t0 long")
    assert rows(joins.backward_window(m, h, ["v"], "t1", "t0", 60, "id", "g")) == [(1, "g", 2, 0, 30.0)]


def test_staged_join_takes_first_stage(spark):
    facts = spark.createDataFrame([("7", "u"), ("x", "u"), ("x", "w"), (None, None)], "id string, url string")
    dims = spark.createDataFrame([("7", "q", 1), ("7", "u", 0), ("8", "u", 2)], "d string, e string, n int")
    got = joins.staged_join(facts, dims, [("id", F.col("id"), F.col("d")), ("url", F.col("url"), F.col("e"))], "n", [F.col("n")])
    assert sorted((r.match_id is None, r.match_id, r.match_stage) for r in got.collect() if r.match_id is not None) == [(False, 0, "id"), (False, 0, "url")]


def test_unique_and_reconcile(spark, rows):
    ok = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.assert_unique(ok, ["k"]).count() == 2
    with pytest.raises(Exception):
        joins.assert_unique(ok.unionByName(ok), ["k"]).collect()
    a, b = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double"), spark.createDataFrame([(1, 1.0 + 1e-12), (2, None), (3, 1.0)], "k int, v double")
    assert [r[-2:] for r in rows(joins.reconcile(a, b, ["k"], "v"))] == [("both", True), ("both", True), ("right_only", False)]


def test_fuzzy_pairs_equal_brute_force(spark):
    import difflib

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefg ") for _ in range(120)) for _ in range(6)]
    texts = [*base, *[b[:40] + "x" + b[41:] for b in base], *[b + "yy" for b in base[:3]], "short", "", None, base[0]]
    df = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "k string, t string")
    got = {(r.key_1, r.key_2) for r in joins.fuzzy_pairs(df, "k", "t").collect()}
    first = {}
    for i, t in enumerate(texts):
        if t and len(t) >= 8:
            first.setdefault(t, f"{i:02d}")
    want = {tuple(sorted((k, m))) for (s, k), (t, m) in itertools.combinations(first.items(), 2) if difflib.SequenceMatcher(None, *(s, t) if k < m else (t, s), autojunk=False).ratio() >= 0.96}
    assert got == want


def test_metrics(spark):
    cells = spark.createDataFrame([("a", "a", 5), ("a", "b", 1), ("b", "b", 4)], "truth string, pred string, n long")
    s = metrics.summary(cells, ["a", "b", "c"]).first()
    assert s.n == 10 and s.accuracy == 0.9 and 0 < s.macro_f1 < 0.67
    assert abs(metrics.kappa(cells, ["a", "b"]).first().kappa - 0.8) < 1e-9
    same = spark.createDataFrame([("a", "a", 5)], "truth string, pred string, n long")
    assert metrics.kappa(same, ["a", "b"]).first().kappa is None
    boot = metrics.bootstrap_macro_f1(cells, ["a", "b"]).first()
    assert boot.ci_low <= boot.macro_f1 <= boot.ci_high
    assert metrics.bootstrap_macro_f1(cells.limit(0), ["a"]).first().macro_f1 == 0.0
    pairs = spark.createDataFrame([(True, False)] * 14 + [(False, True)] * 2, "x boolean, y boolean")
    assert abs(metrics.mcnemar(pairs, F.col("x"), F.col("y")).first().p_value - 0.0041809) < 1e-5


def test_abstaining_label(spark):
    p = {"A": F.col("a"), "B": F.col("b")}
    df = spark.createDataFrame([(0.5, 0.5, True), (0.42, 0.1, True), (0.41, 0.1, True), (0.9, 0.1, False)], "a double, b double, t boolean")
    assert [r.v for r in df.select(metrics.abstaining_label(p, F.col("t")).alias("v")).collect()] == ["A", "A", "Uncertain", "No Text"]


def test_threshold_curve_equals_direct_counts(spark):
    rng = random.Random(0)
    data = [(rng.random(), rng.random() < 0.4) for _ in range(300)] + [(None, True), (0.5, None)]
    cuts = [0.1, 0.5, 0.9, 2.0]
    got = {r.threshold: (r.selected, r.tp) for r in metrics.threshold_curve(spark.createDataFrame(data, "s double, y boolean"), F.col("s"), F.col("y"), cuts).collect()}
    valid = [(s, y) for s, y in data if s is not None and y is not None]
    assert got == {c: (sum(s >= c for s, _ in valid), sum(y for s, y in valid if s >= c)) for c in cuts}


def test_allocation_sums_up(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",)], "s string")
    assert {r.s: r.allocated for r in sampling.largest_remainder(df, "s", 5).collect()} == {"a": 4, "b": 1, "c": 0}
    assert {r.s: r.allocated for r in sampling.largest_remainder(df, "s", 5, least=1).collect()} == {"a": 2, "b": 2, "c": 1} or sum(r.allocated for r in sampling.largest_remainder(df, "s", 5, least=1).collect()) == 5


def test_samples_repeat(spark, rows):
    df = spark.range(200).select("id", (F.col("id") % 4).cast("string").alias("s"))
    a, b = (rows(sampling.stratified_sample(df.repartition(n), "s", "id", 20, 7), "id") for n in (2, 5))
    assert a == b and len(a) == 20
    folds = sampling.group_folds(df, "s", 3)
    assert folds.groupBy("s").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_quota_and_leaks(spark, rows):
    df = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0) for i in range(12)], "k int, a boolean, b boolean")
    got = rows(sampling.quota_pick(df, "k", [("a", F.col("a"), 3), ("b", F.col("b"), 3)], [F.col("k")]), "k", "rule")
    assert got == [(0, "a"), (2, "a"), (3, "b"), (4, "a"), (6, "b"), (9, "b")]
    r = spark.createDataFrame([(1, "c", "test"), (2, "c", "dev"), (3, "d", "dev"), (4, None, "dev"), (5, "e", None)], "id int, c string, role string")
    assert rows(sampling.without_leaks(r, "c", "role", ["test"]), "id") == [(1,), (3,), (4,), (5,)]
    assert rows(sampling.split_leaks(r, "c", "role")) == [("c", 2)]


def test_exact_groups_count_pairs(spark, rows):
    df = spark.createDataFrame([("t", "a", "v")] * 3 + [("t", "b", "w"), ("u", "a", "v"), (None, "a", "v"), ("", "a", "v"), ("t", None, "v")], "x string, u string, v string")
    assert rows(textsim.exact_groups(df, "x", "u", "v")) == [("t", 5, 2, 2, 10, 3, 7)]


def test_grams_pad_words(spark):
    got = one(spark, textsim.grams_of(F.lit("ab  cdefg"), 5))
    assert got == [" ab ", " cdef", "cdefg", "defg "]


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9))) for _ in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(40)]
    texts += [t + " " + words[0] for t in texts[:15]]
    d = textsim.distinct_texts(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string"), "t")
    v = textsim.tfidf(d)
    vec = {}
    for r in v.collect():
        vec.setdefault(r.text_id, {})[r.gram] = r.w
    want = {(a, b) for a, b in itertools.combinations(sorted(vec), 2) if sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= 0.7}
    got = {(r.a, r.b) for r in textsim.similar_texts(v).collect()}
    assert got == want and got


def test_numbering_is_total(spark):
    df = spark.range(137).select((F.col("id") * 7 % 137).alias("k"))
    got = {r.k: r.number for r in textsim.numbered(df, [F.col("k")], "N_", 5, buckets=4).collect()}
    assert got == {k: f"N_{k + 1:05d}" for k in range(137)}


def test_profiles(spark, rows):
    p = spark.createDataFrame([(1, "b", 2, 2, 4), (1, "a", 2, 2, 0), (1, "c", 5, 5, 5)], "hcc_id long, hashtag string, frequency long, n_videos long, n_users_exposed long")
    assert [r[1] for r in rows(profiles.top_tags(p, 2))] == ["a", "c"]
    assert profiles.group_summary(p).first().top_list == "c;a;b"
    assert {r.hashtag: r.rate for r in profiles.ranked_tags(p).collect()} == {"b": 0.5, "a": None, "c": 1.0}
    c = spark.createDataFrame([("All", "a", "v")], "scope string, username string, video string").withColumn("ts", F.to_timestamp(F.lit("2024-01-07 18:00:00")))
    grid = profiles.time_grid(c, "scope")
    assert grid.count() == 168 and rows(grid.where("n_comments > 0"), "weekday_number", "hour_local") == [(1, 1)]


def test_gates(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    audit = checks.gates(df, [("n", F.count(F.lit(1)), "==", 2), ("max", F.max("x"), "<", 1), ("none", F.max(F.lit(None).cast("double")), ">=", 0)])
    assert [r.passed for r in audit.collect()] == [True, False, False]
    assert checks.all_passed(audit).first().status == "REJECTED"
    assert checks.all_passed(audit.limit(0)).first().status == "REJECTED"
