"""Queries do the whole job: no account, copy, pair, edge or candidate is left out for cost."""

from __future__ import annotations

import difflib
import itertools
import math
import random
import statistics

import numpy as np
import pytest

import __spark_entry__ as entry
from kelindan.llm import consensus, pii
from kelindan.operators import evidence, graph, joins, textsim
from kelindan.operators.components import connected_components
from kelindan.session import stage


def test_shared_items_pair_all_accounts(spark, tmp_path, rows):
    # residues of 10 that j8_shared_items has on neither side, or twice on one
    seen = {2: "abcd", 12: "abc", 7: "bcd", 17: "ab", 30: "abcd"}
    data = [(i, u, f'{{"k": "{v}"}}', "2024-01-01 00:00:00", "view", 1.0) for i, (u, v) in enumerate((u, v) for u, vs in seen.items() for v in vs)]
    df = spark.createDataFrame([*data, data[0]], "event_id long, user_id long, props string, ts string, event_type string, value double")
    df.selectExpr("event_id", "user_id", "props", "cast(ts as timestamp_ntz) as ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted((*sorted((str(u), str(v))), n) for u, v in itertools.combinations(seen, 2) if (n := len({*seen[u]} & {*seen[v]})) >= 3)
    assert rows(entry.queries()["j8_all_shared_items"](spark, str(tmp_path)), "source", "target", "co_conv_weight") == sorted(want, key=repr) and want


def test_text_clusters_count_every_copy(spark, tmp_path, rows):
    long = "the same words are written here, over and over again"
    texts = [long, long + "!", long, long + "!", "alone in this table, twice", "alone in this table, twice", "ok", "ok", "ok", "one of its kind", "", None]
    df = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "candidate_id string, normalized_comment string")
    df.write.parquet(f"{tmp_path}/hcc_copypasta_candidates.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path))
    assert rows(run("t26_identical_clusters"), "component", "n") == [("00", 4), ("04", 2), ("06", 3), ("09", 1), ("10", 1)]
    ids = dict(rows(run("j18_text_members"), "key", "text_id"))
    assert len(ids) == 11 and [(r.key_1, r.key_2) for r in run("j18_fuzzy_pairs").collect()] == [("00", "01")]
    assert {k for k, t in ids.items() if t in ("00", "01")} == {"00", "01", "02", "03"}


def test_group_similarity_is_over_all_pairs(spark):
    rng = random.Random(5)
    vectors, groups = [], []
    for k in range(60):
        raw = {f"g{rng.randrange(40)}": rng.random() for _ in range(4)} if k % 9 else {}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        vectors += [(k, g, x / norm) for g, x in raw.items()]
        groups.append((k, k % 3))
    vectors += [(k, "only", 1.0) for k in (100, 101)] + [(200, "only", 1.0)]
    groups += [(100, 7), (101, 7), (200, 8), (60, 9), (61, 9)]  # all alike, one text, and texts without grams
    got = {r.group_id: r for r in textsim.group_similarity(spark.createDataFrame(vectors, "text_id long, gram string, w double"), spark.createDataFrame(groups, "text_id long, group_id long"), block=7).collect()}
    vec = {}
    for k, g, w in vectors:
        vec.setdefault(k, {})[g] = w
    for group in {g for _, g in groups}:
        own = [k for k, g in groups if g == group]
        dots = [sum(w * vec.get(b, {}).get(g, 0.0) for g, w in vec.get(a, {}).items()) for a, b in itertools.combinations(own, 2)]
        r = got[group]
        assert (r.n_texts, r.n_pairs, r.n_070, r.n_085) == (len(own), len(dots), sum(x >= 0.7 for x in dots), sum(x >= 0.85 for x in dots))
        if not dots:
            assert (r.mean, r.median, r.most) == (None, None, None)
            continue
        # the mean in closed form: |sum of unit vectors|^2 - number of unit vectors is twice the sum of cosines
        total = {}
        for k in own:
            for g, w in vec.get(k, {}).items():
                total[g] = total.get(g, 0.0) + w
        closed = (sum(x * x for x in total.values()) - sum(k in vec for k in own)) / 2 / len(dots)
        assert (r.mean, r.median, r.most) == (pytest.approx(closed, abs=1e-8), pytest.approx(statistics.median(dots), abs=1e-8), pytest.approx(max(dots), abs=1e-8))
    assert got[0].median < 0.6 and got[9].most == 0.0


def test_betweenness_in_blocks_equals_one_task(spark):
    rng = random.Random(4)
    e = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(55)} | {(90, 91), (95, 96), (96, 97)}
    data = [(f"{a:02d}", f"{b:02d}", 1.0) for a, b in e]
    edges = spark.createDataFrame(data, "source string, target string, w double")
    groups = connected_components(edges, "source", "target")
    own = {r.node: r.component for r in groups.collect()}
    want = {v: x for c in set(own.values()) for v, x in graph.betweenness_of([r for r in data if own[r[0]] == c]).items()}
    got = {r.node: r.score for r in graph.betweenness(edges, groups, block=7, batch=3).collect()}
    assert got == pytest.approx(want, abs=1e-12) and max(got.values()) > 0


def test_graph_queries_take_the_combined_graph(spark):
    d = "/root/testdata/sf0.001"
    nodes = {x for r in entry.queries()["c7_combined"](spark, d).collect() for x in (r.source, r.target)}
    for name in ("g4_betweenness", "g5_louvain"):
        assert {r.node for r in entry.queries()[name](spark, d).collect()} == nodes


def test_number_spans_have_no_index_cap():
    text = "0812 3456 7890 0813 1111 2222 0857 3333 4444"
    got = {text[s.start : s.end] for s in pii.candidates(text, {}) if s.kind == "phone"}
    assert {"0812 3456 7890", "0813 1111 2222", "0857 3333 4444"} <= got
    digits = " ".join("081234567890" * 2)
    spans = {(s.start, s.end) for s in pii.candidates(digits, {}) if s.kind == "phone"}
    assert {(0, 23), (24, 47)} <= spans


def test_name_parts_are_learnt_from_all_texts(spark):
    texts = [f"nama saya Tari {w} ya {i}" for w in ("Zorvalen", "Quistara") for i in range(4)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "pair_id string, comment_2 string")
    parts = spark.createDataFrame([("Tari", "given")], "name_part string, part_kind string")
    d = pii.fit_detector(df, "pair_id", "comment_2", parts, sample_texts=2)
    assert d.parts["zorvalen"] == d.parts["quistara"] == "family"
    assert pii.corpus_parts(df, "comment_2", {"tari": "given"}) == pii.learnt_parts(sorted(texts), {"tari": "given"})


def test_consensus_rounds_do_not_stop_earlier_on_many_votes(spark):
    rng = random.Random(6)
    truth = {f"i{i}": rng.choice(consensus.CLASSES) for i in range(600)}
    votes = [(i, f"a{k}", t if rng.random() < 0.7 else rng.choice(consensus.CLASSES)) for i, t in truth.items() for k in rng.sample(range(150), 3)]
    model, _ = consensus.fit(spark.createDataFrame(votes, "item string, annotator string, label string"), tol=2e-3)
    # each round moves a cell by far less than that share of all votes long before an annotator's own settle
    assert model.rounds > 3


def test_similar_texts_shuffle_no_meetings(spark):
    rng = random.Random(8)
    words = [f"kata{i}panjang" for i in range(12)]
    data = [(k, " ".join(rng.choices(words, k=6))) for k in range(90)] + [(k, "kata satu dua") for k in (200, 201)] + [(300, "")]
    vectors = textsim.tfidf(spark.createDataFrame(data, "text_id long, text string"))
    own = {}
    for r in vectors.collect():
        own.setdefault(r.text_id, {})[r.gram] = r.w
    want = {(a, b): s for a, b in itertools.combinations(sorted(own), 2) if (s := sum(w * own[b].get(g, 0.0) for g, w in own[a].items())) >= 0.7}
    for block in (7, 4096):
        found = textsim.similar_texts(vectors, block=block)
        # the meetings of all pairs stay within the tasks that make them
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.a, r.b): r.score for r in found.collect()} == pytest.approx({k: min(s, 1.0) for k, s in want.items()}) and want


def test_nearest_texts_break_ties_by_text(spark, tmp_path, rows):
    # the last word is in one text only, so has no weight: all cosines are 1, and of 25 others twenty count
    texts = [f"kulit kering serum bagus sekali w{i:02d}x" for i in range(26)]
    spark.createDataFrame([(t,) for t in texts], "normalized_comment string").write.parquet(f"{tmp_path}/hcc_copypasta_candidates.parquet")
    want = {tuple(sorted((a, b))) for a in texts for b in [x for x in texts if x != a][:20]}
    assert rows(entry.queries()["t5_nearest"](spark, str(tmp_path))) == [(*p, 1.0) for p in sorted(want)] and len(want) < 325


def test_accounts_of_a_hot_video_do_not_all_meet(spark, rows, monkeypatch):
    rng = random.Random(9)
    data = [(f"u{k:03d}", "hot", rng.randrange(100)) for k in range(200) for _ in range(2)] + [(f"u{k:03d}", f"v{k % 20}", rng.randrange(100)) for k in range(60)]
    data += [("u001", v, 50) for v in ("v2", "v3", "v4")]  # u001 is on videos of u002, u003 and u004
    side = lambda k: int(u[1:]) % 4 == 0 if (u := k) else False
    df = spark.createDataFrame(data, "username string, video string, minute int").selectExpr("username", "video", "timestamp_micros(minute * 60000000L) as ts")
    left, right = (df.where(f"{'' if x else 'not '}(cast(substr(username, 2) as int) % 4 = 0)").select("username").distinct() for x in (1, 0))
    shared, near = {}, {}
    for (u, v, s), (x, w, t) in itertools.product(data, data):
        if v == w and u < x and side(u) != side(x):
            shared.setdefault((u, x), set()).add(v)
            if abs(s - t) <= 30:
                near.setdefault((u, x), set()).add(v)
    over = lambda d: sorted((*p, len(v)) for p, v in d.items() if len(v) >= 2)
    sizes = []

    def spy(f, name):
        out = stage(f, name)
        sizes.append(out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(evidence, "stage", spy)
    assert rows(evidence.co_conv(df.select("username", "video").distinct(), left, right, 2)) == over(shared) and over(shared)
    assert rows(evidence.co_temporal(df, 30, left, right, 2)) == over(near) and over(near)
    assert 0 < max(sizes) < 200  # of 7,500 pairs on the hot video


def test_few_edges_take_no_rounds(spark, rows, monkeypatch):
    rng = random.Random(12)
    data = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    names = []
    monkeypatch.setattr("kelindan.operators.components.stage", lambda f, name: names.append(name) or stage(f, name))
    for kind in ("long", "string"):
        edges = spark.createDataFrame(data, "src long, dst long").selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst")
        got = rows(connected_components(edges), "node", "component")
        assert names.count("stars") == 1 and got == rows(connected_components(edges, few=0), "node", "component")
        names.clear()


def test_dense_items_are_counted_in_blocks(spark, rows):
    rng = random.Random(13)
    own = {f"u{k}": {f"v{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))} for k in range(70)}
    seen = stage(spark.createDataFrame([(u, v) for u, vs in own.items() for v in vs], "username string, video string"), "seen")
    want = sorted((a, b, n) for a, b in itertools.combinations(sorted(own), 2) if (n := len(own[a] & own[b])) >= 3)
    found = evidence.shared_items(seen)
    assert rows(found) == sorted(want, key=repr) and want
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()  # no meeting is shuffled
    every = seen.select("username").distinct()
    assert rows(evidence.co_conv(seen, every, every)) == sorted(want, key=repr)


def test_fuzzy_pairs_in_blocks_lose_none(spark):
    rng = random.Random(14)
    base = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (9, 30, 80, 120, 200) for _ in range(6)]
    texts = base + [t[:p] + rng.choice("xyz") * rng.randrange(3) + t[p + 1 :] for t in base for p in (0, len(t) // 2, len(t) - 1)]
    df = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "k string, t string")
    first = {t: f"{k:03d}" for k, t in reversed([*enumerate(texts)])}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    want = {tuple(sorted((first[x], first[y]))) for x, y in itertools.combinations(first, 2) if min(len(x), len(y)) >= 8 and max(ratio(x, y), ratio(y, x)) >= 0.96}
    found = joins.fuzzy_pairs(df, "k", "t", block=11)
    assert {(r.key_1, r.key_2) for r in found.collect()} == want and len(want) > 30
    assert "shared >= need" not in found._jdf.queryExecution().toString()  # no meeting is shuffled


@pytest.mark.parametrize("least", [2, 3])
def test_one_meeting_gives_shared_and_near(spark, rows, least):
    rng = random.Random(15)
    data = [(f"u{k:02d}", v, rng.randrange(200)) for k in range(40) for v in ("hot", "warm", *(f"v{rng.randrange(25)}" for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(3))]
    data += [("u38", f"w{i}", 0) for i in range(3)] + [("u39", f"w{i}", 30) for i in range(3)] + [("u38", "hot", None), (None, "hot", 1), ("u37", None, 1)]
    df = spark.createDataFrame(data, "username string, video string, minute int").selectExpr("username", "video", "timestamp_micros(minute * 60000000L) as ts")
    side = lambda u: 1 + int(u[1:]) % 2
    sides = spark.createDataFrame([(f"u{k:02d}", 1 + k % 2) for k in range(40)], "username string, s int")
    shared, near = {}, {}
    for (u, v, s), (x, w, t) in itertools.product(data, data):
        if u and x and v and v == w and u < x and side(u) != side(x):
            shared.setdefault((u, x), set()).add(v)
            if None not in (s, t) and abs(s - t) <= 30:
                near.setdefault((u, x), set()).add(v)
    conv, temporal = evidence.shared_and_near(df, sides, 30, least)
    over = lambda d: sorted(((*p, len(v)) for p, v in d.items() if len(v) >= least), key=repr)
    assert rows(conv) == over(shared) and over(shared)
    assert rows(temporal) == over(near) and over(near) and over(near) != over(shared)


def test_combined_edges_meet_once_and_sort_few_comments(spark, monkeypatch):
    sizes = {}

    def spy(f, name):
        out = stage(f, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(evidence, "stage", spy)
    entry.queries()["c7_combined"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/comments.parquet").count()
    # accounts meet once for both kinds of evidence; of the comments only those with a repeated id are ordered
    assert len(sizes["ranked"]) == len(sizes["met"]) == 1 and 0 < sizes["repeated"][0] < n / 10


def test_first_crawl_of_repeated_ids(spark, rows):
    data = [("1", 2, "b"), ("1", 1, "z"), ("1", 1, "c"), ("2", 5, None), (None, 0, "a"), (None, 0, "a"), ("3", 1, "q"), ("3", 1, "q")]
    df = spark.createDataFrame(data, "id string, at int, text string")
    from pyspark.sql import functions as F

    assert rows(evidence.keep_first_of_few(df, "id", [F.col("at"), F.col("text")])) == [("1", 1, "c"), ("2", 5, None), ("3", 1, "q")]


def test_edge_summary_prepares_comments_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr("kelindan.plans.domain.stage", lambda f, name: names.append(name) or stage(f, name))
    entry.queries()["g13_edge_summary"](spark, "/root/testdata/sf0.001")
    assert names.count("comments") == 1


def test_density_meets_accounts_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(evidence, "stage", lambda f, name: names.append(name) or stage(f, name))
    entry.queries()["g7_density"](spark, "/root/testdata/sf0.001")
    assert names.count("met") == names.count("ranked") == 1


def test_hanging_trees_are_counted_and_not_searched():
    rng = random.Random(16)
    ring = [(k, (k + 1) % 9) for k in range(9)] + [(0, 4), (2, 7)]
    e = ring + [(rng.randrange(k), k) for k in range(9, 60)]
    for edges in (e, [(rng.randrange(k), k) for k in range(1, 30)], [(0, 1)]):
        n = 1 + max(max(x) for x in edges)
        i, j = (np.array(x) for x in zip(*edges, strict=True))
        core, mass, score = graph._stripped(i, j, n)
        assert core.sum() == (9 if edges is e else 1) and mass[core].sum() == n
        want = graph.betweenness_of([(str(a), str(b), 1.0) for a, b in edges])
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
        assert all(score[v] * scale == pytest.approx(want[str(v)], abs=1e-12) for v in range(n) if edges is not e or not core[v])


def test_gram_weights_shuffle_texts_not_grams(spark):
    data = [(k, f"kata{k % 5}panjang sekali kata{k % 7}") for k in range(60)] + [(3, "tambahan kata3panjang")]
    found = textsim.tfidf(spark.createDataFrame(data, "text_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text_id" in plan and "hashpartitioning(gram" not in plan and ", gram#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    sums = {}
    for r in found.collect():
        sums[r.text_id] = sums.get(r.text_id, 0.0) + r.w**2
    assert len(sums) == 60 and list(sums.values()) == pytest.approx([1.0] * 60)


def test_nearest_comments_stage_no_weights(spark, tmp_path, monkeypatch):
    names = []
    for module in ("kelindan.plans.further", "kelindan.operators.textsim"):
        monkeypatch.setattr(f"{module}.stage", lambda f, name: names.append(name) or stage(f, name))
    spark.read.parquet("/root/testdata/sf0.001/comments.parquet").limit(60).write.parquet(f"{tmp_path}/comments.parquet")
    entry.queries()["t5_nearest_comments"](spark, str(tmp_path))
    assert "blocks" in names and "tfidf" not in names
