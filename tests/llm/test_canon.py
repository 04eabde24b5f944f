"""Look-alike texts (problem 1)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelindan.llm import canon


def form(text, *others):
    counts: dict[str, int] = {}
    for t in (text, *others, "abcdefghijklmnopqrstuvwxyz ABC" * 3):
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    return canon.Rewriter(canon.rewrite_table(counts))(text)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ａｂｃ", "abc"), ("pаsar", "pasar"), ("a​b­c", "abc"), ("a b　c", "a b c"), ("é", "é"), ("е́", "é"), ("ɡɑԁ", "gad"),
        ("  a \t\n b ", "a b"), ("ﬁn", "fin"), ("ậ", "ậ"), ("ＡΒС", "ABC"), ("x️", "x"),
        ("Ꮋꓮ", "HA"), ("Ӏ", "I"), ("i̇", "i"), ("﹣‑‐", "---"), ("ﺑ", "ب"), ("Гә", "Γə"), ("ⲟ", "o"),
    ],
)
def test_same_look(a, b):
    assert form(a, b) == form(b, a)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("²", "2"), ("l", "I"), ("0", "O"), ("½", "1/2"), ("a.", "a"), ("№", "No"), ("ı", "i"), ("rn", "m")])
def test_visible_differences_stay(a, b):
    assert form(a, b) != form(b, a)


def test_transitive_and_by_frequency():
    table = canon.rewrite_table({"а": 50, "a": 3, "ａ": 9})
    assert table["a"] == "а" and table["ａ"] == "а" and "а" not in table


def test_table_is_closed():
    """Whatever the frequencies, what the table writes holds nothing that it rewrites."""
    import random
    import sys
    import unicodedata

    rng = random.Random(2)
    known = [chr(i) for i in range(32, sys.maxunicode + 1) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]
    for _ in range(3):
        table = canon.rewrite_table({c: rng.randrange(1, 1000) for c in known})
        assert all(table.get(x, x) == x for to in table.values() for x in to)
        r = canon.Rewriter(table)
        for c in known:
            once = r(c)
            assert r(once) == once, hex(ord(c))


def test_stacked_sequences_end():
    r = canon.Rewriter(canon.rewrite_table({"i": 5, "\u0307": 1}))
    assert r("i" + "\u0307" * 50_00 + "x") == "ix" and r("\u0456\u0307") == "i"


def test_one_table_gives_one_form_in_both_fields(spark):
    """On the test tables a text gets the same form in captions and in comments."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    videos, comments = spark.read.parquet(f"{d}/video_metadata_clean.parquet"), spark.read.parquet(f"{d}/hcc_copypasta_candidates.parquet")
    table = canon.corpus_table((videos, "caption"), (comments, "normalized_comment"))
    own = canon.corpus_table((videos, "caption"))
    texts = [r[0] for r in videos.select("caption").where("caption is not null").distinct().collect()]
    both = {r.row_key: r.canonical for r in canon.with_canonical(videos.selectExpr("caption as row_key", "caption as text").where("text is not null"), "text", table=table).collect()}
    there = {r.row_key: r.canonical for r in canon.with_canonical(comments.sparkSession.createDataFrame([(t, t) for t in texts], "row_key string, text string"), "text", table=table).collect()}
    assert both == there and table and own


def test_copies_of_one_text_are_not_paired_with_each_other(spark):
    """400 copies of one text and one of another: 400 pairs, and the stored texts meet once."""
    df = spark.createDataFrame([(f"k{i:03d}", "pasar") for i in range(400)] + [("z", "pаsar")], "k string, text string")
    assert canon.same_looking_pairs(df, "k", "text", "t").count() == 400
    assert [tuple(r)[2:] for r in canon.same_looking_classes(df, "k", "text", "t").collect()] == [(401, 2)]


def test_idempotent_on_random_text():
    import random

    rng = random.Random(0)
    pool = "abc аɑａé́̈​　­ﬁЅοＫ½😍‍"
    texts = ["".join(rng.choice(pool) for _ in range(30)) for _ in range(300)]
    counts: dict[str, int] = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    r = canon.Rewriter(canon.rewrite_table(counts))
    assert all(r(r(t)) == r(t) for t in texts)


def test_pairs(spark, rows):
    data = [("k1", "pasar malam", 1), ("k2", "pаsar malam", 1), ("k3", "pasar malam", 1), ("k3", "pasar malam", 2), ("k4", None, 1), (None, "pasar malam", 1), ("k5", "Pasar malam", 1), ("k6", "", 1), ("k7", "​", 1)]
    df = spark.createDataFrame(data, "k string, text string, c int").withColumn("_canon", F.lit(0)).withColumn("h", F.lit("x"))
    got = rows(canon.same_looking_pairs(df, "k", "text", "t"))
    assert got == [("t", "k1", "k2"), ("t", "k2", "k3"), ("t", "k6", "k7")]
    assert canon.same_looking_pairs(df.limit(0), "k", "text", "t").count() == 0


def test_long_and_null(spark):
    df = spark.createDataFrame([("а" * 300_000,), (None,), ("",)], "text string")
    got = [r.canonical for r in canon.with_canonical(df, "text").collect()]
    assert len(got[0]) == 300_000 and got[1] is None and got[2] == ""
