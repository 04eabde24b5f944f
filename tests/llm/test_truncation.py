"""Cut texts (problem 10)."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kelindan.llm import truncation

SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Selesai.", "done"), ("apa?!", "done"), ("kata “ini”.", "done"), ("lanjut…", "ellipsis"), ("lanjut...", "ellipsis"), ("lanjut [...]", "said"), ("lanjut… lihat lainnya", "said"), ("senang 😍", "mark"), ("lihat https://a.example/x/", "link"), ("lihat https://a.ex", "link"), ("lihat https:/", "broken"),
        ("coba #tag", "tag"), ("harga Rp12.000", "number"), ("harga Rp12.0", "broken"), ("pakai &am", "broken"), ("pakai &amp;", "mark"), ("orang 👩🏽‍", "broken"), ("lalu,", "broken"), ("lalu (", "broken"), ("seg�", "broken"), ("lalu kata", "word"),
        ("Bagus. wkwk", "aside"), ("", "blank"), (" \n", "blank"), ("isi 20", "number"),
    ],
)
def test_tails(text, kind):
    assert truncation.tail_of(text)[0] == kind


def corpus(seed=0, n=3000, limit=120):
    rng = random.Random(seed)
    nouns = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(3, 5))) for _ in range(60)]
    joins = ["karena", "supaya", "walau", "sambil", "setelah"]
    rows, cut = [], set()
    for i in range(n):
        s = []
        for _ in range(rng.randrange(2, 7)):
            s.append(f"{rng.choice(nouns)} {rng.choice(joins)} {rng.choice(nouns)} {rng.choice(joins)} {rng.choice(nouns)}".capitalize() + (rng.choice(".!?") if rng.random() < 0.95 else "."))
        text = " ".join(s)
        if rng.random() < 0.2:
            text = text[:-1]
        source = "limited" if i % 3 == 0 else "free"
        if source == "limited" and len(text) > limit:
            text, whole = text[:limit], text
            if text.rstrip()[-1] not in ".!?":
                cut.add(i)
        elif source == "free" and rng.random() < 0.05:
            at = rng.randrange(20, len(text) - 5)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at += 1
            text = text[:at]
            cut.add(i)
        rows.append((i, source, text))
    return rows, cut


def test_finds_limit_and_transfer_cuts(spark):
    data, cut = corpus()
    df = spark.createDataFrame(data, SCHEMA).withColumn("h", F.lit(1)).withColumn("tail", F.lit("x"))
    got = {r.doc_id: r.cut_by for r in truncation.truncated(df).collect()}
    found = set(got) & cut
    assert len(found) > 0.9 * len(cut) and len(set(got) - cut) < 0.05 * len(cut)
    limits = truncation.field_limits(truncation.shapes(df)).where("unit = 'n_chars'").collect()
    assert [(r.source, r.high) for r in limits] == [("limited", 120)]
    report = {r.source: r for r in truncation.truncation_report(df, truncation.truncated(df)).collect()}
    assert report["limited"].n_limit > 0 and report["free"].n_limit == 0 and report["free"].n_docs == 2000


def _limited(limits, each=300, seed=3):
    """Texts of one source, each kind cut at another limit or whole."""
    rng = random.Random(seed)
    nouns = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(80)]
    data, cut = [], {}
    for limit in [*limits, 0]:
        for _ in range(each):
            text = " ".join(f"{rng.choice(nouns)} {rng.choice(nouns)} karena {rng.choice(nouns)}.".capitalize() for _ in range(rng.randrange(1, 12) if not limit else 2 + limit // 12))
            if limit:
                text = text[:limit]
                if text.rstrip()[-1] != ".":
                    cut[len(data)] = limit
            data.append((len(data), "s", text))
    return data, cut


@pytest.mark.parametrize("limits", [(120, 200), (20,), (32, 90, 300)])
def test_every_limit_of_a_source_is_kept(spark, limits):
    data, cut = _limited(limits)
    df = spark.createDataFrame(data, SCHEMA)
    found = {r.high for r in truncation.field_limits(truncation.shapes(df)).where("unit = 'n_chars' and spike").collect()}
    assert found == set(limits)
    got = {r.doc_id for r in truncation.truncated(df).where("detector = 'histogram'").collect()}
    assert set(cut) <= got and len(got - set(cut)) <= 3


def test_a_long_last_word_is_compared_whole():
    assert truncation.tail_of("awal " + "a" * 500 + " " + "b" * 900)[1:] == ("b" * 900, "a" * 500)
    assert truncation.tail_of("x" * 300_000 + " kata")[1:] == ("kata", "x" * 300_000)


def test_copies_make_no_spike(spark):
    data = [(i, "s", f"Kalimat ke {i} " + "yang lengkap " * (3 + i % 20) + "ini") for i in range(60)] + [(100 + i, "s", "Satu kalimat yang sama dan cukup panjang untuk dihitung di sini saja ya " * 6) for i in range(30)]
    assert truncation.field_limits(truncation.shapes(spark.createDataFrame(data, SCHEMA))).where("spike").count() == 0


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "s", None), (2, None, ""), (3, None, "Lengkap."), (4, "s", "x" * 400_000), (5, None, "terpotong &nb"), (5, None, "terpotong &nb")], SCHEMA)
    assert sorted(r.doc_id for r in truncation.truncated(df).collect()) == [5, 5]
    assert truncation.truncated(df.limit(0)).count() == 0
    r = {x.source: x for x in truncation.truncation_report(df, truncation.truncated(df)).collect()}
    assert r[""].n_cut == 2 and r["s"].share_cut == 0.0
