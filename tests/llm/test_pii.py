"""Personal information (problem 7)."""

from __future__ import annotations

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kelindan.llm import boosting, pii

D = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def detector():
    parts = {a.lower(): k for a, k in duckdb.sql(f"select * from '{D}/name_parts.parquet'").fetchall()}
    texts = [t for (t,) in duckdb.sql(f"select comment_2 from '{D}/comment_similarity_pairs.parquet' where comment_2 is not null").fetchall()]
    return pii.train(texts * 3, parts)


CASES = [
    ("hubungi 0842-1234-5678 ya", [("phone", "0842")]), ("wa +62 861 1234 567, lagi", [("phone", "62 861")]), ("telp: (0844) 3331167.", [("phone", "0844")]), ("call/wa o864 2915 363", [("phone", "o864")]),
    ("nik 9915 3721 0966 5244.", [("identity_number", "9915")]), ("NIK=994146-061275-3755 ya", [("identity_number", "9941")]), ("npwp 99.807.533.9-319.553,", [("identity_number", "99.8")]),
    ("email rina.putri[at]pos[dot]example[dot]com ya", [("email", "rina")]), ("surel: a+b9@mail.example.net,", [("email", "a+b9")]), ("alamat Jl. Sawo Raya No. 12, Bumirejo ya kak", [("address", "Jl.")]),
    ("COD di Gang Cendana II 16 RT 2", [("address", "Gang")]), ("nama saya Tari Nilasukma ya", [("person_name", "Tari")]), ("Ibu Sekar Ciptaloma ya", [("person_name", "Sekar")]), ("an. BUDI KUSUMAWIRA;", [("person_name", "BUDI")]),
    ("order INV/2025/932805 lagi", []), ("resi JX8594602645.", []), ("video 7464829686746253423 bagus", []), ("BPOM NA18456130222", []), ("harga Rp 344.000 (367)", []), ("varian Mawar Intan, wangi", []), ("brand Orvella Glow.", []),
    ("Toko Tirtamulya Jaya;", []), ("jalan dua minggu lagi", []), ("halo @manis.ratna, ya", []), ("pukul 19.30 - 21.00 isi 30ml x 2", []), ("", []), ("😭😭", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_items(detector, text, want):
    got = [(s.kind, text[s.start :]) for s in detector.score([text])[0]]
    assert [k for k, _ in got] == [k for k, _ in want] and all(g.startswith(w) for (_, g), (_, w) in zip(got, want, strict=True))


def test_held_out_agreement_with_formats(detector):
    """On texts it wasn't trained on, spans with an unmistakable format are found and nothing else of that look."""
    texts = [t for (t,) in duckdb.sql("select comment_2 from '/root/testdata/sf0.001/comment_similarity_pairs.parquet' where comment_2 is not null").fetchall()]
    want = sum(len(re.findall(r"(?<![\w.])99[\d .-]{14,20}(?!\d)", t)) for t in texts)
    got = sum(s.kind == "identity_number" for spans in detector.score(texts) for s in spans)
    assert abs(got - want) <= max(2, 0.05 * want)


def _proposed(text, kind):
    return {text[s.start : s.end] for s in pii.candidates(text, {"sari": "given"}) if s.kind == kind}


def test_no_cap_on_candidates():
    """Numbers in the middle of long runs and beside large groups, long names and long streets are proposed whole."""
    run = "wa 11 22 33 0812 3456 7890 44 55 66 77"
    assert "0812 3456 7890" in _proposed(run, "phone")
    assert {"62 81234567890", "81234567890"} <= _proposed("wa +62 81234567890", "phone")
    name = "Sari Budi Rina Tono Wira Putri Lestari Kusuma Dewi"
    assert name in _proposed(f"nama saya {name} ya", "person_name")
    street = "Jl. Raya Taman Bunga Melati Putih Timur Dalam Indah No. 12"
    assert street in _proposed(f"alamat {street} ya", "address")


def test_spans_do_not_overlap_and_positions_are_code_points(detector):
    text = "😭é hubungi 0842-1234-5678, email x@y.example"
    spans = detector.score([text, None])[0]
    assert [text[s.start] for s in spans] == ["0", "x"] and all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_frames(spark, detector, rows):
    df = spark.createDataFrame([("1", "wa 084212345678 ya"), ("2", None), ("3", ""), (None, "wa 084212345678"), ("5", "x" * 300_000)], "pair_id string, comment_2 string").withColumn("k", F.lit(1)).withColumn("t", F.lit(2))
    assert rows(pii.find_items(df, "pair_id", "comment_2", detector), "pair_id", "pii_type", "start_at") == [("1", "phone", 4), (None, "phone", 4)]
    got = {r.pair_id: r.redacted for r in pii.redact(df, "comment_2", detector).collect()}
    assert got["1"] == "wa [PHONE] ya" and got["2"] is None and got["3"] == ""
    assert pii.find_items(df.limit(0), "pair_id", "comment_2", detector).count() == 0


def test_prior_examples_are_enough_for_a_model(spark):
    """Without any text the same models are fitted, on the prior examples alone."""
    d = pii.train([], {})
    assert set(d.models) == set(pii.TYPES)
    assert [s.kind for s in d.score(["wa 084212345678 ya"])[0]] == ["phone"] and d.score(["resi 8421234567"]) == [[]]
    parts = spark.createDataFrame([(None, "given")], "name_part string, part_kind string")
    empty = spark.createDataFrame([], "pair_id string, comment_2 string")
    assert pii.fit_detector(empty, "pair_id", "comment_2", parts).parts == {}


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (800, 3)).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 1] > 1)).astype(int)
    m = boosting.fit(x[:600], y[:600])
    m.calibrate(m.margin(x[600:700]), y[600:700])
    assert ((m.probability(x[700:]) > 0.5) == y[700:]).mean() > 0.97
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((1, 2))).shape == (1,)
