"""Corpus encoding (problem 8)."""

from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelindan.llm import encode

PATH = encode.rank_path("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def enc():
    return encode.encoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
def test_round_trip_and_pieces(text):
    enc = encode.encoder(PATH)
    ids = encode.encode_text(text, enc)
    assert encode.decode_ids(ids, enc) == text.encode()
    assert ids == [i for p in encode.safe_pieces(text, 7) for i in enc.encode_ordinary(p)]


def test_long_texts_equal_one_pass(enc):
    text = "Kata-kata 12 yang   panjang's 保湿 <|endoftext|> dan\nlagi😍 " * 3000
    assert len(text) > 5 * encode.SPLIT_AT and encode.encode_text(text, enc) == enc.encode_ordinary(text)
    assert encode.encode_text("a" * 100_000, enc) == enc.encode_ordinary("a" * 100_000)


def test_same_as_the_reference_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("Halo dunia", " 12 ½", "\n\n x", "it's 😍", "保湿 化粧水", "<|endoftext|>"):
        assert encode.encode_text(text, enc) == t.encode(text, add_special_tokens=False).ids


def test_frame(spark):
    df = spark.createDataFrame([(1, "halo"), (2, ""), (3, None), (3, None)], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _text")
    got = sorted((r.doc_id, len(r.ids)) for r in encode.encode_column(df, "text", PATH).collect())
    assert got == [(1, 2), (2, 0), (3, 0), (3, 0)]
    sizes = sorted((r.doc_id, r.n_tokens) for r in encode.encode_column(df, "text", PATH, counts_only=True).collect())
    assert sizes == got and encode.encode_column(df.limit(0), "text", PATH).count() == 0
