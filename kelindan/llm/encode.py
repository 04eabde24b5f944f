"""Encoding a corpus with a public byte-level tokenizer (problem 8).

The rank file is local to the executors; its path is a parameter. The encoder is
built once per Python worker. Texts longer than ``SPLIT_AT`` characters are cut at
boundaries where the pre-splitting pattern always starts a new piece (a line break
or blank after a letter, before another letter), so pieces encode to the same
ids as the whole while the regex engine and the merge loop never see a huge piece of text at once.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

#: Where the vocabularies lie, unless the caller says otherwise.
TOKENIZER_DIR = os.environ.get("KELINDAN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pre-splitting pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters per piece of a long text.
SPLIT_AT = 20_000
_SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
_HELD: dict[str, tiktoken.Encoding] = {}


def rank_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


def encoder(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens; held once per process."""
    if path not in _HELD:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _HELD[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _HELD[path]


def safe_pieces(text: str, size: int = SPLIT_AT) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only between a letter and one blank before a letter.

    There the pattern always ends a piece: a run of letters stops at the blank,
    which belongs to the next word. A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, enc: tiktoken.Encoding) -> list[int]:
    """Ids of a text; null and empty texts have none. Lone surrogates encode as the replacement character."""
    if not text:
        return []
    if len(text) <= SPLIT_AT:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def decode_ids(ids: Sequence[int], enc: tiktoken.Encoding) -> bytes:
    """The bytes of a row of ids (raw: a cut inside a character is kept as it is)."""
    return enc.decode_bytes(list(ids))


def encode_column(df: DataFrame, column: str, path: str, keep: Sequence[str] = ("doc_id",), counts_only: bool = False) -> DataFrame:
    """``keep`` and ``ids`` (array<int>), or ``n_tokens`` (int) if only sizes are needed.

    Narrow: no shuffle, one Arrow pass. Null and empty texts give an empty list
    (0 tokens); repeated rows stay; other columns don't pass through Python.
    """
    out = "n_tokens" if counts_only else "ids"
    kept = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [encode_text(t, enc) for t in b.column(len(kept)).to_pylist()]
            last = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], last], [*[f.name for f in kept], out])

    schema = StructType([*kept, StructField(out, IntegerType() if counts_only else ArrayType(IntegerType()))])
    return df.select(*keep, F.col(column).alias("_text")).mapInArrow(run, schema)


def round_trip(df: DataFrame, column: str, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, same)``: whether the raw bytes of a text's ids are the text's; null and empty texts have no ids and no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            same = [decode_ids(encode_text(t, enc), enc) == (t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.bool_())], [key, "same"])

    schema = StructType([df.schema[key], StructField("same", BooleanType())])
    return df.select(key, F.col(column).cast("string").alias("_text")).mapInArrow(run, schema)
