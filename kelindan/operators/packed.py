r"""Fields that pack several values (problem 3).

A finite-state tokenizer reads each field once, from one special character to the next. It
tracks

* *quoting*: a quote opens a quoted value only between values, and only if its partner is followed
  by a delimiter, a closing list bracket or the end; so the apostrophe in a word is plain text. A doubled or
  escaped quote stays inside;
* *escapes*: a backslash before a delimiter, quote, bracket, backslash, # or @ makes that character
  part of the value; before any other character it is itself;
* *nesting depth*: a square bracket that opens between values opens a list, whose brackets belong to no
  value and whose delimiters separate values at any depth; a bracket of any kind inside a value, and a round or
  curly one at its start, opens a group that belongs to the value, delimiters and all. A bracket without a
  partner is plain text.

Values and their ordinals come from the delimiters outside quotes and groups. The work is linear in the
length of a field; it runs as one Arrow pass without a shuffle of its own.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates values.
DELIMITERS = ";,|\t\n\r、；，"
#: Fields that say "nothing here" (compared in lower case).
BLANK_MARKERS = ("", "-", "nan", "none", "null", "<na>", "n/a", "[]")
#: White space: the ASCII ones and all separators of the Unicode data.
BLANKS = " \t\n\x0b\x0c\r" + "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "Z")
SIGNS = "#＃@＠"
PARTNER = {")": "(", "]": "[", "}": "{"}

_B, _D = re.escape(BLANKS), re.escape(DELIMITERS)
_GAP = re.compile(rf"[{_B}{_D}]*+")


def _quoted(closers: str) -> str:
    """A quoted value that ends before a delimiter or the end of the field; closing brackets may come first."""
    end = rf"(?=(?:(?![{_D}])[{_B}{closers}])*+(?:[{_D}]|\Z))"
    return "|".join(rf"{q}[^{q}\\]*+(?:(?:{q}{q}|\\.)[^{q}\\]*+)*+{q}{end}" for q in "\"'")


QUOTED = re.compile(_quoted(r"\]"), re.S)
#: What matters where brackets are matched: quoted values (also those in groups), escapes and brackets.
_BRACKETS = re.compile(rf"(?:(?<=[{_B}{_D}\[({{])|\A)(?:{_quoted(r'\])}')})|\\.|[()\[\]{{}}]", re.S)
#: The characters at which the state may change inside a value.
_STOP = re.compile(rf"[{_D}{_B}{SIGNS}\\()\[\]{{}}]")
_BLANK_RUN = re.compile(rf"[{_B}]++")
_ESCAPE = re.compile(rf"\\([{_D}{SIGNS}\\()\[\]{{}}\"'])")


def partners(text: str) -> dict[int, int]:
    """Position of each bracket that has a partner -> position of the partner; quoted and escaped ones don't count."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    waiting = dict.fromkeys("([{", 0)
    for m in _BRACKETS.finditer(text):
        c = m[0]
        if c in waiting:
            stack.append((c, m.start()))
            waiting[c] += 1
        elif c in PARTNER and waiting[PARTNER[c]]:
            while True:  # brackets of other kinds that were left open inside have no partner
                kind, at = stack.pop()
                waiting[kind] -= 1
                if kind == PARTNER[c]:
                    break
            pairs[at] = m.start()
            pairs[m.start()] = at
    return pairs


def _value(raw: str) -> str:
    """A token as a value: outer blanks, paired outer quotes and leading # or @ removed, escapes and doubled quotes resolved."""
    raw = raw.strip(BLANKS)
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        raw = raw[1:-1].replace(raw[0] * 2, raw[0])
    raw = raw.lstrip(BLANKS + SIGNS).rstrip(BLANKS)
    return _ESCAPE.sub(r"\1", raw) if "\\" in raw else raw


def tokens(text: str) -> list[str]:
    """The values of a field in order; blank ones vanish."""
    pairs = partners(text) if any(c in text for c in "([{") else {}
    lists: set[int] = set()  # closing brackets of the lists that are open
    out: list[str] = []
    at, n = 0, len(text)
    while True:
        # between values
        at = _GAP.match(text, at).end()
        if at >= n:
            return [v for v in out if v]
        c = text[at]
        if c == "[" and at in pairs:
            lists.add(pairs[at])
            at += 1
            continue
        if c == "]":
            lists.discard(at)
            at += 1
            continue
        if c in "\"'" and (m := QUOTED.match(text, at)):
            out.append(_value(m[0]))
            at = m.end()
            continue
        # inside a value: from its first character to the one that ends it
        start, tagged = at, c in SIGNS
        while tagged and at < n and text[at] in SIGNS:
            at += 1
        while True:
            m = _STOP.search(text, at)
            if not m:
                at = n
                break
            at, c = m.start(), m[0]
            if c == "\\":
                at += 2
            elif c in DELIMITERS or at in lists:
                break
            elif c in "([{" and at in pairs:
                at = pairs[at] + 1
            elif c in SIGNS and tagged:
                break
            elif c in BLANKS:
                to = _BLANK_RUN.match(text, at).end()
                if text[to : to + 1] and text[to] in SIGNS:
                    break
                at = to
            else:
                at += 1
        at = min(at, n)
        out.append(_value(text[start:at]))


def split_text(text: str | None) -> list[str] | None:
    """The values of a packed field; None for null and for blank markers."""
    if text is None:
        return None
    text = text.strip(BLANKS)
    return None if text.lower() in BLANK_MARKERS else tokens(text)


def split_packed(value: Column) -> Column:
    """The values of a packed field, in order, as an array; null for null and for blank markers.

    Blank values vanish, repeated values stay, an unclosed quote or bracket is plain text.
    """

    @F.arrow_udf("array<string>")
    def split(fields: pa.Array) -> pa.Array:
        return pa.array([split_text(t) for t in fields.to_pylist()], pa.list_(pa.string()))

    return split(value)


def explode_packed(df: DataFrame, fields: dict[str, str], key: str) -> DataFrame:
    """``(src_field, row_key, pos, item)``: one row per value of each field, ``pos`` counting from 1.

    Rows that repeat (a record crawled twice) give their values once; null keys
    and fields with nothing in them give no row. Two exchanges, both
    after a map-side combine: one drops repeated records, one repeated values.
    """
    names = list(fields)
    raw = df.select(F.col(key).cast("string").alias("row_key"), *[F.col(fields[n]).alias(f"_f{i}") for i, n in enumerate(names)])
    raw = raw.where(F.col("row_key").isNotNull()).distinct()
    packed = F.array(*[F.struct(F.lit(n).alias("src_field"), split_packed(F.col(f"_f{i}").cast("string")).alias("items")) for i, n in enumerate(names)])
    return (
        raw.select("row_key", F.inline(packed))
        .select("src_field", "row_key", F.posexplode("items").alias("pos", "item"))
        .select("src_field", "row_key", (F.col("pos") + 1).cast("bigint").alias("pos"), "item")
        .distinct()
    )
