"""Word sets: distinct lower-cased runs of letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for nothing, compared trimmed and in lower case.
REMOVED = ("", "[deleted]", "[removed]", "nan", "none", "null", "<na>", "-")


def word_set(text: Column) -> Column:
    """The sorted distinct words of a text; empty for a text without letters and digits, null for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)))


def kept_text(text: Column) -> Column:
    """The text, or null if it is empty or only says that it was removed."""
    return F.when(~F.lower(F.trim(text)).isin(*REMOVED), text)
