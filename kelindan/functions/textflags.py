"""Quality flags and search strings of texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags that need no lexicon: name -> pattern. Each pattern means the same in Java and RE2.
PLAIN_FLAGS = {
    "has_link": r"https?://|www[.]",
    "has_mention": r"@[A-Za-z0-9_]",
    "has_tag": r"#[A-Za-z0-9_]",
    "has_number": r"[0-9]",
    "has_question": r"[?]",
    "has_repeated_mark": r"[!?.,][!?.,]",
    "has_non_ascii": r"[^\x00-\x7F]",
    "has_capital_word": r"(^|[^A-Za-z])[A-Z][A-Z][A-Z]+([^A-Za-z]|$)",
    "has_line_break": r"\n",
    "no_letters": r"^[^A-Za-z]*$",
}


def pattern_flags(text: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """One boolean per named pattern; false for null. The patterns may come from any lexicon: join terms by ``any_term``."""
    return {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in patterns.items()}


def any_term(terms: list[str], whole_words: bool = True) -> str:
    """A pattern for any of the terms, as whole words or anywhere, with special characters taken literally."""
    quoted = "|".join("".join(c if c.isalnum() or c in " _" else f"[{c}]" if c not in "^\\]" else f"\\{c}" for c in t) for t in sorted(terms))
    return f"(^|[^A-Za-z0-9_])({quoted})([^A-Za-z0-9_]|$)" if whole_words else f"({quoted})"


def search_string(text: Column, most: int = 60) -> Column:
    """A quoted search string: blanks once, double quotes removed, cut at the last blank before ``most`` characters (or there, in one long word); null for blank texts."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, '"', " "), r"\s+", " "))
    head = F.left(t, F.lit(most + 1))
    cut = F.when(F.length(t) <= most, t).when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(F.left(t, F.lit(most)))
    return F.when(t != "", F.concat(F.lit('"'), cut, F.lit('"')))


def search_weight(text: Column) -> Column:
    """How telling a search string is: distinct words of four letters or more, twice, and its other distinct words once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1))
    return (F.size(words) + F.size(F.filter(words, lambda w: F.length(w) >= 4))).cast("bigint")
