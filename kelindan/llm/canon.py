"""One consistent form for texts that look the same (problem 1).

Texts are handled in canonical decomposition, so composed and split accents are one from the start. Look-alike
classes are found by union-find over *strings* (single code points and sequences): letters of different
scripts with one shape, the wide, narrow, small, font, ligature and presentation forms that the Unicode data state, all
kinds of blanks, and characters without a glyph (class of the empty string). Classes are transitive. A class that has a
sequence of plain characters is represented by it, any other by the member that the corpus uses most. The table of
rewrites is closed: what it writes holds nothing that it would rewrite. Texts are rewritten greedily, longest match
first, by one multi-pattern automaton, and composed again.

One table is made for all fields that are to be compared. Case and accents stay: they are visible. So do digits and
punctuation that only resemble letters (0 and O, 1 and l), pairs such as rn and m, and superscripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.session import stage

# Letters of one shape, a class a line (Latin first where it has one; Greek, Cyrillic, Armenian, Coptic, Cherokee,
# Lisu, Latin extensions), as in public tables of confusable characters; at the end those of other scripts among themselves.
LOOK_ALIKE_LETTERS = """
aаɑαａ
cсϲⲥᴄ
dԁ
eе
gɡց
hһհ
iіι
jјϳ
kᴋ
lӏ
nո
oоοօⲟᴏ
pрρⲣ
qԛ
sѕꜱ
uυսᴜ
vѵνᴠ
wԝᴡ
xх
yуү
zᴢ
AАΑᎪꓮ
BВΒᏴꓐⲂ
CСϹᏟꓚⲤ
DᎠꓓ
EЕΕᎬꓰ
FꓝϜ
GԌꓖ
HНΗᎻꓧⲎ
IІΙӀꓲⲒ
JЈᎫꓙ
KКΚᏦꓗⲔ
LᏞꓡ
MМΜᎷꓟⲘ
NΝꓠⲚ
OОΟՕꓳⲞ
PРΡᏢꓑⲢ
QԚ
RᎡꓣ
SЅՏᏚꓢ
TТΤᎢꓔⲦ
UՍꓴ
VѴᏙꓦ
WԜᎳꓪ
XХΧꓫⲬ
YҮΥꓬ
ZΖᏃꓜ
əә
ƏӘ
ɛεⲉ
ΓГⲄ
ΠПⲠ
ΦФⲪ
ΘѲⲐ
Δ∆
κкĸ
-‐
""".split()  # fmt: skip
# Sequences that look like their first letter: a dot over a letter that has one.
DOTTED = ("i\u0307", "j\u0307")
#: Kinds of compatibility forms (of the Unicode data) that a reader takes for the plain form; the second ones only where it is one character.
SAME_LOOK_FORMS = ("<wide>", "<narrow>", "<font>", "<compat>", "<small>", "<noBreak>")
SAME_LOOK_SINGLE = ("<initial>", "<medial>", "<final>", "<isolated>")
#: Code points without a glyph that aren't format characters by category.
NO_GLYPH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x1810), *range(0xE0100, 0xE01F0)}


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = sorted((self.find(x), self.find(y)))
        self.parent[b] = a

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def plain_form(c: str) -> str | None:
    """What a code point (of a decomposed text) is taken for by the Unicode data alone; None if it has no other form."""
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind == "Cf" or ord(c) in NO_GLYPH or (kind == "Cc" and ord(c) not in (9, 10, 11, 12, 13, 0x85)):
        return ""
    how, form = unicodedata.decomposition(c), unicodedata.normalize("NFKD", c)
    if how.startswith(SAME_LOOK_FORMS):
        symbol = 0x2100 <= ord(c) < 0x2150 and len(form) > 1  # signs made of small letters, as the numero sign
        return None if symbol or form.startswith(" ") else form
    return form if how.startswith(SAME_LOOK_SINGLE) and len(form) == 1 else None


def rewrite_table(counts: Mapping[str, int]) -> dict[str, str]:
    """String -> representative, for all strings that must change, given how often each code point occurs in the texts.

    Of single characters the most frequent represents its class, the smaller one in a tie; a plain sequence
    comes before all single ones. Blanks and glyphless characters always become a blank and nothing. The table is closed.
    """
    often: dict[str, int] = {}
    for c, n in counts.items():
        for x in unicodedata.normalize("NFD", c):
            often[x] = often.get(x, 0) + n
    classes = Classes()
    for line in LOOK_ALIKE_LETTERS:
        for c in line[1:]:
            classes.union(line[0], c)
    table: dict[str, str] = {}
    for c in often:
        form = plain_form(c)
        if form in ("", " "):
            table[c] = form
        elif form is not None and form != c:
            classes.union(c, form)
    best: dict[str, str] = {}
    for members in classes.groups().values():
        top = min(members, key=lambda x: (-len(x), -often.get(x, 0), x))
        best |= {x: top for x in members if len(x) == 1}
    for c in best:
        out = c
        while (new := "".join(best.get(x, table.get(x, x)) for x in out)) != out:
            out = new
        table[c] = out
    for seq in DOTTED:
        table["".join(table.get(x, x) for x in seq)] = table.get(seq[0], seq[0])
    return {c: r for c, r in table.items() if c != r}


class Rewriter:
    """Greedy leftmost-longest rewriting by an automaton."""

    def __init__(self, table: Mapping[str, str]) -> None:
        self.table = dict(table)
        self.automaton = ahocorasick.Automaton()
        for x, to in self.table.items():
            self.automaton.add_word(x, (len(x), to))
        self.automaton.make_automaton()
        self.plain = not any(x.isascii() and x.isprintable() for x in self.table)

    def once(self, text: str) -> str:
        """One pass over a decomposed text, decomposed again."""
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text) if self.table else ():
            out += (text[at : end - n + 1], to)
            at = end + 1
        return unicodedata.normalize("NFD", "".join((*out, text[at:]))) if out else text

    def __call__(self, text: str | None) -> str | None:
        """The consistent form; runs of blanks count as one, outer blanks go. Null stays null.

        The table is closed, so after the first pass only sequences can match, and each further pass makes the text shorter: it ends.
        """
        if text is None:
            return None
        if not (self.plain and text.isascii() and text.isprintable()):
            text = unicodedata.normalize("NFD", text)
            while (new := self.once(text)) != text:
                text = new
            text = unicodedata.normalize("NFC", text)
        return re.sub(r"\s+", " ", text).strip()


def code_point_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(cp, n)``: how often each code point occurs, combined within each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = "".join(x for x in b.column(0).to_pylist() if x)
            cps, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cps.astype(np.int64)), pa.array(n.astype(np.int64))], ["cp", "n"])

    return texts.select(column).mapInArrow(count, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))


def corpus_table(*columns: tuple[DataFrame, str]) -> dict[str, str]:
    """The rewrites for all given (table, column) together. Collected: at most one row per code point of Unicode, whatever the corpus."""
    texts = [df.select(F.col(c).cast("string").alias("_text")) for df, c in columns]
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    return rewrite_table({chr(r.cp): r.n for r in code_point_counts(every, "_text").collect()})


def with_canonical(df: DataFrame, column: str, out: str = "canonical", table: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with the consistent form of ``column``, by ``table`` (see ``corpus_table``), else by the column's own characters.

    Forms compare only where they come from one table. One pass counts code points, one rewrites. Null stays null, a text of
    blanks and invisible characters becomes empty. An existing column named
    ``out`` is replaced.
    """
    rewrites = dict(corpus_table((df, column)) if table is None else table)
    held: dict[str, Rewriter] = {}

    @F.pandas_udf("string")
    def rewrite(x: pd.Series) -> pd.Series:
        if "r" not in held:
            held["r"] = Rewriter(rewrites)
        return x.map(held["r"], na_action="ignore")

    return df.withColumn(out, rewrite(F.col(column)))


def looks(df: DataFrame, key: str, column: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """``(k, c, h)``: key, class (hash of the consistent form) and stored text (hash) of every row with a text."""
    given = df.select(F.col(key).cast("string").alias("k"), F.col(column).cast("string").alias("_text")).where("_text is not null")
    return with_canonical(given, "_text", "_canon", table).select("k", F.md5("_canon").alias("c"), F.xxhash64("_text").alias("h"))


def same_looking_classes(df: DataFrame, key: str, column: str, source: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """``(src_table, class, n_rows, n_texts)`` of the classes with several stored texts; rows join them by ``with_canonical``."""
    texts = looks(df, key, column, table).groupBy("c", "h").agg(F.count(F.lit(1)).alias("n"))
    sums = texts.groupBy(F.col("c").alias("class")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    return sums.select(F.lit(source).alias("src_table"), "class", "n_rows", "n_texts")


def same_looking_pairs(df: DataFrame, key: str, column: str, source: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """``(src_table, key_1, key_2)``: keys whose texts look the same though the stored texts differ.

    Null texts and keys pair with nothing; texts that are blank to a reader look
    the same as each other. A key with several texts is matched by each. Classes
    with one stored text leave by a min/max aggregate before any join. The stored texts of the others are paired first,
    one row a text, and keys joined last, so copies meet only the keys of other texts, which the result names.
    """
    held = stage(looks(df, key, column, table).where("k is not null"), "canon")
    mixed = held.groupBy("c").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("c")
    some = held.join(mixed, "c", "left_semi").distinct()
    texts = some.select("c", "h").distinct()
    differ = texts.select("c", F.col("h").alias("h1")).join(texts.select("c", F.col("h").alias("h2")), "c").where("h1 < h2")
    one, two = some.select(F.col("k").alias("k1"), "c", F.col("h").alias("h1")), some.select(F.col("k").alias("k2"), "c", F.col("h").alias("h2"))
    pairs = differ.join(one, ["c", "h1"]).join(two, ["c", "h2"]).where("k1 <> k2")
    return pairs.select(F.lit(source).alias("src_table"), F.least("k1", "k2").alias("key_1"), F.greatest("k1", "k2").alias("key_2")).distinct()
