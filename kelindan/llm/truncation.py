"""Texts that were cut by a field limit or in transfer (problem 10).

Two detectors, each named in the result:

*histogram* (``field_limits``): limits are found per source from the histograms of lengths, in characters, in UTF-8
bytes and in characters before a continuation marker. Distinct texts are counted, so
copies make no spike. A limit shows as a *spike* at the greatest length (hard cut), as a *pile* in the last ``PILE`` characters
(cut back to a whole word), or as a spike at a smaller length that stands out from the lengths on both sides and whose texts
are nearly all unfinished (a second kind of record, or a limit that was changed). A source may have any number of limits. A text
at a limit is cut unless it ends like a finished text (terminal punctuation, emoji, link, tag).

*ending* (``ending_reason``): cuts in transfer happen at any length. They are told by how a text ends, against
statistics of the whole corpus: an ending that is a proper prefix of far more frequent
words (inside a word); a word, or a word before the last, after which sentences and texts
hardly ever end (inside a sentence); a marker that says that more follows; an opened bracket, an unfinished link,
character reference, amount or emoji.

All statistics are sums that are combined in each task before the shuffle. The
histograms have at most one row per source, unit and length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelindan.session import stage

#: Width of a pile: hardly any word is longer.
PILE = 16
#: A spike or pile has at least so many distinct texts, and so many times what lies below it.
LEAST, TIMES = 5, 4.0
#: A spike below the greatest length has at least so many distinct texts, and at least this share of them is unfinished.
LEAST_INNER, UNFINISHED = 8, 0.8
#: A word ends sentences in at least this share of its uses, or texts in the second share (and at least twice) - else a text that ends on it is cut.
SENTENCE_SHARE, TEXT_SHARE = 0.03, 0.005
#: A word is followed by a sentence's last word in at least this share of its uses, else the text goes on.
LEAD_SHARE = 0.002
#: An ending is inside a word if words it is a prefix of are so many times as frequent.
PREFIX_TIMES = 50

_TOKEN = re.compile(r"([^\W_]+(?:[-'’][^\W_]+)*)([.!?…。！？]?)")
_TERMINAL = re.compile(r"[.!?…。！？~][\"'”’»)\]}]*$")
_MARKER = re.compile(r"\s?(?:\[(?:…|\.\.\.)\]|…|\.\.\.)(?: [a-z]+){0,3}$")
_SAID = re.compile(r"(?:\[(?:…|\.\.\.)\]|(?:…|\.\.\.) [a-z]+(?: [a-z]+){0,2})$")
_LINK = re.compile(r"(?:https?://|www\.)\S*$")
_ENTITY = re.compile(r"&#?[a-zA-Z0-9]{0,6}$")
_AMOUNT = re.compile(r"(?:Rp|\$|€)\s?([\d.,]*)$")
_FULL_AMOUNT = re.compile(r"^\d{1,3}(?:[.,]\d{3})*$|^\d+$")
_OPEN = set(",;:-–—([{“‘«/&@#_=+\\<")

STATS = "kind string, w string, n long, e long, f long"
SHAPE = "doc_id long, source string, h long, n_chars int, n_bytes int, n_base int, tail string, last string, prev string"


def _last_words(x: str) -> list[str]:
    """The last two words of a text, whole, however long they are."""
    size = 100
    while True:
        size *= 2
        found = list(_TOKEN.finditer(x[-size:]))[-2:]
        if size >= len(x) or (len(found) == 2 and found[0].start() > 0):
            return [m[1] for m in found]


def tail_of(text: str) -> tuple[str, str | None, str | None]:
    """How a text ends: ``(kind, last word, word before it)``.

    Kinds: blank, broken (surely cut), said (a marker says that more follows), ellipsis, done (finished by
    punctuation), aside (one small word after the last sentence, as a laugh), mark (emoji, symbol or closing bracket), link, tag, number and word.
    """
    x = text.rstrip()
    if not x:
        return "blank", None, None
    end = x[-1]
    if link := _LINK.search(x):
        bare = link[0].rstrip(".,!?…~;)]\"'")
        whole = re.match(r"(?:https?://|www\.)([\w-]+\.)+[\w-]+(/\S*)?$", bare)
        return ("link" if whole else "broken"), f"link:{'/' if bare.endswith('/') or bare != link[0] else ''}", None
    if re.search(r"&#?\w{1,8};$", x):
        return "mark", None, None
    if end in "‍�" or "\ud800" <= end <= "\udfff" or end in _OPEN or _ENTITY.search(x):
        return "broken", None, None
    if _SAID.search(x):
        return "said", None, None
    if _TERMINAL.search(x):
        return ("ellipsis" if x.endswith(("…", "...")) else "done"), None, None
    if amount := _AMOUNT.search(x):
        return ("number" if _FULL_AMOUNT.match(amount[1]) else "broken"), None, None
    if not end.isalnum():
        return "mark", None, None
    token = x.rsplit(None, 1)[-1]
    if token[0] in "@#":
        return "tag", token[1:].lower(), None
    found = _last_words(x)
    if not found or end.isdigit() or not end.isalpha():
        return "number", None, None
    if token == found[-1] and token[0].islower() and re.search(r"[.!?…。！？][\"'”’»)]*\s+$", x[: -len(token)]):
        return "aside", None, None
    return "word", found[-1].lower(), found[-2].lower() if len(found) > 1 else None


def word_statistics(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """``(kind, w, n, e, f)`` over all texts: uses of a word, how many end a sentence within the text, how many end a text without punctuation.

    ``kind`` is w for the word itself, p for the word before the one that ends, l for links (w: "/" or "").
    Each task sums in a table of bounded size that is emptied when full.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {(k, m): Counter() for k in "wpl" for m in "nef"}

        def emit() -> pa.RecordBatch:
            keys = sorted({(k, w) for (k, _), t in tables.items() for w in t})
            cols = [pa.array([tables[k, m][w] for k, w in keys], pa.int64()) for m in "nef"]
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), *cols], ["kind", "w", "n", "e", "f"])
            for t in tables.values():
                t.clear()
            return batch

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                low = text.rstrip().lower()
                pairs = _TOKEN.findall(low)
                words = [w for w, _ in pairs]
                if not words:
                    continue
                tables["w", "n"].update(words)
                tables["w", "e"].update(w for w, p in pairs if p)
                tables["p", "n"].update(words[:-1])
                tables["p", "e"].update(v for v, (_, p) in zip(words, pairs[1:], strict=False) if p)
                if low.endswith(words[-1]):
                    tables["w", "f"][words[-1]] += 1
                    if len(words) > 1:
                        tables["p", "f"][words[-2]] += 1
                for link in re.findall(r"(?:https?://|www\.)\S+(?=\s)", low):
                    tables["l", "n"]["/" if link.rstrip(".,!?").endswith("/") else ""] += 1
            if sum(map(len, tables.values())) > flush:
                yield emit()
        yield emit()

    return docs.select("text").mapInArrow(count, STATS).groupBy("kind", "w").agg(*[F.sum(c).alias(c) for c in "nef"])


def shapes(docs: DataFrame) -> DataFrame:
    """One row per document with a text: its lengths and how it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text is None:
                    continue
                tail, last, prev = tail_of(text)
                marker = _MARKER.search(text.rstrip())
                raw = text.encode("utf-8", "replace")
                h = xxhash.xxh64_intdigest(raw)
                row = (doc, source, h - (1 << 64) if h >> 63 else h, len(text), len(raw), marker.start() if marker else len(text), tail, last, prev)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in SHAPE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, SHAPE)


def field_limits(shaped: DataFrame) -> DataFrame:
    """``(source, unit, low, high, spike)``: all lengths at which a source cuts, by histogram.

    Units: n_chars, n_bytes and n_base (characters before a continuation marker,
    of texts that end in one). A spike has ``TIMES`` the mean of the 40 lengths below it, and either at
    most a tenth of its size above it, or ``TIMES`` the mean of the 40 lengths above it too and nearly only unfinished
    texts. A spike has at least half of the texts of the last ``PILE`` lengths, else these may be a pile, which has ``TIMES`` the texts
    before it and at most a twentieth of its size above it. Texts that end in a marker count in n_base only. One limit isn't reported in
    bytes and in characters. Texts of any length take part.
    """
    marked = F.when(F.col("n_base") < F.col("n_chars"), F.col("n_base"))
    open_end = F.col("tail").isin("word", "number", "broken", "said", "ellipsis").cast("int")
    bare = lambda c: F.when(F.col("n_base") >= F.col("n_chars"), F.col(c)).alias(c)
    once = shaped.where("tail <> 'blank'").select("source", "h", bare("n_chars"), bare("n_bytes"), marked.alias("n_base"), open_end.alias("open")).distinct()
    long = once.unpivot(["source", "open"], ["n_chars", "n_bytes", "n_base"], "unit", "len").where("len is not null")
    hist = long.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("c"), F.sum("open").alias("open"))
    whole = Window.partitionBy("source", "unit")
    by = whole.orderBy("len")
    mean = lambda lo, hi: F.coalesce(F.sum("c").over(by.rangeBetween(lo, hi)), F.lit(0)) / 37
    around = hist.withColumns(
        {
            # a running sum and the total: a frame up to the end would be summed anew for each length
            "above": F.sum("c").over(whole) - F.sum("c").over(by.rangeBetween(Window.unboundedPreceding, 0)),
            "below": mean(-40, -4), "after": mean(4, 40),
            "pile": F.sum("c").over(by.rangeBetween(-PILE + 1, 0)),
            "before": F.coalesce(F.sum("c").over(by.rangeBetween(-11 * PILE + 1, -PILE)), F.lit(0)) / 10,
        }
    )
    steep = (F.col("c") >= LEAST) & (F.col("c") >= TIMES * (1 + F.col("below"))) & (F.col("c") * 2 >= F.col("pile"))
    inner = (F.col("c") >= LEAST_INNER) & (F.col("c") >= TIMES * (1 + F.col("after"))) & (F.col("open") >= UNFINISHED * F.col("c"))
    spike = steep & ((F.col("above") * 10 <= F.col("c")) | inner)
    cliff = (F.col("pile") >= 8) & (F.col("pile") >= TIMES * F.greatest(F.col("before"), F.lit(1.0))) & (F.col("above") * 20 <= F.col("pile"))
    pile = (F.col("unit") == "n_chars") & cliff
    low = F.when(spike, F.when(F.col("unit") == "n_bytes", F.col("len") - 3).otherwise(F.col("len"))).when(pile, F.col("len") - PILE + 1)
    strength = F.when(spike, F.col("c")).otherwise(F.col("pile"))
    found = around.where(spike | pile).select("source", "unit", low.alias("low"), F.col("len").alias("high"), spike.alias("spike"), strength.alias("c"))
    # the lengths of one pile are one limit: of limits of a unit that overlap, the strongest spike, else the greatest pile is kept
    rest = found.withColumn("top", F.max(F.struct("spike", "c", "high")).over(whole.orderBy("high").rangeBetween(-PILE, PILE)))
    kept = rest.where(F.col("top") == F.struct("spike", "c", "high")).drop("top")
    # one limit may show in both units, by texts of one-byte characters: a spike in bytes beside a stronger one in characters, and a pile in characters at a spike in bytes, are dropped
    chars, bytes_ = (kept.where(F.col("unit") == u).select("source", F.col("high").alias(f"_{u}"), F.col("c").alias(f"_c{u}"), F.col("spike").alias(f"_s{u}")) for u in ("n_chars", "n_bytes"))
    both = chars.join(bytes_, "source").where(f"_n_bytes between _n_chars and _n_chars + {PILE}")
    weak_bytes = both.where("_sn_chars and _cn_bytes <= _cn_chars and _n_bytes <= _n_chars + 3").select("source", F.lit("n_bytes").alias("unit"), F.col("_n_bytes").alias("high"))
    weak_chars = both.where("not _sn_chars").select("source", F.lit("n_chars").alias("unit"), F.col("_n_chars").alias("high"))
    return kept.join(weak_bytes.unionByName(weak_chars), ["source", "unit", "high"], "left_anti").select("source", "unit", "low", "high", "spike")


def limit_reason(at_limit: Column, at_marker: Column, known_tag: Column, broken: Column) -> Column:
    """limit or marker for a text that lies at a limit of its source and isn't finished, else null."""
    return F.when((F.col("tail") == "ellipsis") & at_marker, "marker").when(at_limit & (broken | (F.col("tail").isin("word", "number", "tag") & ~known_tag)), "limit")


def ending_reason(inside_word: Column, inside_sentence: Column, broken: Column) -> Column:
    """said, broken, word or sentence for a text whose ending says that it goes on, wherever it was cut, else null."""
    return F.when(F.col("tail") == "said", "said").when(broken, "broken").when(inside_word, "word").when(inside_sentence, "sentence")


def truncated(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, n_chars, detector, cut_by)`` for documents whose text ends before its writer's end.

    ``docs`` has doc_id, source and text; other columns are ignored. detector is histogram (cut_by: limit, marker) or, for
    texts at no limit, ending (cut_by: said, word (inside a word), sentence (inside a sentence), broken). Null
    and blank texts are not cut. Documents of a null source form one source.
    """
    kept = stage(docs.select("doc_id", "source", "text").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").transform(shapes), "tr-shapes")
    stats = stage(word_statistics(docs.where("text is not null")), "tr-words")
    limits = field_limits(kept)

    words = stats.where("kind = 'w'")
    frequent = words.where("n >= 10").select("n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 1, F.lit(1))), lambda k: F.substring("w", F.lit(1), k))).alias("last"), "w").where("last <> w")
    prefixes = frequent.groupBy("last").agg(F.sum("n").alias("longer"))
    own = words.select(F.col("w").alias("last"), F.col("n").alias("n0"), F.col("e").alias("e0"), F.col("f").alias("f0"))
    lead = stats.where("kind = 'p'").select(F.col("w").alias("prev"), F.col("n").alias("n1"), F.col("e").alias("e1"), F.col("f").alias("f1"))
    ends = kept.where("tail in ('word', 'tag')").select("last").distinct()
    known = ends.join(own, "last", "left").join(prefixes, "last", "left")
    # one row: the share of links within texts that end in a slash
    slash = stats.where("kind = 'l'").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("w") == "/", F.col("n"))), F.sum("n")), F.lit(0.0)).alias("slash"))

    # documents without a last word get spread keys that match nothing: null keys would all meet in one task
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\x00"), F.pmod(F.col("h"), F.lit(9973)).cast("string")))
    keyed = kept.withColumns({"last": spread(F.col("last")), "prev": spread(F.col("prev"))})
    joined = keyed.join(known, "last", "left").join(lead, "prev", "left").crossJoin(F.broadcast(slash))
    # one row a source: its limits, of which it has a few
    units = {u: F.collect_list(F.when(F.col("unit") == u, F.struct("low", "high"))).alias(f"_{u}") for u in ("n_chars", "n_bytes", "n_base")}
    joined = joined.join(limits.groupBy("source").agg(*units.values()), "source", "left")

    def at(unit: str) -> Column:
        return F.coalesce(F.exists(f"_{unit}", lambda x: F.col(unit).between(x["low"], x["high"])), F.lit(False))

    n0, f0 = F.coalesce("n0", F.lit(0)) - F.coalesce("f0", F.lit(0)), F.coalesce("f0", F.lit(0))
    inside_word = F.col("tail").isin("word", "tag") & (F.coalesce("longer", F.lit(0)) > PREFIX_TIMES * (n0 + 1))
    closer = (f0 >= 2) & (f0 >= TEXT_SHARE * F.coalesce("n0", F.lit(0))) & (F.coalesce("e0", F.lit(0)) < SENTENCE_SHARE * F.greatest(n0, F.lit(1)))
    ender = F.coalesce("e0", F.lit(0)) >= SENTENCE_SHARE * F.greatest(n0, F.lit(1))
    leads = (F.coalesce("e1", F.lit(0)) + F.coalesce("f1", F.lit(0)) >= LEAD_SHARE * F.coalesce("n1", F.lit(0))) | F.col("n1").isNull() | (F.col("n1") < 200)
    inside_sentence = (F.col("tail") == "word") & (F.col("n0") >= 20) & ~closer & ~(ender & leads)
    known_tag = (F.col("tail") == "tag") & (F.coalesce("n0", F.lit(0)) >= 3) & ~inside_word
    open_link = (F.col("tail") == "link") & (F.col("last") == "link:") & (F.col("slash") >= 0.9)
    broken = (F.col("tail") == "broken") | open_link
    judged = joined.where("tail <> 'blank'").select(
        "doc_id", "source", "n_chars",
        limit_reason(at("n_chars") | at("n_bytes"), at("n_base"), known_tag, broken).alias("_limit"), ending_reason(inside_word, inside_sentence, broken).alias("_ending"),
    )
    detector = F.when(F.col("_limit").isNotNull(), "histogram").when(F.col("_ending").isNotNull(), "ending")
    return judged.select("doc_id", "source", "n_chars", detector.alias("detector"), F.coalesce("_limit", "_ending").alias("cut_by")).where("detector is not null")


def truncation_report(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """``(source, n_docs, n_cut, share_cut, n_limit, n_transfer)`` per source, also where nothing is cut."""
    every = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    some = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"), F.count_if(F.col("detector") == "histogram").alias("n_limit"))
    joined = every.join(some, "source", "left").na.fill(0, ["n_cut", "n_limit"])
    return joined.select("source", "n_docs", "n_cut", (F.col("n_cut") / F.col("n_docs")).alias("share_cut"), "n_limit", (F.col("n_cut") - F.col("n_limit")).alias("n_transfer"))
