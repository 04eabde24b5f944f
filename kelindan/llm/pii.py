"""Personal information in free text (problem 7).

Candidates: generators of high recall propose overlapping spans of five types. Each
span has format features (digits, groups, separators, capitals, known name parts) and context
features (cue words before it, what touches it). For each type, boosted trees give a
calibrated probability; spans above the type's threshold compete, the more probable and then the longer first,
and do not overlap.

Training needs no hand-made labels. In a bounded sample of texts (``SAMPLE_TEXTS``, by hash of
the key), spans with a telling cue or an unmistakable format are labelled; half of the
training copies have their context features hidden, so the trees learn to judge a format without
its cue. Calibration and thresholds come from margins of models that haven't seen the span (``FOLDS``); the final model is fitted on all.
A few prior examples (``prior_texts``) are part of every training, so that each type has labels of both kinds however small the sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.llm.boosting import Boosted, fit

#: Bound of the training sample, in texts.
SAMPLE_TEXTS = 12_000
#: Folds whose held-out margins calibrate the probabilities and choose the thresholds.
FOLDS = 3
TYPES = ("email", "phone", "identity_number", "address", "person_name")

# Cue words of the two languages, lower case.
CUES = {
    "phone": ("wa", "telp", "tel", "telepon", "hp", "hubungi", "nomorku", "call", "call/wa", "chat", "phone", "sms", "whatsapp", "kontak"),
    "identity": ("nik", "ktp", "identitas", "npwp", "paspor", "sim", "kk", "id card", "passport"),
    "other_number": ("video", "order", "resi", "batch", "exp", "bpom", "rp", "inv", "invoice", "isi", "pukul", "jam", "no resi", "sku", "kode"),
    "email": ("email", "e-mail", "surel", "kontak", "mail", "kirim ke"),
    "address": ("alamat", "rumahku di", "kirim ke", "paketnya ke", "cod di", "rumah di", "tinggal di", "address"),
    "name": ("an.", "a.n.", "atas nama", "nama saya", "namaku", "penerima", "dari", "buat", "sama", "kata", "nama", "name is", "dengan"),
    "no_name": ("varian", "brand", "toko", "wangi", "aroma", "merek", "merk", "produk", "shop", "seri", "shade", "bpom", "kota", "desa"),
}
# Titles before a name; they belong to the cue, not to the name.
TITLES = ("ibu", "bapak", "bpk", "pak", "bu", "kak", "kakak", "mbak", "mas", "bang", "sdr", "sdri", "hj", "h", "dr", "ny", "tn", "om", "tante", "mr", "mrs", "ms")
# Words that open an address, and words that are never part of a name.
STREETS = r"jalan|jln|jl|gang|gg|komplek|kompleks|perumahan|perum|kampung|kp|dusun|lorong|lr"
NOT_NAME = {"bpom", "toko", "brand", "varian", "cod", "ktp", "nik", "npwp", "rt", "rw", "blok", "no", "jl", "jln", "jalan", "gang", "gg", "komplek", "kompleks", "perum", "perumahan", "inv", "rp", "wa", "glow", "jaya", "raya"}

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|titik)\s?[\])}>]\s?|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9](?:[\w+-]|\.(?=\w))*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+", re.I)
# digits with single separators, opened by an area code in brackets, a plus sign or nothing
RUN = re.compile(r"\((?:\+?62|[0oO]\d{1,4})\)[ .-]?\d+(?:[ .\-/]\d+)*|\+?(?<![^\W_])(?:[oO](?=\d{2})|\d)\d*(?:[ .\-/]\d+)*")
GROUP = re.compile(r"[oO]?\d+")
STREET = re.compile(rf"(?<![\w@#])(?:{STREETS})\b\.?", re.I)
ADDRESS = re.compile(
    rf"(?:{STREETS})\b\.?(?:\s+(?!no\b|blok\b|rt\b)(?-i:[A-Z])[\w']*+)*(?:\s+(?!no\b|blok\b|rt\b)[A-Za-z][\w']*){{0,4}}(?:\s*,?\s*(?:(?:no|blok)\b\.?\s*)?[A-Za-z]?-?\d+[A-Za-z]?)?(?:\s*,?\s*rt\.?\s*\d+(?:\s*/\s*rw\.?\s*\d+)?)?(?:,\s+(?!(?:toko|brand|bpom|npwp)\b)(?-i:[A-Z][a-z]+))?", re.I,
)
CAPITALS = re.compile(r"(?<![\w@#.])(?:[A-Z][a-z']+(?:[ ]+[A-Z][a-z']+)+|[A-Z]{2,}(?:[ ]+[A-Z]{2,})+)(?!\w)")
LOWER_WORD = re.compile(r"[^\W\d_]+")
_AFTER_CUE = re.compile(r"(?<![\w@#])(?:an\.|a\.n\.|atas nama|nama saya|namaku|penerima:?|salam buat|aja dari|titip ke)\s+(?:(?:" + "|".join(TITLES) + r")\.?\s+)?", re.I)


@dataclass(frozen=True)
class Span:
    """A candidate: type, code-point range and features (format first, then context)."""

    kind: str
    start: int
    end: int
    shape: tuple[float, ...]
    context: tuple[float, ...]
    silver: int | None


def _cue(before: str, kind: str) -> float:
    """Distance class of the nearest cue of a kind in the text before: 3 touches, 2 within some words, 0 none."""
    best = 0.0
    for cue in CUES[kind]:
        at = before.rfind(cue)
        while at >= 0:
            if (at == 0 or not before[at - 1].isalnum()) and (at + len(cue) == len(before) or not before[at + len(cue)].isalnum()):
                gap = before[at + len(cue) :].strip(" :=.,/-")
                best = max(best, 3.0 if not gap else 2.0 if len(gap) <= 6 else 1.0 if len(gap) <= 12 else 0.0)
                break
            at = before.rfind(cue, 0, at)
    return best


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0 if c in "/@#_" else 4.0 if c in "-." else 5.0


def _digit_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Groups of digits that may form one number."""
    for run in RUN.finditer(text):
        yield [(m.start() + run.start(), m.end() + run.start()) for m in GROUP.finditer(run[0])]


def _numbers(text: str, low: str) -> Iterator[Span]:
    for groups in _digit_runs(text):
        if sum(b - a for a, b in groups) < 8:
            continue
        # a group of nine digits or more is likely a number of its own: what stands beside it is beside another number
        large = [b - a >= 9 for a, b in groups]
        parts = [0]
        for k in range(1, len(groups)):
            parts.append(parts[-1] + (large[k] or large[k - 1]))
        ahead = low[max(0, groups[0][0] - 26) : groups[0][0]].rstrip("(+ ")
        # every span of 8 to 22 digits: at most 22 groups from each start
        pairs = []
        for i in range(len(groups)):
            size = 0
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 22:
                    break
                if size >= 8:
                    pairs.append((i, j))
        for i, j in pairs:
            a, b = groups[i][0], groups[j][1]
            digits = "".join(text[x:y] for x, y in groups[i : j + 1])
            seps = {text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)}
            sep = 0.0 if not seps else {" ": 1.0, ".": 2.0, "-": 3.0}.get(next(iter(seps)), 4.0) if len(seps) == 1 else 5.0
            sizes = [y - x for x, y in groups[i : j + 1]]
            left, right = text[a - 1 : a], text[b : b + 1]
            plus, paren = left == "+", left == "("
            if plus or paren:
                left = text[a - 2 : a - 1] if a > 1 else ""
            start = digits.lower().replace("o", "0")
            across = parts[i] != parts[j]
            before_in, after_in = i > 0 and (across or parts[i - 1] == parts[i]), j < len(groups) - 1 and (across or parts[j + 1] == parts[j])
            shape = (
                len(digits), len(sizes), sizes[0], sizes[-1], max(sizes), sep, float(start[:1]), float(start[:2]), float(digits[0] in "oO"),
                float(plus), float(paren), _side(left), _side(right), float(before_in), float(after_in),
            )
            before = low[max(0, a - 26) : a].rstrip("(+ ")
            context = (_cue(before, "phone"), _cue(before, "identity"), _cue(before, "other_number"))
            whole = not before_in and not after_in
            for kind, own, other in (("phone", 0, 1), ("identity_number", 1, 0)):
                silver = None
                if across:  # two numbers, or one with its country code: unlabelled, the trees decide
                    pass
                elif context[2] == 3 or shape[11] in (1, 2, 3) or shape[12] in (1, 2):
                    silver = 0
                elif not whole and max(_cue(ahead, "phone"), _cue(ahead, "identity")) == 3:
                    silver = 0
                elif context[own] == 3:
                    silver = int(whole) if kind == "identity_number" or 9 <= len(digits) <= 14 else 0
                elif context[other] == 3:
                    silver = 0
                yield Span(kind, a, b, shape, context, silver)


def _emails(text: str, low: str) -> Iterator[Span]:
    for m in EMAIL.finditer(text):
        a, b = m.span()
        bracket = bool(re.search(r"[\[({<]", m[0]))
        local = re.match(r"[\w.+-]+", m[0])[0]
        domain = m[0][len(local) :]
        spaced_left = bool(re.match(r"\s+@\S", domain))
        labels = re.split(_DOT, domain)
        shape = (float(bracket), float(spaced_left), float(" @ " in m[0]), len(local), float(any(c.isdigit() for c in local)), float(bool(re.search(r"[.+_-]", local))), len(labels), len(labels[-1]), float(" at " in m[0]), _side(text[a - 1 : a]))
        context = (_cue(low[max(0, a - 20) : a].rstrip(), "email"),)
        plain = " at " in m[0] and not bracket
        yield Span("email", a, b, shape, context, 0 if spaced_left or (plain and not context[0]) else 1)


def _addresses(text: str, low: str) -> Iterator[Span]:
    for s in STREET.finditer(text):
        a = s.start()
        m = ADDRESS.match(text, a)
        b = m.end() if m else s.end()
        rest = text[s.end() : s.end() + 60]
        word = re.match(r"\s*([^\W\d_]+)", rest)
        first = word[1] if word else ""
        number = re.search(r"\d", rest[:45])
        gap = rest[: number.start()] if number else ""
        small = sum(w[0].islower() and w.lower() not in ("no", "blok", "rt", "rw") for w in LOWER_WORD.findall(gap)) if number else 9
        shape = (
            float(first[:1].isupper()), float(number.start() if number else 99), float(small), float(bool(re.search(r"\bno\b", rest[:45], re.I))), float(bool(re.search(r"\brt\b", rest[:45], re.I))),
            float(bool(re.search(r"\bblok\b", rest[:45], re.I))), float(text[a].isupper()), float("." in s[0]), float(len(s[0])), float(len(first)),
        )
        context = (_cue(low[max(0, a - 20) : a].rstrip(), "address"),)
        silver = 1 if first[:1].isupper() and number and small == 0 else 0 if not first[:1].isupper() and small > 1 else None
        yield Span("address", a, b, shape, context, silver)


def _names(text: str, low: str, parts: Mapping[str, str]) -> Iterator[Span]:
    spans: set[tuple[int, int]] = set()
    for m in CAPITALS.finditer(text):
        words = [(w.start() + m.start(), w.end() + m.start(), w[0].lower()) for w in re.finditer(r"\S+", m[0])]
        at = 0
        while at < len(words):
            while at < len(words) and (words[at][2] in TITLES or words[at][2] in NOT_NAME):
                at += 1
            to = at
            while to < len(words) and words[to][2] not in NOT_NAME and words[to][2] not in TITLES:
                to += 1
            if to - at >= 2:
                spans.add((words[at][0], words[to - 1][1]))
            at = max(to, at + 1)
    for m in _AFTER_CUE.finditer(text):
        w = re.match(r"([^\W\d_]+ [^\W\d_]+)( [^\W\d_]+)?", text[m.end() :])
        if w:
            spans.add((m.end(), m.end() + len(w[1])))
            if w[2] and w[2][1:].lower() in parts:
                spans.add((m.end(), m.end() + len(w[0])))
    words = [(w.start(), w.end(), w[0].lower()) for w in LOWER_WORD.finditer(text)]
    for k in range(len(words) - 1):
        if words[k][2] in parts and words[k + 1][2] in parts and text[words[k][1] : words[k + 1][0]] == " ":
            to = k + 1
            while to + 1 < len(words) and words[to + 1][2] in parts and text[words[to][1] : words[to + 1][0]] == " ":
                to += 1
            spans.add((words[k][0], words[to][1]))
    for a, b in sorted(spans):
        ws = text[a:b].split()
        known = [parts.get(w.lower()) for w in ws]
        before = low[max(0, a - 24) : a].rstrip()
        title = re.search(r"(?<!\w)(" + "|".join(TITLES) + r")\.?$", before)
        if title:
            before = before[: title.start()].rstrip()
        rest = text[b : b + 12]
        shape = (
            len(ws), known.count("given"), known.count("family"), float(known[0] == "given"), float(known[-1] == "family"), float(known[0] == "family"),
            float(text[a:b].isupper()), float(ws[0][0].isupper()), float(ws[-1][0].isupper()), len(ws[0]), len(ws[-1]), _side(text[a - 1 : a]),
            float(bool(re.match(r"\s*(?:no\b|\d|blok|rt\b|raya|indah)", rest, re.I))), float(any(w.lower() in NOT_NAME for w in ws)),
        )
        street = re.search(rf"(?:{STREETS})\.?\s*$", before)
        after = _cue(before, "name")
        against = _cue(before, "no_name")
        context = (after, against, float(bool(title)), float(bool(street)), float(bool(re.match(r"\s+(?:ya|kak|nih)\b", rest))))
        silver = None
        if against == 3 or street or text[a - 1 : a] in ("@", "#", "."):
            silver = 0
        elif (after == 3 or title) and shape[1] + shape[2] >= 1:
            silver = 1
        elif shape[3] and shape[4]:
            silver = 1
        elif after == 3 and shape[7] and shape[8]:
            silver = 1
        elif not shape[7] and shape[1] + shape[2] == 0:
            silver = 0
        yield Span("person_name", a, b, shape, context, silver)


def candidates(text: str, parts: Mapping[str, str]) -> list[Span]:
    """All proposed spans of a text; ``parts`` maps lower-case name parts to given or family."""
    low = text.lower()
    if len(low) != len(text):  # lower-casing changed the positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return [*_emails(text, low), *_numbers(text, low), *_addresses(text, low), *_names(text, low, parts)]


def _matrix(spans: Sequence[Span], hide: np.ndarray | None = None) -> np.ndarray:
    if not spans:
        return np.zeros((0, 1))
    x = np.array([(*s.shape, *s.context) for s in spans], dtype=float)
    if hide is not None:
        x[hide, len(spans[0].shape) :] = 0
    return x


@dataclass
class Detector:
    """A fitted model per type and the thresholds on calibrated probabilities."""

    models: dict[str, Boosted]
    thresholds: dict[str, float]
    parts: dict[str, str]

    def score(self, texts: Sequence[str | None]) -> list[list[Span]]:
        """Chosen spans of each text, by position."""
        found = [candidates(t, self.parts) if t else [] for t in texts]
        keep: list[list[tuple[float, Span]]] = [[] for _ in texts]
        for kind in TYPES:
            flat = [(i, s) for i, spans in enumerate(found) for s in spans if s.kind == kind]
            if not flat:
                continue
            p = self.models[kind].probability(_matrix([s for _, s in flat]))
            for (i, s), q in zip(flat, p, strict=True):
                if q >= self.thresholds[kind]:
                    keep[i].append((float(q), s))
        out = []
        for spans in keep:
            chosen: list[Span] = []
            for _, s in sorted(spans, key=lambda z: (-round(z[0], 3), z[1].start - z[1].end, z[1].start, z[1].kind)):
                if all(s.end <= c.start or s.start >= c.end for c in chosen):
                    chosen.append(s)
            out.append(sorted(chosen, key=lambda s: s.start))
        return out


def _part_counts(texts: Iterable[str], parts: Mapping[str, str]) -> dict[str, list[int]]:
    """By lower-case word: uses as given and as family in labelled names, and uses in lower case."""
    counts: dict[str, list[int]] = {}
    for t in texts:
        for s in _names(t, t.lower() if len(t.lower()) == len(t) else t, parts):
            if s.silver == 1 and t[s.start].isupper():
                ws = t[s.start : s.end].split()
                for k, w in enumerate(ws):
                    counts.setdefault(w.lower(), [0, 0, 0])[int(bool(k) and k == len(ws) - 1)] += 1
        for w in LOWER_WORD.findall(t):
            if w.islower():
                counts.setdefault(w, [0, 0, 0])[2] += 1
    return counts


#: A word is learnt that stands at least so often in labelled names, and in lower case at most in this share of that.
LEAST_NAMED, MOST_LOWER = 3, 0.34


def learnt_parts(texts: Sequence[str], parts: Mapping[str, str], least: int = LEAST_NAMED, most_lower: float = MOST_LOWER) -> dict[str, str]:
    """Name parts that the registry lacks: words that stand capitalised in labelled names at least ``least`` times and rarely in lower case."""
    return {w: "family" if f > g else "given" for w, (g, f, low) in _part_counts(texts, parts).items() if w not in parts and w not in NOT_NAME and g + f >= least and low <= most_lower * (g + f)}


def corpus_parts(df: DataFrame, column: str, parts: Mapping[str, str], max_parts: int = 100_000) -> dict[str, str]:
    """``learnt_parts`` of all distinct texts of the table: counted in one pass, summed by word; the lexicon's size is checked before it is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _part_counts(b.column(0).to_pylist(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(3)]], ["w", "g", "f", "low"])

    texts = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("t")).distinct()
    sums = texts.mapInArrow(run, "w string, g long, f long, low long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("g", "f", "low")])
    rows = sums.where((F.col("g") + F.col("f") >= LEAST_NAMED) & (F.col("low") <= MOST_LOWER * (F.col("g") + F.col("f")))).limit(max_parts + 1).collect()
    if len(rows) > max_parts:
        raise ValueError(f"more than {max_parts} learnt name parts")
    return {r.w: "family" if r.f > r.g else "given" for r in rows if r.w not in parts and r.w not in NOT_NAME}


def prior_texts() -> list[str]:
    """Examples of both kinds for every type, made by rule: eight or more labelled spans of each."""
    out = []
    for i in range(12):
        n = 10_000_000 + 7_654_321 * (i + 1)
        one, two = ("Sari", "Budi", "Rina", "Tono")[i % 4], ("Wiratama", "Kusuma", "Lestari")[i % 3]
        out += [f"hubungi 08{n % 10**8:08d}{i % 7} ya", f"wa: 08{i % 10}{n % 9}-{n % 10**4:04d}-{(n // 7) % 10**4:04d}", f"resi {n}{i}", f"order {n % 10**9}99"]
        out += [f"nik {n % 10**8:08d}{(n // 3) % 10**8:08d}", f"ktp {n % 10**4:04d} {n % 9973:04d} {n % 9931:04d} {n % 9907:04d}", f"video 74{n % 10**8:08d}{n % 10**8:08d}"]
        out += [f"email {one.lower()}{i}@surat{i}.example ya", f"surel: {one.lower()}.{two.lower()}@kotak.example", f"manis @toko{i}.example"]
        out += [f"alamat Jl. Melati No. {i + 1}, kirim ya", f"di Gang Mawar {i + 2} RT {i + 1}", f"jalan terus saja dulu {'lagi ' * (i % 3)}ya", f"jalan pelan banget hari ke sekian {i}"]
        out += [f"nama saya {one} {two} ya", f"an. {one} {two}", f"varian {one} {two} wangi", f"brand {one} {two}"]
    return out


def train(texts: Sequence[str], parts: Mapping[str, str], learnt: Mapping[str, str] | None = None) -> Detector:
    """A detector from texts alone; deterministic, order of texts doesn't matter. ``learnt``: parts counted elsewhere, else those of the texts."""
    once = sorted(set(texts))
    parts = {**(learnt_parts(once, parts) if learnt is None else learnt), **parts}
    spans = [s for t in sorted({*once, *prior_texts()}) for s in candidates(t, parts)]
    models: dict[str, Boosted] = {}
    thresholds: dict[str, float] = {}
    for kind in TYPES:
        own = [s for s in spans if s.kind == kind and s.silver is not None]
        y = np.array([s.silver for s in own])
        if not 0 < y.sum() < len(y):
            raise ValueError(f"no labels of both kinds for {kind}")
        draw = np.array([zlib.crc32(f"{s.start},{s.end},{s.shape},{s.context},{i}".encode()) for i, s in enumerate(own)])
        fold, hide = draw % FOLDS, (draw // FOLDS) % 2 == 0
        # each span twice: as it is and, for half of them, with its context hidden
        x, labels, folds = np.concatenate((_matrix(own), _matrix(own, hide))), np.concatenate((y, y)), np.concatenate((fold, fold))
        margins = np.zeros(len(labels))
        for k in range(FOLDS):
            out = folds == k
            if out.any():
                margins[out] = fit(x[~out], labels[~out]).margin(x[out])
        model = fit(x, labels)
        model.calibrate(margins, labels)
        p = model.calibrated(margins)
        cuts = np.unique(np.clip(p, 0.05, 0.95))
        f1 = np.array([2 * ((p >= c) & (labels == 1)).sum() / max(1, (p >= c).sum() + labels.sum()) for c in cuts])
        thresholds[kind] = float(min(max(np.median(cuts[f1 >= f1.max() - 1e-9]), 0.3), 0.7))
        models[kind] = model
    return Detector(models, thresholds, dict(parts))


def fit_detector(df: DataFrame, key: str, column: str, name_parts: DataFrame, sample_texts: int = SAMPLE_TEXTS, max_parts: int = 100_000) -> Detector:
    """Train on at most ``sample_texts`` texts, those with the least hash of their key; name parts are learnt from all. ``name_parts`` (name_part, part_kind) is a registry of checked size."""
    rows = name_parts.where("name_part is not null").limit(max_parts + 1).collect()
    if len(rows) > max_parts:
        raise ValueError(f"name_parts has more than {max_parts} rows")
    parts = {r.name_part.strip().lower(): r.part_kind for r in rows}
    sample = df.where(F.col(column).isNotNull()).select(F.col(column).alias("t"), F.xxhash64(F.col(key).cast("string")).alias("h")).orderBy("h", "t").limit(sample_texts)
    return train([r.t for r in sample.select("t").collect()], parts, corpus_parts(df, column, parts, max_parts))


def find_items(df: DataFrame, key: str, column: str, detector: Detector) -> DataFrame:
    """``(key, pii_type, start_at, end_at)``: one row per item, positions in code points from 1, the end exclusive. Null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for k, spans in zip(keys, detector.score(b.column(1).to_pylist()), strict=True):
                for s in spans:
                    for column_, v in zip(out, (k, s.kind, s.start + 1, s.end + 1), strict=True):
                        column_.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["k", "pii_type", "start_at", "end_at"])

    given = df.select(F.col(key).cast("string").alias("k"), F.col(column).cast("string").alias("t"))
    return given.mapInArrow(run, "k string, pii_type string, start_at long, end_at long").withColumnRenamed("k", key)


def redact(df: DataFrame, column: str, detector: Detector, out: str = "redacted") -> DataFrame:
    """``df`` with the text in which each item is replaced by its typed placeholder, as [PHONE]; null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        values = [t if isinstance(t, str) else None for t in texts]
        result = []
        for t, spans in zip(values, detector.score(values), strict=True):
            if t is not None:
                for s in reversed(spans):
                    t = f"{t[: s.start]}[{s.kind.upper()}]{t[s.end :]}"
            result.append(t)
        return texts.__class__(result, index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(column)))
