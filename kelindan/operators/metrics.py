"""Labelling quality: agreement, confusion, calibration, selective curves, intervals.

Everything reduces to a confusion or bin table by one group-by with map-side
combining; the closed forms run on those few rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.functions.stats import bin_of, ratio, softmax, wilson


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``(truth, pred, n)`` of rows that have both."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, support, predicted, correct, precision, recall, f1)``, also for labels that never occur; 0/0 is 0."""
    spark = cells.sparkSession
    both = cells.select(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("correct")).unionByName(
        cells.select(F.col("pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("correct"))
    )
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    full = spark.createDataFrame([(x,) for x in labels], "label string").join(sums, "label", "left").na.fill(0)
    p, r = ratio(F.col("correct"), F.col("predicted")), ratio(F.col("correct"), F.col("support"))
    return full.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def summary(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: n, accuracy, macro and weighted F1, balanced accuracy and the multiclass Matthews coefficient."""
    report = class_report(cells, labels)
    s, p, c = F.col("support"), F.col("predicted"), F.col("correct")
    sums = report.agg(
        F.sum(s).alias("n"), F.sum(c).alias("c"), F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * s).alias("wf"), F.avg("recall").alias("balanced_accuracy"),
        F.sum(s * p).alias("sp"), F.sum(s * s).alias("ss"), F.sum(p * p).alias("pp"),
    )
    n = F.col("n").cast("double")
    top = F.col("c") * n - F.col("sp")
    bottom = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("ss")))
    return sums.select("n", ratio(F.col("c"), n).alias("accuracy"), "macro_f1", ratio(F.col("wf"), n).alias("weighted_f1"), "balanced_accuracy", ratio(top, bottom).alias("mcc"))


def kappa(cells: DataFrame, labels: Sequence[str], weighted: bool = False) -> DataFrame:
    """One row (n, agreement, kappa): Cohen's kappa over a fixed list of labels, linear weights on request; null where chance agreement is complete."""
    index = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (label, i)])
    k = len(labels)
    w = (1 - F.abs(index[F.col("truth")] - index[F.col("pred")]) / (k - 1)) if weighted else (F.col("truth") == F.col("pred")).cast("double")
    inner = cells.where(F.col("truth").isin(*labels) & F.col("pred").isin(*labels))
    row = [F.sum(F.when(F.col("truth") == x, F.col("n")).otherwise(0)) for x in labels]
    col = [F.sum(F.when(F.col("pred") == x, F.col("n")).otherwise(0)) for x in labels]
    sums = inner.agg(F.sum("n").alias("n"), F.sum(F.col("n") * w).alias("o"), *[x.alias(f"r{i}") for i, x in enumerate(row)], *[x.alias(f"c{i}") for i, x in enumerate(col)])
    weight = lambda i, j: (1 - abs(i - j) / (k - 1)) if weighted else float(i == j)
    chance = _sum([F.col(f"r{i}") * F.col(f"c{j}") * weight(i, j) for i in range(k) for j in range(k) if weight(i, j)]) / (F.col("n") * F.col("n"))
    seen = F.try_divide("o", "n")
    return sums.select("n", seen.alias("agreement"), F.try_divide(seen - chance, F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def calibration(df: DataFrame, confidence: Column, correct: Column, bins: int = 10, closed: str = "left") -> DataFrame:
    """``(bin, n, mean_confidence, accuracy)``."""
    given = df.select(confidence.cast("double").alias("p"), correct.cast("double").alias("y")).where("p is not null and y is not null")
    return given.groupBy(bin_of(F.col("p"), bins, closed).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_confidence"), F.avg("y").alias("accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    """One row (n, ece) of a calibration table."""
    return table.agg(F.sum("n").alias("n"), ratio(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def brier(df: DataFrame, probabilities: dict[str, Column], truth: Column, scale: str = "sum") -> DataFrame:
    """One row (n, brier): squared error summed over classes, or their mean."""
    parts = [(p - (truth == c).cast("double")) ** 2 for c, p in probabilities.items()]
    value = _sum(parts) / (len(parts) if scale == "mean" else 1)
    return df.where(truth.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("brier"))


def threshold_curve(df: DataFrame, score: Column, label: Column, thresholds: Sequence[float]) -> DataFrame:
    """Binary counts and F1 at each threshold (score >= threshold).

    Rows are reduced to counts between thresholds first; the curve is a running
    sum over at most ``len(thresholds) + 1`` rows, so the data is read once.
    """
    cuts = sorted(thresholds)
    index = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("s")))
    rows = df.select(score.cast("double").alias("s"), label.cast("int").alias("y")).where("s is not null and y is not null")
    counts = rows.groupBy(index.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    at = df.sparkSession.createDataFrame([(i + 1, float(c)) for i, c in enumerate(cuts)], "i int, threshold double")
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    # at most len(thresholds) + 1 rows on either side
    curve = at.join(F.broadcast(counts), F.col("k") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("selected"), F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"))
    out = curve.crossJoin(F.broadcast(total))
    p, r = ratio(F.col("tp"), F.col("selected")), ratio(F.col("tp"), F.col("all_pos"))
    return out.select("threshold", "selected", "tp", ratio(F.col("selected"), F.col("all_n")).alias("coverage"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def abstaining_label(probabilities: dict[str, Column], has_text: Column, least: float = 0.42) -> Column:
    """No Text, Uncertain below ``least``, else the first label with the greatest probability."""
    top = F.greatest(*probabilities.values())
    out = F.when(~has_text, "No Text").when(top < least, "Uncertain")
    for name, p in probabilities.items():
        out = out.when(p == top, name)
    return out


def shares(df: DataFrame, label: str, domain: Sequence[str], z: float = 1.96) -> DataFrame:
    """Count, share and Wilson interval of each label of a fixed domain, also of absent ones."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.createDataFrame([(x,) for x in domain], "label string").join(counts, "label", "left").na.fill(0)
    total = full.agg(F.sum("n").alias("total"))
    lo, hi = wilson(F.col("n"), F.col("total"), z)
    return full.crossJoin(F.broadcast(total)).select("label", "n", "total", ratio(F.col("n"), F.col("total")).alias("share"), lo.alias("ci_low"), hi.alias("ci_high"))  # one row


def subgroup_accuracy(df: DataFrame, groups: Sequence[str], correct: Column, least: int = 20) -> DataFrame:
    """``(dimension, value, n, accuracy, supported)`` for several grouping columns in one pass."""
    base = df.select(*groups, correct.cast("double").alias("_y"))
    long = base.select(F.explode(F.array(*[F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("value")) for g in groups])).alias("d"), "_y")
    out = long.groupBy("d.dimension", "d.value").agg(F.count("_y").alias("n"), F.avg("_y").alias("accuracy"))
    return out.withColumn("supported", F.col("n") >= least)


def bootstrap_macro_f1(cells: DataFrame, labels: Sequence[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row (macro_f1, ci_low, ci_high): percentile bootstrap.

    Resampling rows and counting them is a multinomial draw of the confusion cells, so
    the bootstrap runs on the cells, whatever the number of rows.
    """
    rows = {(r.truth, r.pred): r.n for r in cells.collect()}  # at most labels x labels
    k = len(labels)
    m = np.array([[rows.get((a, b), 0) for b in labels] for a in labels], dtype=float)

    def f1(x: np.ndarray) -> float:
        tp, s, p = np.diag(x), x.sum(1), x.sum(0)
        return float(np.mean(np.divide(2 * tp, s + p, out=np.zeros(k), where=s + p > 0)))

    n = int(m.sum())
    if not n:
        return cells.sparkSession.createDataFrame([(0.0, None, None)], "macro_f1 double, ci_low double, ci_high double")
    sample = np.random.default_rng(seed).multinomial(n, (m / n).ravel(), draws).reshape(draws, k, k)
    lo, hi = np.percentile([f1(x) for x in sample], [2.5, 97.5])
    return cells.sparkSession.createDataFrame([(f1(m), float(lo), float(hi))], "macro_f1 double, ci_low double, ci_high double")


def mcnemar(df: DataFrame, correct_a: Column, correct_b: Column) -> DataFrame:
    """One row (b, c, p_value): discordant pairs and the exact two-sided binomial test."""
    counts = df.agg(F.count_if(correct_a & ~correct_b).alias("b"), F.count_if(~correct_a & correct_b).alias("c")).first()
    b, c = int(counts.b), int(counts.c)
    n, k = b + c, min(b, c)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    p = min(1.0, 2 * math.fsum(map(math.exp, logs))) if n else 1.0
    return df.sparkSession.createDataFrame([(b, c, p)], "b bigint, c bigint, p_value double")


def soft_labels(counts: dict[str, Column]) -> dict[str, Column]:
    """Softmax of margins by label."""
    return dict(zip(counts, softmax(list(counts.values())), strict=True))


def paired_bootstrap(cells: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row (delta, ci_low, ci_high, p_better): accuracy of b minus accuracy of a over the same resamples.

    ``cells`` has (a, b, n): how often either was right; resampled as in ``bootstrap_macro_f1``.
    """
    rows = {(bool(r.a), bool(r.b)): int(r.n) for r in cells.where("a is not null and b is not null").collect()}  # four cells
    keys = [(False, False), (False, True), (True, False), (True, True)]
    n = np.array([rows.get(k, 0) for k in keys], dtype=float)
    total = int(n.sum())
    schema = "delta double, ci_low double, ci_high double, p_better double"
    if not total:
        return cells.sparkSession.createDataFrame([(None, None, None, None)], schema)
    sample = np.random.default_rng(seed).multinomial(total, n / total, draws)
    delta = (sample[:, 1] - sample[:, 2]) / total
    lo, hi = np.percentile(delta, [2.5, 97.5])
    return cells.sparkSession.createDataFrame([(float((n[1] - n[2]) / total), float(lo), float(hi), float((delta > 0).mean()))], schema)


def dominant_stability(counts: DataFrame, group: str, label: str, n: str, labels: Sequence[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """``(group, dominant, stability)``: the most frequent label of each group and the share of resamples that agree.

    ``counts`` has one row per group and label. Each group is resampled from its counts, with a
    seed of its own, so the result doesn't depend on partitioning; ties go to the first label.
    """
    order = list(labels)

    def run(frames):
        for f in frames:
            out = []
            for g, pairs in zip(f["g"], f["pairs"], strict=True):
                x = np.zeros(len(order))
                for p in pairs:
                    if p["l"] in order:
                        x[order.index(p["l"])] += p["n"]
                total = int(x.sum())
                if total:
                    sample = np.random.default_rng([seed, zlib.crc32(str(g).encode())]).multinomial(total, x / total, draws)
                    best = int(np.argmax(x))
                    out.append((g, order[best], float((sample.argmax(axis=1) == best).mean())))
            yield pd.DataFrame(out, columns=[group, "dominant", "stability"])

    wide = counts.groupBy(F.col(group).cast("string").alias("g")).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col(n).alias("n"))).alias("pairs"))  # one entry per label
    return wide.mapInPandas(run, f"{group} string, dominant string, stability double")
