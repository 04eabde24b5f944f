"""Consensus labels from annotators who disagree (problem 6).

A Bayesian confusion model: every item has a true class with a Dirichlet-distributed
prior, every annotator a row-wise Dirichlet-distributed confusion matrix. Mean-field
variational inference alternates between item posteriors (from expected log
probabilities, by digamma) and Dirichlet counts (posterior-weighted label counts).

Distribution: votes are grouped once into one short row per item and staged. In each
round every task computes the posteriors of its items and the label counts
they imply, summed within the task; a group-by adds the tasks' counts. What reaches the
driver is one row per (annotator, true class, given class); the annotators are a registry
whose size is checked against ``max_annotators``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.session import stage

CLASSES = ("Negative", "Neutral", "Positive")
# Spellings of the labels (lower case, trimmed), in both languages of the annotators.
SPELLINGS = {
    "negative": "Negative", "negatif": "Negative", "neg": "Negative",
    "neutral": "Neutral", "netral": "Neutral", "neu": "Neutral",
    "positive": "Positive", "positif": "Positive", "pos": "Positive",
}


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function for positive arguments: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    while (low := x < 6).any():
        shift[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def usable_label(label: Column) -> Column:
    """The class a written label stands for; null for blank, abstaining and unknown answers."""
    written = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])[written]


def latest_votes(df: DataFrame, item: str, annotator: str, label: str, at: str, tie: str) -> DataFrame:
    """``(item, annotator, label)``: each annotator's latest answer per item, if it is usable.

    The latest answer counts even where it is blank: then the annotator has no
    vote on that item. Ties in time go to the greater ``tie``. Null items or annotators have no vote.
    """
    given = df.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), usable_label(F.col(label)).alias("label"), F.struct(F.col(at), F.col(tie)).alias("o"))
    given = given.where("item is not null and annotator is not null")
    return given.groupBy("item", "annotator").agg(F.max_by("label", "o").alias("label")).where("label is not null")


@dataclass
class Model:
    """A fitted model: Dirichlet counts of class and confusions, by annotator in ``names``' order."""

    names: list[str]
    classes: np.ndarray
    confusion: np.ndarray
    rounds: int

    def expected_logs(self) -> tuple[np.ndarray, np.ndarray]:
        prior = digamma(self.classes) - digamma(self.classes.sum(keepdims=True))
        rows = digamma(self.confusion) - digamma(self.confusion.sum(axis=2, keepdims=True))
        return prior, rows


def _posteriors(who: np.ndarray, what: np.ndarray, starts: np.ndarray, prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    score = prior + np.add.reduceat(logs[who, :, what], starts, axis=0)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.map(len).to_numpy()
    return np.concatenate(lists.to_numpy()).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1]))


def fit(votes: DataFrame, rounds: int = 500, tol: float = 1e-5, right: float = 4.0, wrong: float = 1.0, max_annotators: int = 200_000) -> tuple[Model, DataFrame]:
    """The model of ``votes`` and the items it was fitted on (staged rows of coded votes).

    Priors: ``wrong`` for each cell of a confusion row and ``right`` on its
    diagonal, so labels keep their meaning. Rounds end when no count of an annotator moves by more than ``tol`` of that annotator's votes.
    An empty table gives the priors. A model that still moves after ``rounds`` raises an error; some 15 are usual.
    """
    names = [r.annotator for r in votes.select("annotator").distinct().limit(max_annotators + 1).collect()]
    if len(names) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators: raise max_annotators if the driver can hold 9 counts for each")
    names.sort()
    k = len(CLASSES)
    spark = votes.sparkSession
    coded = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "annotator string, w int")
    code = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i)])
    small = F.broadcast(coded) if len(names) <= 50_000 else coded
    items = stage(
        votes.join(small, "annotator").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("w", code[F.col("label")].alias("c")))).alias("v"))
        .select("item", F.col("v.w").alias("w"), F.col("v.c").alias("c")), "votes",
    )
    base = np.full((len(names), k, k), wrong) + np.eye(k) * (right - wrong)
    model = Model(names, np.ones(k), base.copy(), 0)
    # the first posteriors come from the votes alone: confusions at their priors
    for n in range(1, rounds + 1):
        prior, logs = model.expected_logs()

        def tally(frames: Iterator[pd.DataFrame], prior=prior, logs=logs) -> Iterator[pd.DataFrame]:
            counts, classes = np.zeros_like(logs), np.zeros(k)
            for f in frames:
                if len(f):
                    (who, starts), (what, _) = _flat(f["w"]), _flat(f["c"])
                    post = _posteriors(who, what, starts, prior, logs)
                    classes += post.sum(axis=0)
                    each = np.repeat(post, np.diff(np.append(starts, len(who))), axis=0)
                    for t in range(k):
                        np.add.at(counts[:, t, :], (who, what), each[:, t])
            w, t, c = np.nonzero(counts)
            yield pd.DataFrame({"w": np.append(w, [-1] * k), "t": np.append(t, range(k)), "c": np.append(c, [0] * k), "n": np.append(counts[w, t, c], classes)})

        rows = items.select("w", "c").mapInPandas(tally, "w int, t int, c int, n double").groupBy("w", "t", "c").agg(F.sum("n").alias("n")).toPandas()
        confusion, classes = base.copy(), np.ones(k)
        at = rows[rows.w >= 0]
        np.add.at(confusion, (at.w.to_numpy(int), at.t.to_numpy(int), at.c.to_numpy(int)), at.n.to_numpy(float))
        top = rows[rows.w < 0]
        np.add.at(classes, top.t.to_numpy(int), top.n.to_numpy(float))
        moved = np.abs(confusion - model.confusion).max(axis=(1, 2))
        own = np.maximum(1.0, (confusion - base).sum(axis=(1, 2)))
        model = Model(names, classes, confusion, n)
        if (moved <= tol * own).all():
            return model, items
    raise RuntimeError(f"the annotators' counts still move after {rounds} rounds")


def consensus(model: Model, items: DataFrame) -> DataFrame:
    """``(item, label, p, n_votes, agreement)``: the most credible label, its posterior, votes and the share that gave it.

    Equal posteriors go to the first of ``CLASSES``.
    """
    prior, logs = model.expected_logs()

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            (who, starts), (what, _) = _flat(f["w"]), _flat(f["c"])
            post = _posteriors(who, what, starts, prior, logs)
            best = np.argmax(np.round(post, 12), axis=1)
            sizes = np.diff(np.append(starts, len(who)))
            same = np.add.reduceat((what == np.repeat(best, sizes)).astype(float), starts)
            yield pd.DataFrame({"item": f["item"], "label": np.array(CLASSES, dtype=object)[best], "p": post[np.arange(len(best)), best], "n_votes": sizes, "agreement": same / sizes})

    return items.mapInPandas(label, "item string, label string, p double, n_votes bigint, agreement double")


def reliability(model: Model, spark, z: float = 1.96) -> DataFrame:
    """``(annotator_id, true_label, n_effective, p_correct, p_low, p_high)``: posterior mean and interval of each diagonal cell.

    The interval is the normal one on the Beta marginal's logit, kept within 0..1; ``true_label`` "all" weighs classes by their posterior share.
    """
    rows = []
    share = model.classes / model.classes.sum()
    for name, m in zip(model.names, model.confusion, strict=True):
        mean = []
        for t, label in enumerate(CLASSES):
            a, b = m[t, t], m[t].sum() - m[t, t]
            p, sd = a / (a + b), math.sqrt(1 / a + 1 / b)
            lo, hi = (1 / (1 + math.exp(-(math.log(a / b) + s * z * sd))) for s in (-1, 1))
            mean.append(p)
            rows.append((name, label, float(a + b), float(p), lo, hi))
        total, p = float(m.sum()), float(np.dot(share, mean))
        sd = math.sqrt(sum(share[t] ** 2 * mean[t] * (1 - mean[t]) / (m[t].sum() + 1) for t in range(len(CLASSES))))
        rows.append((name, "all", total, p, max(0.0, p - z * sd), min(1.0, p + z * sd)))
    return spark.createDataFrame(rows, "annotator_id string, true_label string, n_effective double, p_correct double, p_low double, p_high double")


def krippendorff(votes: DataFrame) -> DataFrame:
    """One row ``(n_items, n_votes, observed_disagreement, expected_disagreement, alpha)``: nominal Krippendorff's alpha.

    Items with one vote carry no pair. alpha is null where nothing could disagree.
    """
    item = votes.groupBy("item").agg(F.count(F.lit(1)).alias("m"), *[F.count_if(F.col("label") == c).alias(f"n{i}") for i, c in enumerate(CLASSES)]).where("m > 1")
    n = [F.col(f"n{i}") for i in range(len(CLASSES))]
    apart = sum((x * (F.col("m") - x) for x in n[1:]), n[0] * (F.col("m") - n[0]))
    sums = item.agg(
        F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_votes"), F.sum(apart / (F.col("m") - 1)).alias("d"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(n)]
    )
    t = [F.col(f"t{i}") for i in range(len(CLASSES))]
    expected = sum((x * (F.col("n_votes") - x) for x in t[1:]), t[0] * (F.col("n_votes") - t[0])) / (F.col("n_votes") - 1)
    do, de = F.try_divide("d", "n_votes"), F.try_divide(expected, "n_votes")
    return sums.select("n_items", "n_votes", do.alias("observed_disagreement"), de.alias("expected_disagreement"), (1 - F.try_divide(do, de)).alias("alpha"))


def at_least(items: DataFrame, votes: int) -> DataFrame:
    """The items with at least so many usable votes."""
    return items.where(F.size("w") >= votes)

