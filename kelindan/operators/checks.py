"""Audit rows: expected against observed, baselines, leaks, checksums."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT = "metric string, expected double, observed double, passed boolean, notes string"


def gates(df: DataFrame, rules: Sequence[tuple[str, Column, str, float]]) -> DataFrame:
    """One audit row per rule (name, aggregate, comparison, expected), all from one pass (Q1, Q5).

    Comparisons are ==, >=, <=, > and <. A null observation fails.
    """
    one = df.agg(*[c.cast("double").alias(f"v{i}") for i, (_, c, _, _) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.lit(float(want)).alias("expected"), F.col(f"v{i}").alias("observed"), _holds(F.col(f"v{i}"), how, want).alias("passed"), F.lit(how).alias("notes")) for i, (name, _, how, want) in enumerate(rules)])
    return one.select(F.inline(rows))


def _holds(c: Column, how: str, want: float) -> Column:
    test = {"==": F.abs(c - want) <= 1e-9, ">=": c >= want, "<=": c <= want, ">": c > want, "<": c < want}[how]
    return F.coalesce(test, F.lit(False))


def all_passed(audit: DataFrame) -> DataFrame:
    """One row (n_checks, n_failed, status): ACCEPTED only if every check passed."""
    sums = audit.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"))
    return sums.withColumn("status", F.when((F.col("n_failed") == 0) & (F.col("n_checks") > 0), "ACCEPTED").otherwise("REJECTED"))


def baseline_delta(observed: DataFrame, baseline: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``(metric, baseline, observed, delta, status)``: MATCH, RERUN_DIFF_RECORDED, NEW or MISSING (Q2). Both have (metric, value)."""
    a, b = baseline.select("metric", F.col("value").alias("baseline")), observed.select("metric", F.col("value").alias("observed"))
    delta = F.col("observed") - F.col("baseline")
    status = F.when(F.col("baseline").isNull(), "NEW").when(F.col("observed").isNull(), "MISSING").when(F.abs(delta) <= tolerance, "MATCH").otherwise("RERUN_DIFF_RECORDED")
    return a.join(b, "metric", "full").select("metric", "baseline", "observed", delta.alias("delta"), status.alias("status"))


def invariants(named: Mapping[str, DataFrame]) -> DataFrame:
    """``(metric, expected, observed, passed, notes)`` of queries that must be empty (Q4); each stops at its count."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), F.lit(0.0).alias("expected"), F.col("n").cast("double").alias("observed"), (F.col("n") == 0).alias("passed"), F.lit("must be empty").alias("notes")) for name, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def file_digest(path: str, chunk: int = 1 << 20) -> str:
    """SHA-256 of a local file (Q3)."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def unchanged(before: Mapping[str, str], paths: Sequence[str]) -> dict[str, bool]:
    """Whether files still have the digests they had (Q3)."""
    return {p: os.path.exists(p) and before.get(p) == file_digest(p) for p in paths}


class OneShotLock:
    """A lock that lets a step run once (Q6): taken by creating a file that must not exist."""

    def __init__(self, path: str) -> None:
        self.path = path

    def take(self, note: str = "") -> None:
        """Raise FileExistsError if the step ran before."""
        fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        with os.fdopen(fd, "w") as f:
            f.write(note)

    def taken(self) -> bool:
        return os.path.exists(self.path)
