"""Closed-form statistics as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(count: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, within 0..1; null for n <= 0."""
    p = F.try_divide(count, n)
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(low, F.lit(0.0))), F.when(ok, F.least(high, F.lit(1.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def softmax(margins: Sequence[Column]) -> list[Column]:
    """Stable softmax of columns; equal shares where all are 0 or null."""
    filled = [F.coalesce(m, F.lit(0.0)) for m in margins]
    top = F.greatest(*filled) if len(filled) > 1 else filled[0]
    parts = [F.exp(m - top) for m in filled]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def bin_of(score: Column, bins: int = 10, closed: str = "left") -> Column:
    """Bin 0..bins-1 of a score in 0..1: [lo, hi) with the last closed, or (lo, hi] with the first closed."""
    if closed == "left":
        return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    return F.greatest(F.ceil(score * bins) - 1, F.lit(0)).cast("int")


def cut_right(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval (edge, next edge] that holds the value; null outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        test = (value > lo) & (value <= hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out
