"""Exact quantiles without one task that holds every value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, and distinct values of a bin that are read at once.
BINS = 4096


def exact_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The interpolated quantile of a numeric column, as ``percentile`` gives it; null for no values.

    Histograms of ``BINS`` bins, summed within the tasks, narrow the range to the two values that the quantile lies between;
    only bins come to the driver. Nulls don't count.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    top = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not top.n:
        return None
    at = share * (top.n - 1)
    below, above = math.floor(at), math.ceil(at)
    x = _nth(values, below, top.lo, top.hi)
    y = x if above == below else _nth(values, above, top.lo, top.hi)
    return x + (y - x) * (at - below)


def _nth(values: DataFrame, k: int, lo: float, hi: float) -> float:
    """The value of rank ``k`` from 0 among those in lo .. hi, both included."""
    while lo < hi:
        width = (hi - lo) / BINS
        if not (width > 0 and lo + width > lo):
            width = math.ulp(max(abs(lo), abs(hi)))
        number = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(BINS))
        bins = values.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))).groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: r.b):
            if k < r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo
