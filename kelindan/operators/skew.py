"""Per-key results where a handful of keys own most rows (problem 5).

Every aggregate used is algebraic and keeps a fixed-width state, so Spark's hash
aggregation combines rows in each map task (spilling its table when it is
full) and ships one compact state per key and task. A key with a third of all rows
costs the reducer as many rows as there are map tasks, never its own rows.
The latest row is found the same way: the order of a row is packed into one
decimal(38), whose maximum is as mergeable as a sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room below the timestamp for the key that breaks ties.
TIE_BASE = 10**15


def key_text(value: Column) -> Column:
    """A tag or handle as a key: without outer blanks and leading # or @, in lower case; null for null."""
    return F.lower(F.regexp_replace(value, r"^[\s\p{Z}#@]+|[\s\p{Z}]+$", ""))


def row_order(at: Column, tie: Column) -> Column:
    """One decimal that sorts rows by time, then by ``tie`` (0 <= tie < 10**15, else the job fails); null times come first."""
    tie = F.when(tie.between(0, TIE_BASE - 1) | tie.isNull(), tie).otherwise(F.raise_error(F.lit("a tie lies outside 0 .. 10**15 - 1")).cast("bigint"))
    micros = F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(-(10**17))).cast("decimal(20,0)")
    return (micros * F.lit(TIE_BASE).cast("decimal(16,0)") + F.coalesce(tie, F.lit(0)).cast("decimal(16,0)")).cast("decimal(38,0)")


def per_key(
    df: DataFrame, key: Column, key_name: str, sums: Sequence[str], at: str, tie: Column, latest: Mapping[str, Column]
) -> DataFrame:
    """Rows, sums and the latest row of each key.

    Null and blank keys form one group under null, nothing is dropped. Nulls add
    nothing to a sum; a key with nulls only sums to null. ``latest`` names
    columns taken from the row with the greatest (``at``, ``tie``). Repeated
    rows count as often as they occur. Clashing names are safe: the input is
    projected to private names first.
    """
    base = df.select(
        F.nullif(key, F.lit("")).alias("_k"), row_order(F.col(at), tie).alias("_o"), F.col(at).alias("_at"),
        *[F.col(c).cast("bigint").alias(f"_s{i}") for i, c in enumerate(sums)],
        *[c.alias(f"_l{i}") for i, c in enumerate(latest.values())],
    )
    return base.groupBy(F.col("_k").alias(key_name)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(f"_s{i}").alias(f"sum_{c}") for i, c in enumerate(sums)],
        F.max("_at").alias("latest_at"),
        *[F.max_by(f"_l{i}", "_o").alias(f"latest_{c}") for i, c in enumerate(latest)],
    )


def heavy_keys(df: DataFrame, key: Column, share: float = 0.03) -> DataFrame:
    """``(key_text, n_rows, share)`` of the non-blank keys that own at least ``share`` of all rows.

    All rows count, also those without a key. At most ``1/share`` keys can qualify,
    so the filter's result is small whatever the input.
    """
    counts = df.select(F.nullif(key, F.lit("")).alias("key_text")).groupBy("key_text").agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.agg(F.count(F.lit(1)).alias("n_all"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .where(F.col("key_text").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("n_all")))
        .select("key_text", "n_rows", (F.col("n_rows") / F.col("n_all")).alias("share"))
    )
