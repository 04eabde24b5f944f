"""Deterministic sampling and allocation (M6-M15, T15-T20). Draws are by hash, so they need no order of rows and repeat exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    """A uniform number in 0..1 from a key and a seed: the first 52 bits of an MD5 digest."""
    digits = F.left(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def largest_remainder(df: DataFrame, stratum: str, total: int, least: int = 0) -> DataFrame:
    """``(stratum, size, allocated)``: ``total`` places by size, leftovers to the greatest remainders, ties to the smaller name (M7).

    ``least`` places go to every stratum first (if it has that many rows). Totals are one row; the strata that
    get a leftover are the first of an ordered limit, so no task ranks all strata.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    base = F.least(F.lit(least), F.col("size"))
    sums = sizes.agg(F.sum("size").alias("_all"), F.sum(base).alias("_given"))
    rest = F.greatest(F.lit(total) - F.col("_given"), F.lit(0))
    first = sizes.crossJoin(F.broadcast(sums)).withColumn("_exact", F.col("size") * rest / F.col("_all")).withColumn("_floor", F.floor("_exact"))  # one row
    left = first.agg(F.max(rest) - F.sum("_floor")).first()[0] or 0
    order = [F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.col(stratum)]
    lucky = first.orderBy(*order).limit(max(0, int(left))).select(F.col(stratum).alias("_lucky"), F.lit(1).alias("_more"))
    both = first.join(lucky, first[stratum].eqNullSafe(F.col("_lucky")), "left")
    return both.select(stratum, "size", F.least(F.col("size"), base + F.col("_floor") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("allocated"))


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, seed: int, least: int = 0) -> DataFrame:
    """Rows of each stratum with the smallest draws, as many as it was allocated, with ``sample_weight`` = size / allocated.

    No stratum gets more than ``most`` rows, a fixed number, so each task keeps that many before the shuffle.
    """
    alloc = largest_remainder(df, stratum, total, least)
    most = max(total, least)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), key))).where(F.col("_r") <= most)
    return ranked.join(alloc, ranked[stratum].eqNullSafe(alloc[stratum])).where(F.col("_r") <= F.col("allocated")).select(ranked["*"], (F.col("size") / F.col("allocated")).alias("sample_weight")).drop("_r")


def quota_pick(df: DataFrame, key: str, rules: Sequence[tuple[str, Column, int]], order: Sequence[Column]) -> DataFrame:
    """Rows picked by ordered rules (name, condition, quota), no row twice (M6).

    A row goes to its first rule whose quota it makes; each rule ranks what earlier rules left. One
    pass a rule, on rows that meet some rule.
    """
    left = df.where(_any([c for _, c, _ in rules]))
    picked = None
    for name, condition, quota in rules:
        one = left.where(condition).orderBy(*order).limit(quota).withColumn("rule", F.lit(name))
        picked = one if picked is None else picked.unionByName(one)
        left = left.join(one.select(key), key, "left_anti")
    return picked


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def head_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group (M39, T17, T20); Spark keeps k rows a group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def round_robin(df: DataFrame, category: str, rotate: str, order: Sequence[Column], quota: int) -> DataFrame:
    """``quota`` rows of each category, taken in turn from the values of ``rotate``."""
    turn = df.withColumn("_t", F.row_number().over(Window.partitionBy(category, rotate).orderBy(*order))).where(F.col("_t") <= quota)
    return turn.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy("_t", rotate))).where(F.col("_r") <= quota).drop("_t", "_r")


def source_priority(df: DataFrame, keys: Sequence[str], priority: Column, value: str, order: Sequence[Column]) -> DataFrame:
    """The row of the best source per key and whether sources conflict in ``value``."""
    by = Window.partitionBy(*keys)
    n = F.max(value).over(by) != F.min(value).over(by)
    return df.withColumns({"conflict": F.coalesce(n, F.lit(False)), "_r": F.row_number().over(by.orderBy(priority, *order))}).where("_r = 1").drop("_r")


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """A fold for every row, the same for all rows of a group, by hash: balanced for many groups, with no shuffle. Labels don't count (see ``stratified_group_folds``)."""
    return df.withColumn("fold", F.floor(draw(group, seed) * folds).cast("int"))


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 0, ranked_up_to: int = 5000, max_kinds: int = 100_000) -> DataFrame:
    """``(group, fold)``: whole groups in folds of like size and like label shares.

    Groups with the same label counts are interchangeable, so the folds are planned on the histogram of label counts, from
    the largest groups down: each kind is dealt evenly, and what is left of it goes to the folds that lack its labels most. Groups of a kind
    are told apart by their draw: by rank in a kind of up to ``ranked_up_to`` groups, by the draw's range in a
    larger one. The kinds of groups come to the driver and are checked against ``max_kinds``.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    kinds = counts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_l", "_n"))).alias("_kind"))  # one entry a label
    hist = kinds.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).limit(max_kinds + 1).collect()
    if len(hist) > max_kinds:
        raise ValueError(f"more than {max_kinds} different label counts of a group")
    kind_of = lambda r: tuple((x._l, x._n) for x in r._kind)
    loads: list[dict[str, float]] = [{} for _ in range(folds)]
    plan = []
    for r in sorted(hist, key=lambda r: (-sum(n for _, n in kind_of(r)), kind_of(r))):
        lack = sorted(range(folds), key=lambda f: (sum(loads[f].get(x, 0) * n for x, n in kind_of(r)), sum(loads[f].values()), f))
        at = 0
        for i, f in enumerate(lack):
            to = at + r.n // folds + (i < r.n % folds)
            plan.append((r._kind, r.n > ranked_up_to, float(at) / r.n, float(to) / r.n, at, to, f))
            for x, n in kind_of(r):
                loads[f][x] = loads[f].get(x, 0) + n * (to - at)
            at = to
    spark = df.sparkSession
    schema = "_kind array<struct<_l:string,_n:bigint>>, _wide boolean, _lo double, _hi double, _from bigint, _to bigint, fold int"
    table = spark.createDataFrame(plan, schema).withColumn("_k", F.md5(F.to_json("_kind"))).drop("_kind")
    wide = table.select("_k", "_wide").distinct()
    keyed = kinds.select(group, F.md5(F.to_json("_kind")).alias("_k"), draw(group, seed).alias("_d")).join(F.broadcast(wide), "_k")  # kinds, checked
    ranks = keyed.where("not _wide").withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_d", group)) - 1)
    few = ranks.join(F.broadcast(table.drop("_wide")), "_k").where("_r >= _from and _r < _to").select(group, "fold")
    many = keyed.where("_wide").join(F.broadcast(table.drop("_wide")), "_k").where("_d >= _lo and (_d < _hi or _hi = 1)").select(group, "fold")
    return few.unionByName(many)


def without_leaks(df: DataFrame, cluster: str, role: str, protected: Sequence[str]) -> DataFrame:
    """Rows outside the protected roles whose cluster has no protected row, and all protected rows."""
    held = df.where(F.col(role).isin(*protected) & F.col(cluster).isNotNull()).select(cluster).distinct()
    return df.where(F.col(role).isin(*protected)).unionByName(df.where(~F.coalesce(F.col(role).isin(*protected), F.lit(False))).join(held, cluster, "left_anti"))


def split_leaks(df: DataFrame, key: str, role: str) -> DataFrame:
    """``(key, n_roles)`` of keys that occur in several roles (Q7), by two mergeable aggregates."""
    return df.where(F.col(key).isNotNull() & F.col(role).isNotNull()).groupBy(key, role).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.count(F.lit(1)).alias("n_roles")).where("n_roles > 1")


def head_and_fill(df: DataFrame, group: str, order: Sequence[Column], head: int, fill: int) -> DataFrame:
    """The first ``head`` rows of each group, then the first ``fill`` of all others, as ``part`` head or fill.

    A row behind ``head + fill`` others of its group can be neither, so each task keeps that many of a group.
    """
    ranked = head_per_group_ranked(df, group, order, head + fill)
    first = ranked.where(F.col("_r") <= head).withColumn("part", F.lit("head"))
    return first.unionByName(ranked.where(F.col("_r") > head).orderBy(*order).limit(fill).withColumn("part", F.lit("fill"))).drop("_r")


def head_per_group_ranked(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """``head_per_group`` with the rank as ``_r``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k)


def capped_pick(df: DataFrame, order: Sequence[Column], caps: dict[str, int], total: int) -> DataFrame:
    """Up to ``total`` rows in order, skipping rows of a value whose cap is reached (T16); ``order`` is total.

    Taken in rounds: each reads the next ``total`` rows, in order, that no exhausted value rules out. The driver holds ``total`` rows
    and the exhausted values, of which there are no more than picks.
    """
    used: dict[tuple, int] = {}
    picked: list = []
    while len(picked) < total:
        open_rows = df
        for c, cap in caps.items():
            for value in [v for (name, v), n in used.items() if name == c and n >= cap]:
                open_rows = open_rows.where(~F.col(c).eqNullSafe(F.lit(value)))
        taken = set(picked)
        batch = [r for r in open_rows.orderBy(*order).limit(total + len(picked)).collect() if r not in taken]
        if not batch:
            break
        for row in batch:
            keys = [(c, row[c]) for c in caps]
            if len(picked) < total and all(used.get(k, 0) < caps[k[0]] for k in keys):
                picked.append(row)
                for k in keys:
                    used[k] = used.get(k, 0) + 1
    return df.sparkSession.createDataFrame(picked, df.schema)
