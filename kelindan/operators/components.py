"""Connected components of an undirected graph (G2), by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.session import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: every u has one v, and no v is a u."""
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
    return n.n == n.u and edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def merge_components(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``components`` (node, component) after more edges are known: only the components that the edges touch are searched.

    Nodes that only the new edges name are added.
    """
    a, b = (components.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in ("_s", "_t"))
    given = edges if hasattr(edges, "_staged_path") else stage(edges.select(src, dst), "given")  # read twice
    given = given.select(F.col(src).alias("_s"), F.col(dst).alias("_t"))
    between = given.join(a, "_s", "left").join(b, "_t", "left").select(F.coalesce("__s", "_s").alias("src"), F.coalesce("__t", "_t").alias("dst"))
    joined = connected_components(between).withColumnRenamed("component", "_new")
    moved = components.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("_new", "component").alias("component"))
    fresh = joined.join(components.select("node"), "node", "left_anti").select("node", F.col("_new").alias("component"))
    return moved.unionByName(fresh)


#: Edges up to which one task finds the components; more take rounds of joins.
FEW = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The stars (u, v) of the distinct edges, by union-find: v is the least node of a component, u each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), kind)
        up: dict = {}

        def root(x):
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        for a, b in zip(whole["u"].to_pylist(), whole["v"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in up if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.field(k).type) for k in (0, 1)], schema=kind)

    kind = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32()}.get(t, pa.string())) for c, t in edges.dtypes])
    return edges.coalesce(1).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the least node of its component.

    Null endpoints and self loops join nothing (a node that has only a self loop
    still gets its own component); repeated edges and their direction don't matter; an
    empty edge table gives an empty result. Each round is two equi-joins whose
    build sides are per-node minima, combined map-side, so a hub costs its degree
    and AQE may split it. The number of rounds grows with the logarithm of the
    longest path. Rounds are written to the shared folder. Up to ``few`` edges of text or whole numbers
    take no rounds: one task finds their components.
    """
    given = edges if hasattr(edges, "_staged_path") else stage(edges.select(src, dst), "given")  # read twice
    given = given.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = given.where("u = v").select("u").distinct()
    current = stage(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if set(dict(current.dtypes).values()) <= {"string"} or set(dict(current.dtypes).values()) <= {"bigint", "int"}:
        if current.count() <= few:
            step = stage(_in_one_task(current), "stars")
            unstage(current)
            current = step
    for _ in range(max_rounds):
        if _settled(current):
            break
        step = stage(_small_star(_large_star(current)).distinct(), "stars")
        unstage(current)
        current = step
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(
        nodes.unionByName(roots).select("node").distinct(), "node", "left_anti"
    )
    return nodes.unionByName(roots.distinct()).unionByName(alone)
