"""Graph tables: degrees, density, audits, aggregation, and bounded per-group graph algorithms."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelindan.functions.normalize import pseudonym
from kelindan.session import stage


def _kinds(edges: DataFrame, kinds: DataFrame, default: str) -> DataFrame:
    one = kinds.dropDuplicates(["node"]).select("node", "kind")
    s, t = one.withColumnsRenamed({"node": "source", "kind": "_ks"}), one.withColumnsRenamed({"node": "target", "kind": "_kt"})
    out = edges.join(s, "source", "left").join(t, "target", "left")
    return out.withColumns({"_ks": F.coalesce("_ks", F.lit(default)), "_kt": F.coalesce("_kt", F.lit(default))})


def degrees(edges: DataFrame, weight: str) -> DataFrame:
    """``(node, degree, n_neighbours, weighted_degree)`` from both ends of each edge."""
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), weight).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), weight))
    # edges of one pair are summed first, so neighbours are counted without a distinct aggregate
    pairs = ends.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    return pairs.groupBy("node").agg(F.sum("n").alias("degree"), F.count(F.lit(1)).alias("n_neighbours"), F.sum("w").alias("weighted_degree"))


def group_density(edges: DataFrame, groups: DataFrame, weight: str) -> DataFrame:
    """Nodes, edges, density, average degrees and greatest weight of each component (G7); ``groups`` is (node, component)."""
    nodes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    inner = edges.join(groups.withColumnRenamed("node", "source"), "source").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(weight).alias("w"), F.max(weight).alias("x"))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return nodes.join(inner, "component").select(
        "component", "n_nodes", "n_edges", F.round(F.try_divide(2.0 * e, n * (n - 1)), 9).alias("density"), F.round(2.0 * e / n, 9).alias("average_degree"),
        F.round(2.0 * F.col("w") / n, 9).alias("average_weighted_degree"), F.round("x", 9).alias("max_weight"),
    )


def topology_audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, self loops, repeated edges, blank ends and ends without a node."""
    blank = F.col("source").isNull() | F.col("target").isNull() | (F.trim("source") == "") | (F.trim("target") == "")
    counts = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum(F.when(F.col("source") == F.col("target"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank_endpoints"),
    )
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()
    lost = ends.join(nodes.select("node"), "node", "left_anti").agg(F.count(F.lit(1)).alias("missing_endpoints"))
    return counts.crossJoin(F.broadcast(lost))  # one row


def orient(edges: DataFrame, inside: DataFrame, outside: DataFrame, salt: str) -> DataFrame:
    """Pairs of an inside and an outside account as (community, other, scope, public_id)."""
    both = edges.select(F.col("source").alias("community"), F.col("target").alias("other"), "n_evidence").unionByName(edges.select(F.col("target").alias("community"), F.col("source").alias("other"), "n_evidence"))
    kept = both.join(inside.select(F.col("username").alias("community")), "community", "left_semi").join(outside.select(F.col("username").alias("other")), "other", "left_semi")
    return kept.select("community", "other", F.when(F.col("n_evidence") >= 2, "MULTI_EVIDENCE").otherwise("SINGLE_EVIDENCE").alias("scope"), pseudonym(F.col("other"), salt).alias("public_id"))


def edge_summary(edges: DataFrame, kinds: DataFrame, default: str, weight: str) -> DataFrame:
    """Edges, weight and nodes on either side by unordered pair of node kinds."""
    typed = _kinds(edges, kinds, default).withColumn("pair_type", F.concat_ws("–", F.least("_ks", "_kt"), F.greatest("_ks", "_kt")))
    sums = typed.groupBy("pair_type").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum(weight), 6).alias("total_weight"))
    nodes = typed.select("pair_type", F.explode(F.array("source", "target")).alias("node")).distinct().groupBy("pair_type").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sums.join(nodes, "pair_type")


def aggregate_graph(edges: DataFrame, kinds: DataFrame, default: str, weight: str) -> DataFrame:
    """The graph between node kinds: parallel edges summed, with a logarithmic weight for drawing."""
    typed = _kinds(edges, kinds, default)
    out = typed.groupBy(F.least("_ks", "_kt").alias("source"), F.greatest("_ks", "_kt").alias("target")).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n_edges"))
    return out.withColumn("visual_weight", F.round(F.log1p("weight"), 9))


def structural_hash(edges: DataFrame, *columns: str) -> DataFrame:
    """One row ``(n, hash)`` that doesn't depend on row order or partitioning (G12): a sum of row digests (60 bits of MD5)."""
    digest = F.conv(F.left(F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash"))


def pair_flags(a: Column, b: Column) -> dict[str, Column]:
    """Whether one, both or neither of two conditions holds (P11); a null counts as not holding."""
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return {"exactly_one": x != y, "both": x & y, "neither": ~x & ~y}


def visual_maps(graph: DataFrame, weight: str = "weight") -> DataFrame:
    """A drawn graph's columns: log weight, opacity 0.2 .. 1 in proportion to the greatest weight, and dense rank by weight.

    The ranks are those of the distinct weights of a graph small enough to draw; each is joined back by its weight.
    """
    top = graph.agg(F.max(weight).alias("_top"))
    ranks = graph.select(F.col(weight).alias("_w")).distinct()
    ranks = ranks.withColumn("visual_rank", F.dense_rank().over(Window.orderBy(F.desc("_w"))))  # one row per weight of a graph to draw
    out = graph.crossJoin(F.broadcast(top)).join(ranks, F.col(weight) == F.col("_w"))  # one row
    return out.withColumns({"visual_weight": F.round(F.log1p(weight), 9), "opacity": F.round(0.2 + 0.8 * F.try_divide(F.col(weight), F.col("_top")), 9)}).drop("_top", "_w")


def clean_edges(edges: DataFrame, nodes: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Edges with the reasons to drop them, joined by ``; `` in the order of rules, empty if kept.

    Rules: blank end, self loop, artefact node, missing node. ``artefacts`` and
    ``nodes`` have ``node``.
    """
    bad, known = artefacts.select("node").distinct(), nodes.select("node").distinct()
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = edges
    for side in ("source", "target"):
        out = out.join(mark(bad.withColumnRenamed("node", side), f"_a_{side}"), side, "left").join(mark(known.withColumnRenamed("node", side), f"_k_{side}"), side, "left")
    blank = F.col("source").isNull() | F.col("target").isNull() | (F.trim("source") == "") | (F.trim("target") == "")
    rules = F.array(
        F.when(blank, "blank endpoint"), F.when(F.col("source") == F.col("target"), "self loop"),
        F.when(F.col("_a_source").isNotNull() | F.col("_a_target").isNotNull(), "artefact node"), F.when(~blank & (F.col("_k_source").isNull() | F.col("_k_target").isNull()), "missing node"),
    )
    return out.withColumn("reasons", F.array_join(F.array_compact(rules), "; ")).drop("_a_source", "_a_target", "_k_source", "_k_target")


# Bounded graphs: one community or component at a time. The caller states the greatest group; a larger one is refused by name, never cut.


def _adjacency(rows: Iterable[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    adj: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in rows:
        if a != b:
            adj[a][b] = adj[a].get(b, 0.0) + w
            adj[b][a] = adj[b].get(a, 0.0) + w
    return adj


def betweenness_of(rows: Iterable[tuple[str, str, float]], total_nodes: int | None = None) -> dict[str, float]:
    """Normalised shortest-path betweenness, unweighted, by dependency accumulation from every node."""
    adj = _adjacency(rows)
    score = dict.fromkeys(adj, 0.0)
    for s in sorted(adj):
        order, paths, dist, preds = [], {s: 1.0}, {s: 0}, defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    preds[w].append(v)
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in preds[w]:
                gain[v] += paths[v] / paths[w] * (1 + gain[w])
            if w != s:
                score[w] += gain[w]
    n = total_nodes or len(adj)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {v: x * scale for v, x in score.items()}


def louvain_of(rows: Iterable[tuple[str, str, float]], least_gain: float = 1e-9) -> dict[str, str]:
    """Communities by greedy modularity: local moves until none gains, then the graph of communities, and again.

    Nodes are visited in name order, ties go to the smaller community, so the
    result is defined. A community is named by its smallest node.
    """
    adj = _adjacency(rows)
    name = {v: v for v in adj}
    level = {v: dict(ns) for v, ns in adj.items()}
    loops = dict.fromkeys(level, 0.0)
    while True:
        total = sum(sum(ns.values()) for ns in level.values()) + 2 * sum(loops.values())
        if total == 0:
            break
        degree = {v: sum(ns.values()) + 2 * loops[v] for v, ns in level.items()}
        own = {v: v for v in level}
        size = dict(degree)
        moved, changed = True, False
        while moved:
            moved = False
            for v in sorted(level):
                links: dict[str, float] = defaultdict(float)
                for w, x in level[v].items():
                    links[own[w]] += x
                size[own[v]] -= degree[v]
                stay = links.get(own[v], 0.0) - size[own[v]] * degree[v] / total
                best, gain = own[v], stay
                for c in sorted(links):
                    g = links[c] - size[c] * degree[v] / total
                    if g > gain + least_gain:
                        best, gain = c, g
                size[best] = size.get(best, 0.0) + degree[v]
                if best != own[v]:
                    own[v], moved, changed = best, True, True
        if not changed:
            break
        name = {v: own[c] for v, c in name.items()}
        merged: dict[str, dict[str, float]] = {c: defaultdict(float) for c in set(own.values())}
        inner = defaultdict(float)
        for v, ns in level.items():
            inner[own[v]] += loops[v]
            for w, x in ns.items():
                if own[v] == own[w]:
                    inner[own[v]] += x / 2
                else:
                    merged[own[v]][own[w]] += x
        level = {c: dict(ns) for c, ns in merged.items()}
        loops = {c: inner[c] for c in level}
    least: dict[str, str] = {}
    for v in sorted(name):
        least.setdefault(name[v], v)
    return {v: least[c] for v, c in name.items()}


def focal_of(rows: Iterable[tuple[str, str, float]], floor: float, keep: float = 0.5) -> tuple[list[str], float]:
    """A focal set: from the heaviest edge, add the node that keeps the mean edge weight of the induced graph highest.

    Growth ends when that mean falls below ``floor`` or below ``keep`` of the
    weight it started from, the second stop condition that published results imply. Returns
    the sorted nodes and the mean edge weight.
    """
    adj = _adjacency(rows)
    edges = sorted(((-w, a, b) for a in adj for b, w in adj[a].items() if a < b))
    if not edges:
        return [], 0.0
    w, a, b = edges[0]
    inside, weight, count = {a, b}, -w, 1
    first = -w
    # weight and number of links of each outside neighbour to the set
    near: dict[str, tuple[float, int]] = {}

    def reach(u: str) -> None:
        for v, x in adj[u].items():
            if v not in inside:
                s, n = near.get(v, (0.0, 0))
                near[v] = (s + x, n + 1)

    for u in (a, b):
        reach(u)
    while True:
        best = None
        for v in sorted(near):
            s, n = near[v]
            mean = (weight + s) / (count + n)
            if best is None or mean > best[0] + 1e-12:
                best = (mean, v, s, n)
        if best is None or best[0] < floor or best[0] < keep * first:
            break
        inside.add(best[1])
        del near[best[1]]
        reach(best[1])
        weight, count = weight + best[2], count + best[3]
    return sorted(inside), weight / count


def _stripped(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(core, mass, score)`` of a connected graph after its leaves are taken off again and again, (i, j) each edge once.

    ``mass`` of a node is the number of nodes that hang from it, itself included; ``score`` counts the ordered pairs
    whose paths lead through a node by what hangs from it: for a node taken off these are all, for one of the core those with an end there.
    A tree leaves one node.
    """
    degree, other = np.bincount(np.r_[i, j], minlength=n), np.zeros(n, dtype=np.int64)
    np.bitwise_xor.at(other, i, j)
    np.bitwise_xor.at(other, j, i)
    stack = np.flatnonzero(degree == 1).tolist()
    degree, other, mass, squares, core = degree.tolist(), other.tolist(), [1] * n, [0] * n, [True] * n
    while stack:
        u = stack.pop()
        if degree[u] != 1:
            continue
        v = other[u]  # of the neighbours only this one is left
        core[u], degree[u] = False, 0
        mass[v] += mass[u]
        squares[v] += mass[u] ** 2
        degree[v] -= 1
        other[v] ^= u
        if degree[v] == 1:
            stack.append(v)
    core, mass, squares = np.array(core), np.array(mass, dtype=np.float64), np.array(squares, dtype=np.float64)
    below = mass - 1
    return core, mass, below**2 - squares + 2 * below * (n - mass)


def _dependencies(start: np.ndarray, to: np.ndarray, mass: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Dependencies on each node, summed over ``sources``: Brandes for a batch of sources, level by level, each edge once per source and direction.

    Node v's neighbours are ``to[start[v]:start[v + 1]]``. A node counts as ``mass`` sources and targets.
    """
    n, cells = len(mass), len(mass) * len(sources)
    degree = np.diff(start)
    base = np.arange(len(sources)) * n
    reached, paths = np.zeros(cells, dtype=bool), np.zeros(cells)
    front = base + sources
    reached[front], paths[front] = True, 1.0
    steps = []
    while len(front):
        v = front % n
        many = degree[v]
        ends = np.cumsum(many)
        post = np.arange(ends[-1]) + np.repeat(start[v] - (ends - many), many)
        child, parent = to[post] + np.repeat(front - v, many), np.repeat(front, many)
        fresh = ~reached[child]
        child, parent = child[fresh], parent[fresh]
        more = np.bincount(child, paths[parent], minlength=cells)
        front = np.flatnonzero(more)
        reached[front], paths[front] = True, more[front]
        steps.append((child, parent))
    gain, weight = np.zeros(cells), np.tile(mass, len(sources))
    for child, parent in reversed(steps):
        if len(child):
            gain += np.bincount(parent, paths[parent] * ((weight[child] + gain[child]) / paths[child]), minlength=cells)
    gain[base + sources] = 0.0
    return (gain.reshape(len(sources), n) * mass[sources, None]).sum(axis=0)


def betweenness(edges: DataFrame, groups: DataFrame, block: int = 512, batch: int = 32) -> DataFrame:
    """``(component, node, score)``: normalised unweighted betweenness of every node, exact, without a bound on the component.

    Brandes in blocks of source nodes: a task has ``block`` sources and the numbered edges of their
    component, 16 bytes each, and up to ``batch`` sources at a time of a matrix of all its nodes. So a component costs
    tasks in proportion to its nodes; the work of each is that of its edges. Trees that hang from a component are counted in
    closed form, and neither their nodes nor their edges are searched.
    """
    ids = stage(groups.select("component", "node", (F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1).cast("int").alias("i")), "ids")
    s, t = ids.select(F.col("node").alias("source"), "component", "i"), ids.select(F.col("node").alias("target"), F.col("i").alias("j"))
    numbered = edges.where("source <> target").select("source", "target").join(s, "source").join(t, "target").select("component", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    sizes = ids.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sent = numbered.join(sizes, "component").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        n, low = int(f["n"].iloc[0]), int(key[1]) * block
        high = min(n, low + block)
        i, j = f["i"].to_numpy(), f["j"].to_numpy()
        core, mass, hung = _stripped(i, j, n)
        score = np.zeros(n)
        score[low:high] = hung[low:high]
        ids = np.flatnonzero(core)
        if len(ids) > 1:
            at = np.cumsum(core) - 1
            kept = core[i] & core[j]
            i, j = at[i[kept]], at[j[kept]]
            i, j = np.r_[i, j], np.r_[j, i]
            start, to = np.r_[0, np.cumsum(np.bincount(i, minlength=len(ids)))], j[np.argsort(i, kind="stable")]
            own = np.flatnonzero((ids >= low) & (ids < high))
            wide = max(1, min(batch, (1 << 20) // len(ids)))
            for k in range(0, len(own), wide):
                score[ids] += _dependencies(start, to, mass[ids], own[k : k + wide])
        held = np.flatnonzero(score)
        return pd.DataFrame({"component": np.array([key[0]] * len(held), dtype=object), "i": held.astype(np.int32), "score": score[held]})

    kind = ids.schema["component"].dataType.simpleString()
    sums = sent.groupBy("component", "k").applyInPandas(run, f"component {kind}, i int, score double").groupBy("component", "i").agg(F.sum("score").alias("score"))
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n").cast("double") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return ids.join(sizes, "component").join(sums, ["component", "i"], "left").select("component", "node", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))


def per_group(edges: DataFrame, groups: DataFrame, how: str, weight: str, floor: float = 0.0, largest: int = 200_000) -> DataFrame:
    """Run ``betweenness``, ``louvain`` or ``focal`` on each component's edges, one task a component.

    Columns (component, node, score, community). Refuses a component of more than ``largest`` edges.
    """
    inner = edges.join(groups.withColumnRenamed("node", "source"), "source").select("component", "source", "target", F.col(weight).cast("double").alias("w"))
    sizes = inner.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    over = sizes.where(F.col("n") > largest).limit(1).collect()
    if over:
        raise ValueError(f"component {over[0].component} has {over[0].n} edges; more than {largest} don't fit one task")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(f["source"], f["target"], f["w"], strict=True))
        nodes = sorted({*f["source"], *f["target"]})
        score: dict[str, float] = {}
        own: dict[str, str] = {}
        if how == "betweenness":
            score = betweenness_of(rows)
        elif how == "louvain":
            own = louvain_of(rows)
        else:
            members, mean = focal_of(rows, floor)
            own = dict.fromkeys(members, members[0]) if members else {}
            score = dict.fromkeys(members, mean)
        return pd.DataFrame({"component": [key[0]] * len(nodes), "node": nodes, "score": [score.get(v, math.nan) for v in nodes], "community": [own.get(v) for v in nodes]})

    return inner.groupBy("component").applyInPandas(run, "component string, node string, score double, community string")
