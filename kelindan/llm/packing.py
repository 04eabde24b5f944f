"""Filling containers of fixed capacity with items (problem 9).

Sizes are whole numbers up to the capacity, so an instance is a histogram: how many items have
each size. The packing is solved on the histogram, whatever the number of items:

1. Reduction by dominance (after Martello and Toth): for the largest size j, a set {j}
   or {j, k} is fixed for good when every other set that could share a container with j
   can be exchanged for it: nothing fits beside j; k fills the container exactly; or
   nothing that fits beside j, alone or together, is larger than the largest single partner k.
   Fixing removes these items, the rest is a smaller instance.
2. Best fit decreasing for what remains, on groups of equal containers: all items of a size go
   into the group with the least room that holds them, as many to a container as fit.

Both give *placements*: so many items of a size, so many to a container, from this container on. There are
at most a few per size. Items get their container by their rank within their size,
counted in buckets of bounded size, so no task ranks all items of a frequent size.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelindan.session import stage


#: Rank buckets that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Placement:
    """Items of ``size`` with ranks ``lo`` .. ``hi - 1``: ``each`` to a container from ``first`` on, at places from ``place`` on."""

    size: int
    lo: int
    hi: int
    first: int
    each: int
    place: int


class Packer:
    """Solves one histogram; ``containers`` counts the containers used."""

    def __init__(self, counts: Mapping[int, int], capacity: int) -> None:
        if any(not 0 < s <= capacity or n < 0 for s, n in counts.items()):
            raise ValueError("sizes must lie in 1..capacity")
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for s, n in counts.items():
            self.left[s] += n
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.containers = 0
        self.fixed = 0
        self.placements: list[Placement] = []

    def _put(self, size: int, n: int, first: int, each: int, place: int) -> None:
        lo = int(self.used[size])
        self.placements.append(Placement(size, lo, lo + n, first, each, place))
        self.used[size] += n
        self.left[size] -= n

    def _fix(self, sizes: tuple[int, ...], n: int) -> None:
        for place, size in enumerate(sizes):
            self._put(size, n, self.containers, 1, place)
        self.containers += n
        self.fixed += n

    def _sums(self, room: int) -> int:
        """The greatest total up to ``room`` that remaining items can make together (each size as often as it is left)."""
        reach = 1  # bit t: total t can be made
        mask = (1 << (room + 1)) - 1
        for s in np.flatnonzero(self.left[: room + 1]):
            n, step = min(int(self.left[s]), room // int(s)), 1
            while n > 0:  # binary splitting of the multiplicity
                take = min(step, n)
                reach |= (reach << (take * int(s))) & mask
                n -= take
                step *= 2
            if reach >> room & 1:
                return room
        return reach.bit_length() - 1

    def reduce(self) -> None:
        """Fix all dominating sets, from the largest size down."""
        for j in range(self.capacity, 0, -1):
            while self.left[j] > 0:
                room = self.capacity - j
                self.left[j] -= 1  # one item of size j stands in the container
                fits = np.flatnonzero(self.left[: room + 1])
                best = int(fits[-1]) if len(fits) else 0
                dominated = best == 0 or best == room or self._sums(room) <= best
                self.left[j] += 1
                if not dominated:
                    break
                if best == 0:
                    self._fix((j,), int(self.left[j]) if room < j else 1)
                else:
                    self._fix((j, best), int(min(self.left[j], self.left[best])) if best != j else int(self.left[j] // 2))

    def best_fit(self) -> None:
        """Best fit decreasing on what is left; groups of containers with equal room are handled together."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first container, containers, items in each)

        def add(room: int, first: int, n: int, items: int) -> None:
            if n and room:
                if room not in groups:
                    bisect.insort(rooms, room)
                    groups[room] = []
                groups[room].append((first, n, items))

        for size in range(self.capacity, 0, -1):
            while self.left[size] > 0:
                at = bisect.bisect_left(rooms, size)
                if at == len(rooms):
                    each = self.capacity // size
                    n = -(-int(self.left[size]) // each)
                    first, items, room = self.containers, 0, self.capacity
                    self.containers += n
                else:
                    room = rooms[at]
                    first, n, items = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                    each = room // size
                full = min(n, int(self.left[size]) // each)
                if full:
                    self._put(size, full * each, first, each, items)
                    add(room - each * size, first, full, items + each)
                rest = int(min(self.left[size], each - 1)) if full < n else 0
                if rest:
                    self._put(size, rest, first + full, rest, items)
                    add(room - rest * size, first + full, 1, items + rest)
                add(room, first + full + bool(rest), n - full - bool(rest), items)

    def solve(self) -> list[Placement]:
        self.reduce()
        self.best_fit()
        return self.placements


def split_items(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(key, part_no, start_at, n)``: one row per item, items above the capacity in full parts and a rest.

    Null sizes count as 0. An item of size 0 stays one row of size 0.
    """
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    parts = F.greatest(F.ceil(n / capacity), F.lit(1))
    rows = sized.select(F.col(key).alias(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))).alias("part_no"))
    return rows.select(key, "part_no", (F.col("part_no") * capacity).alias("start_at"), F.least(F.lit(capacity), F.col("_n") - F.col("part_no") * capacity).alias("n"))


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, bucket_rows: int = 500_000) -> DataFrame:
    """``(key, part_no, start_at, n, container_id, place_no)``, containers from 1, places from 1.

    No container holds more than ``capacity``; an item is split only if it alone
    exceeds it. Items of size 0 take no room: they share container 0. Repeated keys are separate items. An empty table
    gives an empty result. To the driver goes the histogram (at most ``capacity`` rows) and the sizes of
    rank buckets (one per ``bucket_rows`` items and size), which are broadcast only while they are few.
    """
    return pack_with(sized, key, size, capacity, bucket_rows)[0]


def pack_with(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, bucket_rows: int = 500_000) -> tuple[DataFrame, Packer]:
    """``pack``, and the packer with its counts: containers in all and those fixed by dominance."""
    spark = sized.sparkSession
    items = stage(split_items(sized, key, size, capacity), "pk-items")
    hist = {int(r.n): int(r.c) for r in items.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    zero = hist.pop(0, 0)
    packer = Packer(hist, capacity)
    placed = [(p.size, p.lo, p.hi, p.first + 1, p.each, p.place) for p in packer.solve()]
    if zero:
        placed.append((0, 0, zero, 0, zero, 0))

    spread = [(s, max(1, -(-c // bucket_rows))) for s, c in (*hist.items(), (0, zero))]
    buckets = F.broadcast(spark.createDataFrame(spread, "n bigint, _b bigint"))
    ranked = items.join(buckets, "n").withColumn("_k", F.pmod(F.xxhash64(key, "part_no"), F.col("_b")))
    sizes = ranked.groupBy("n", "_k").agg(F.count(F.lit(1)).alias("c")).collect()
    start, offsets = {}, []
    for r in sorted(sizes, key=lambda r: (r.n, r._k)):
        offsets.append((r.n, r._k, start.get(r.n, 0)))
        start[r.n] = start.get(r.n, 0) + r.c
    known = spark.createDataFrame(offsets, "n bigint, _k bigint, _o bigint")
    if len(offsets) <= MOST_BROADCAST:
        known = F.broadcast(known)
    order = Window.partitionBy("n", "_k").orderBy(key, "part_no")
    ranks = ranked.withColumn("_r", F.row_number().over(order) - 1).join(known, ["n", "_k"]).withColumn("_r", F.col("_r") + F.col("_o"))
    table = F.broadcast(spark.createDataFrame(placed, "n bigint, _lo bigint, _hi bigint, _first bigint, _each bigint, _place bigint"))
    at = F.col("_r") - F.col("_lo")
    packed = ranks.join(table, "n").where("_r >= _lo and _r < _hi").select(
        key, "part_no", "start_at", "n",
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("bigint").alias("container_id"),
        (F.col("_place") + F.pmod(at, F.col("_each")) + 1).cast("bigint").alias("place_no"),
    )
    return packed, packer


def packing_summary(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row ``(n_items, n_containers, n_tokens, least_containers, fill)``; least_containers is the total over the capacity, rounded up."""
    loads = packed.where("n > 0").groupBy("container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("load"))
    return loads.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("load") / capacity), F.lit(0)).alias("least_containers"), (F.sum("load") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
