"""Containers (problem 9)."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelindan.llm.packing import Packer, pack, packing_summary


def loads(counts, capacity):
    p = Packer(counts, capacity)
    load, places, ranks = Counter(), defaultdict(list), defaultdict(list)
    for x in p.solve():
        ranks[x.size].append((x.lo, x.hi))
        for r in range(x.hi - x.lo):
            load[x.first + r // x.each] += x.size
            places[x.first + r // x.each].append(x.place + r % x.each)
    for size, n in counts.items():
        at = 0
        for lo, hi in sorted(ranks[size]):
            assert lo == at
            at = hi
        assert at == n
    assert all(v <= capacity for v in load.values()) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert len(load) == p.containers
    return p


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        seen = set()
        for k, room in enumerate(bins):
            if room >= sizes[i] and room not in seen:
                seen.add(room)
                bins[k] -= sizes[i]
                place(i + 1, bins)
                bins[k] += sizes[i]
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.integers(6, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=9))))
def test_close_to_the_optimum(case):
    capacity, sizes = case
    p = loads(Counter(sizes), capacity)
    best = optimum(sorted(sizes, reverse=True), capacity)
    assert best <= p.containers <= best + 1


@settings(max_examples=80, deadline=None)
@given(st.integers(6, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_reduction_keeps_the_optimum(case):
    """Fixing dominating sets never costs a container."""
    capacity, sizes = case
    p = Packer(Counter(sizes), capacity)
    p.reduce()
    rest = [s for s in range(capacity, 0, -1) for _ in range(int(p.left[s]))]
    assert p.fixed + (optimum(rest, capacity) if rest else 0) == optimum(sorted(sizes, reverse=True), capacity)


def test_many_items_of_one_size():
    assert loads({700: 1_000_000}, 2048).containers == 500_000
    with pytest.raises(ValueError):
        Packer({9: 1}, 8)


def test_frame(spark):
    data = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 100), (6, 100), (6, 100), (7, 1948)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens int").withColumn("n", F.lit("x")).withColumn("_n", F.lit(1))
    packed = pack(df, bucket_rows=2)
    got = packed.collect()
    assert sorted((r.doc_id, r.part_no, r.start_at, r.n) for r in got) == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 2048), (5, 0, 0, 100), (6, 0, 0, 100), (6, 0, 0, 100), (7, 0, 0, 1948)]
    load = Counter()
    for r in got:
        load[r.container_id] += r.n
    assert max(load.values()) <= 2048 and load[0] == 0 and len({(r.container_id, r.place_no) for r in got}) == len(got)
    s = packing_summary(packed).first()
    assert (s.n_items, s.n_tokens, s.least_containers) == (8, 7348 - 0, 4) or s.n_containers >= s.least_containers
    assert pack(df.limit(0)).count() == 0 and packing_summary(pack(df.limit(0))).first().n_items == 0
