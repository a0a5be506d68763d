"""Packing by budget against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.operators import packing


def sequential(sizes, budget):
    """The index of the row that opens each row's chunk."""
    out, start, used = [], None, 0
    for i, s in enumerate(sizes):
        if start is None or used + s > budget:
            start, used = i, 0
        used += s
        out.append(start)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_outcomes(seed):
    """The table of outcomes tells what the rule does to any open chunk."""
    rng = random.Random(seed)
    budget = rng.choice([1, 5, 30])
    sizes = [rng.choice([0, 1, 2, 3, 7, 40]) for _ in range(rng.randrange(1, 40))]
    room, start, used = packing.outcomes(np.array(sizes), budget)
    for before in [*range(budget + 1), budget + 9]:
        whole = sequential([before, *sizes], budget) if before else None
        if whole is None:  # an open chunk of rows without tokens
            whole = sequential([0, *sizes], budget)
        i = int(np.searchsorted(room, max(budget - before, -1), "right")) - 1
        last = whole[-1]
        assert start[i] == last - 1
        assert used[i] == (sum(sizes) if last == 0 else sum(sizes[last - 1 :]))


def packed(rows, frame, budget):
    got = packing.pack(frame, ["g"], ["o"], F.col("s"), budget).collect()
    assert sorted(map(repr, rows)) == sorted(repr((r.g, r.o, r.s)) for r in got)
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append((r.o, r["_chunk"]))
    opens = {}
    for g, some in by_group.items():
        some.sort()
        chunks = [c for _, c in some]
        assert chunks == sorted(chunks)
        opens[g] = [some[chunks.index(c)][0] for c in chunks]
    assert len({r["_chunk"] for r in got}) == sum(len(set(o)) for o in opens.values())
    return opens


@pytest.mark.parametrize("budget", [1, 50, 1000])
def test_pack(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "", *map(str, range(20))]), i, rng.choice([None, 0, 0, 1, 5, 20, 49, 50, 51, 400])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, o long, s long").repartition(7)
    got = packed(rows, frame, budget)
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        starts = sequential([r[2] or 0 for r in mine], budget)
        assert got[g] == [mine[i][1] for i in starts]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "g string, o long, s long")
    assert packing.pack(empty, ["g"], ["o"], F.col("s"), 5).count() == 0
    ties = spark.createDataFrame([("a", 1, 3)] * 5, "g string, o long, s long")
    sizes = packing.pack(ties, [], ["o"], F.col("s"), 6).groupBy("_chunk").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 2, 2]
    with pytest.raises(ValueError):
        packing.pack(ties, [], ["o"], F.col("s"), 0)
