"""Vector codes against plain Lloyd's rounds over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of each valid row; Python's integers, every entry tried."""
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in x], y) for i, x, y in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    if not kept or not max(len(x) for _, x, _ in kept):
        return []
    width = -(-max(len(x) for _, x, _ in kept) // parts)
    limit = codes.component_limit(width * parts)
    kept = [(i, [max(-limit, min(limit, v)) for v in x] + [0] * (width * parts - len(x)), y) for i, x, y in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        own = nearest()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o[p][1] == j]
                if mine:
                    books[p][j] = [sum(v) // len(mine) for v in zip(*mine)]
    own = nearest()
    errors = [sum(d for d, _ in o) for o in own]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{j:02x}" for _, j in o), e, sum(f for f, (_, _, z) in zip(errors, kept) if z == y), digest) for (i, _, y), o, e in zip(kept, own, errors)), key=repr
    )


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_odd_vectors(spark):
    rows = [(1, [0.5] * 6, 1), (1, [0.5] * 6, 1), (2, None, 1), (3, [], None), (4, [1.0, None], 2), (5, [float("nan")] * 6, 2), (6, [float("inf")] * 6, 2), (None, [-0.0007, 0.25], None), (7, [3e38] * 6, 3), (8, [-3e38, 1.0], 3), (9, [1e-9] * 9, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("x"), "kind": F.lit(1), "own": F.lit(None), "error": F.lit(2.5), "slot": F.lit(1)})
    assert got(codes.encode(frame)) == brute(rows)
    assert got(codes.encode(frame.limit(0))) == [] and codes.encode(frame.limit(0)).schema.names == codes.encode(frame).schema.names
    assert got(codes.encode(frame.where("vec_id in (2, 3, 5)"))) == []


@pytest.mark.parametrize("entries", [5, 40])
def test_random_vectors(spark, entries):
    rng = random.Random(entries)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(rng.randrange(500), [round(c + rng.choice([0, 0.01, 0.3]) * rng.gauss(0, 1), 2) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for _ in range(400)]
    rows += rows[:20]  # repeated rows
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(codes.encode(frame, entries=entries)) == brute(rows, entries=entries)


def test_ties_and_bounds():
    """Integer grids are full of equal distances; bounds must neither lose a nearer entry nor an equal one of lower index."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (3000, 3))
    entries = rng.integers(-3, 4, (60, 3))
    book, own, bounds, every = codes.Codebook(entries, codes.grouped(entries, 8)), None, None, 0
    for _ in range(6):
        own, best, bounds, taken = codes.assign(x, book, own, bounds)
        d = ((x[:, None] - book.entries) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        moved = book.entries.copy()
        for j in np.unique(own):
            moved[j] = x[own == j].sum(axis=0) // (own == j).sum()
        book, every = codes.Codebook(moved, book.group, book.entries), every + taken


def test_bounds_save_distances(spark):
    """On clustered vectors the later rounds scan few groups."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (64, 16))
    x = np.floor(1024 * (centres[rng.integers(0, 64, 4000)] + rng.normal(0, 0.02, (4000, 16)))).astype(np.int64)
    book, own, bounds, counts = codes.Codebook(x[:256], codes.grouped(x[:256], 16)), None, None, []
    for _ in range(5):
        own, _, bounds, taken = codes.assign(x, book, own, bounds)
        counts.append(taken)
        moved = np.array([x[own == j].sum(axis=0) // max((own == j).sum(), 1) if (own == j).any() else e for j, e in enumerate(book.entries)])
        book = codes.Codebook(moved, book.group, book.entries)
    assert counts[0] == 4000 * 256 and counts[-1] < counts[0] / 3, counts
