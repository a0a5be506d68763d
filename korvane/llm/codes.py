"""Vector compression by product codes: each part of a vector becomes the number of its nearest codebook entry.

Codebooks come from Lloyd's rounds with Yinyang bounds. A part's entries are clustered into groups once; every vector
carries, for each group, a lower bound of its distance to the group's entries (its own aside). When entries move, a bound
falls by the group's largest drift, and only groups whose bound no longer exceeds the exact distance to the vector's own
entry are scanned again. Components are integers, so scanned distances are exact and ties go to the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_broadcast, discard, materialize
from .topk import matrix, scaled, valid

#: Parts of a vector, entries of a codebook, rounds of assignment and update, and groups of a codebook.
PARTS, ENTRIES, ROUNDS, GROUPS = 4, 256, 4, 16
#: Components are this often the floating-point ones, rounded down.
SCALE = 1024
#: Vectors that are worked on at a time.
CHUNK = 8192
FAR = np.iinfo(np.int32).max
#: Slots of a part in the table of sums.
SLOTS = 1 << 15


def component_limit(width: int) -> int:
    """Components beyond this size are set to it, so that squared distances over a whole vector stay below 2**62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def part_width(dimensions: int, parts: int) -> int:
    return max(-(-dimensions // parts), 1)


def cut(lists: pa.Array, parts: int, width: int) -> np.ndarray:
    """Integer vectors as (vector, part, component), shorter ones filled up with zeros."""
    whole, limit = matrix(lists, parts * width), component_limit(parts * width)
    return np.clip(whole, -limit, limit).reshape(len(whole), parts, width)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries: in floating point where all terms stay below 2**53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    return np.stack([own_squared(x, e) for e in entries], axis=1)


def own_squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to its own entry (or to the only one)."""
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def grouped(entries: np.ndarray, n_groups: int) -> np.ndarray:
    """Each entry's group, by a few rounds of k-means over the entries themselves. It only shapes the bounds."""
    n_groups = min(n_groups, len(entries))
    centres = entries[np.linspace(0, len(entries) - 1, n_groups).astype(int)].astype(np.float64)
    for _ in range(5):
        group = ((entries[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(group):
            centres[g] = entries[group == g].mean(axis=0)
    return group


class Codebook:
    """One part's entries, their groups, and how far each group has moved at most since the last round."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max(initial=-1) + 1)]
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(axis=1))
        #: Rounded up, so that bounds stay bounds.
        self.drift = np.array([math.ceil(moved[m].max(initial=0) + 1e-3) if before is not None else 0 for m in self.members], np.int64)


def assign(x: np.ndarray, book: Codebook, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (the lower index of equals), its exact squared distance, the new bounds, and how many
    distances were taken.

    ``own`` and ``bounds`` are those of the last round (None in the first): bounds[i, g] is a whole number not above row
    i's distance to any entry of group g but its own.
    """
    n, taken = len(x), 0
    if own is None:
        own, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        bounds, scan = np.zeros((n, len(book.members)), np.int64), np.ones((n, len(book.members)), bool)
        before = None
    else:
        before = own
        best, taken = own_squared(x, book.entries[own]), n
        bounds = np.maximum(bounds.astype(np.int64) - book.drift, 0)
        scan = bounds * bounds <= best[:, None]  # at equality an entry of a lower index may be as near
    to_before = best.copy()
    nearest = np.full((n, len(book.members)), FAR, np.int64)  # of scanned groups: nearest distance, nearest entry, next distance
    entry, following = np.zeros((n, len(book.members)), np.int64), np.full((n, len(book.members)), FAR, np.int64)
    for g, members in enumerate(book.members):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows) or not len(members):
            continue
        d = squared(x[rows], book.entries[members])
        taken += d.size
        low = d.argmin(axis=1)  # the first of equals, and members ascend
        at = np.arange(len(rows))
        first = d[at, low]
        entry[rows, g] = members[low]
        d[at, low] = np.iinfo(np.int64).max
        following[rows, g] = floor_root(d.min(axis=1))
        nearest[rows, g] = floor_root(first)
        closer = (first < best[rows]) | (first == best[rows]) & (members[low] < own[rows])
        own = own.copy() if own is before else own
        best[rows[closer]], own[rows[closer]] = first[closer], members[low][closer]
    bounds = np.where(scan, np.where(entry == own[:, None], following, nearest), bounds)
    if before is not None:  # a row's former entry counts for its group again
        left = np.flatnonzero(before != own)
        g = book.group[before[left]]
        bounds[left, g] = np.minimum(bounds[left, g], floor_root(to_before[left]))
    return own, best, np.minimum(bounds, FAR), taken


def floor_root(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not above the square roots."""
    return np.maximum(np.sqrt(squares.astype(np.float64)) * (1 - 1e-12), 0).astype(np.int64)


def assigned(table: DataFrame, books: list[Codebook], keep: list[str], width: int, first: bool) -> DataFrame:
    """One pass: ``keep``, x, own, bounds and error of each vector (kind 0), and of each task the sums that the next
    codebooks are made from, a row for each part and entry in use (kind 1: slot, n, sums). Kind 2 rows count distances."""
    parts = len(books)
    kept = [table.schema[c] for c in keep]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("kind", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("own", T.ArrayType(T.ShortType())), T.StructField("bounds", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", longs)])
    groups = [len(b.members) for b in books]

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        n, m = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(values.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b.entries), width), np.int64) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        empty, taken = None, 0
        for batch in batches:
            empty = [pa.nulls(0, c.type) for c in batch.columns[: len(keep)]]
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                x = cut(some.column(len(keep)), parts, width)
                n = len(x)
                old = None if first else matrix(some.column(len(keep) + 1), parts)
                low = None if first else matrix(some.column(len(keep) + 2), sum(groups))
                own, error, bounds, begin = np.zeros((n, parts), np.int64), np.zeros(n, np.int64), [], 0
                for p, book in enumerate(books):
                    here = None if first else low[:, begin : begin + groups[p]]
                    own[:, p], best, new, more = assign(x[:, p], book, None if first else old[:, p], here)
                    begin, taken = begin + groups[p], taken + more
                    error += best
                    bounds.append(new)
                    np.add.at(sums[p], own[:, p], x[:, p])
                    counts[p] += np.bincount(own[:, p], minlength=len(counts[p]))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(keep)], pa.array(np.zeros(n, np.int32)), lists(x.reshape(n, -1), pa.int32()), lists(own, pa.int16()), lists(np.concatenate(bounds, axis=1), pa.int32()), pa.array(error), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                    names=schema.names,
                )
        if empty is None:
            return
        slots = [(p * SLOTS + int(e), int(counts[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(counts[p])]
        n = len(slots) + 1
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, c.type) for c in empty), pa.array([1] * len(slots) + [2], pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int16())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64()), pa.array([s[0] for s in slots] + [None], pa.int32()), pa.array([s[1] for s in slots] + [taken], pa.int64()), pa.array([s[2] for s in slots] + [None], pa.list_(pa.int64()))],
            names=schema.names,
        )

    return table.select(*[F.col(f"`{c}`") for c in keep], *(["x"] if first else ["x", "own", "bounds"])).mapInArrow(run, schema)


def updated(books: list[Codebook], table: DataFrame, width: int) -> list[Codebook]:
    """New codebooks from the sums in ``table``: PARTS x ENTRIES rows at most come to the driver, whatever the number of
    vectors. Entries that no vector uses stay."""
    total = table.where("kind = 1").groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    entries = [b.entries.copy() for b in books]
    for r in total.collect():
        entries[r.slot // SLOTS][r.slot % SLOTS] = [int(s) // r.n for s in r.sums]
    return [Codebook(e, b.group, b.entries) for e, b in zip(entries, books)]


def text_digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components as decimal text, by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[list[Codebook], DataFrame | None]:
    """The codebooks of ``vectors`` (vec_id, label, embedding), and the written table of the last assignment: vec_id,
    label, own (an entry's index for each part) and error (squared distances summed over parts). None without a vector."""
    kept = vectors.where(valid(F.col("embedding"))).select("vec_id", "label", scaled(F.col("embedding"), SCALE).alias("x"))
    widest = kept.agg(F.max(F.size("x"))).first()[0]
    if not widest:  # no vectors, or only such of no components
        return [], None
    width = part_width(widest, parts)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column(0).combine_chunks()
    first = cut(start, parts, width)
    books = [Codebook(first[:, p], grouped(first[:, p], groups)) for p in range(parts)]
    table = materialize(assigned(kept, books, ["vec_id", "label"], width, True), "codes-round")
    for _ in range(rounds):
        books = updated(books, table, width)
        before, table = table, materialize(assigned(table.where("kind = 0"), books, ["vec_id", "label"], width, False), "codes-round")
        discard(before)
    return books, table


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label, label_error and codebooks_sha256 of each vector with finite components only.

    Codebooks start as the parts of the ``entries`` smallest vec_ids (null ids last, ties by the vectors); with fewer
    vectors they are as short. A null vector or one with a null, NaN or infinite component is left out and takes no part
    in anything. Vectors of other lengths are filled up with zeros to the longest, whose length is rounded up to whole
    parts. Components beyond ``component_limit`` are set to it. Repeated rows are coded alike and come out as often as they
    come in. label_error sums the errors of equal labels, nulls as one label (null if it exceeds a long). An empty table,
    or one of vectors without components, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    books, table = train(vectors, parts, entries, rounds)
    if table is None:
        none = vectors.where(F.lit(False))
        return none.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    done = table.where("kind = 0")
    by_label = materialize(done.groupBy(F.col("label").alias("l_label")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    hexed = F.concat_ws("", F.transform("own", lambda v: F.lower(F.lpad(F.hex(v.cast("long")), 2, "0"))))
    joined = done.join(bounded_broadcast(by_label), F.col("label").eqNullSafe(F.col("l_label")))
    return joined.select("vec_id", hexed.alias("code"), "error", "label", "label_error", F.lit(text_digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and error of every vector."""
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _oracle() -> str:
    lines = [
        f"k as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::double)) as x from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        f"x as materialized (select r, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] as x from k, (select unnest(range({PARTS})) as p))",
        f"c0 as materialized (select p, r - 1 as e, x as c from x where r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        lines.append(
            f"a{i} as materialized (select r, p, m % 1024 as e, m // 1024 as d from (select r, p, min(cast(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) as bigint) * 1024 + e) as m from x join c{i} using (p) group by r, p))"
        )
        if i < ROUNDS:
            lines.append(
                f"c{i + 1} as materialized (select p, e, coalesce(n.c, c{i}.c) as c from c{i} left join (select p, e, list(v order by j) as c from (select p, e, j, floor(sum(v) / count(*)) as v"
                f" from (select p, e, unnest(x) as v, unnest(range(len(x))) as j from a{i} join x using (r, p)) group by p, e, j) group by p, e) n using (p, e))"
            )
    return f"""
with {", ".join(lines)},
h as (select sha256(string_agg(cast(cast(v as bigint) as varchar), ',' order by p, e, j)) as codebooks_sha256 from (select p, e, unnest(c) as v, unnest(range(len(c))) as j from c{ROUNDS})),
o as (select r, string_agg(lower(printf('%02x', e)), '' order by p) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join o using (r), h
"""


ORACLE = _oracle()
