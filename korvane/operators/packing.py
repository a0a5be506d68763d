"""Rows in order, packed into chunks of a token budget, whatever the size of a group.

The rule is sequential: a row joins the open chunk of its group if it still fits, else it opens the next one. What a range
of rows makes of the chunk that is open before it depends on that chunk's room only, and only until a row opens another.
So each range partition is summed up in a short table of outcomes, a pass over these tables in the order of the
partitions tells the chunk that each one begins with, and then every partition goes through its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import discard, materialize

#: The bits of monotonically_increasing_id() that tell rows of a partition apart.
ROW_BITS = 33


def next_starts(sizes: np.ndarray, budget: int) -> np.ndarray:
    """For a chunk that opens at row i: the row that opens the next one, ``len(sizes)`` if none does."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return np.maximum(np.searchsorted(sums, sums[:-1] + budget, "right") - 1, np.arange(1, len(sizes) + 1))


def last_starts(sizes: np.ndarray, budget: int) -> np.ndarray:
    """For a chunk that opens at row i: the row that opens the last chunk of all, by pointer doubling."""
    n = len(sizes)
    at = next_starts(sizes, budget)
    at = np.where(at == n, np.arange(n), at)
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def outcomes(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rows of one group do to the chunk that is open before them: (room, start, used), by growing room. If it has
    that room or more, the last chunk afterwards opens at row ``start`` and has so many tokens; where start is -1 it is
    still the same one, with so many more. A room of -1 stands for less than none, in which no row fits."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    taken = np.searchsorted(sums, budget, "right")  # an empty chunk would take one row less
    room, start = sums[:taken], np.append(last_starts(sizes, budget), -1)[:taken]
    most = np.append(room[1:] > room[:-1], True)  # rows without tokens always join
    room, start = np.append(-1, room[most]), np.append(start[0], start[most])
    new = np.append(True, start[1:] != start[:-1])
    room, start = room[new], start[new]
    return room, start, sums[-1] - np.where(start < 0, 0, sums[start])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray, pa.RecordBatch]]:
    """Rows in the order of _at, cut where the partition that they were written from, or the batch, ends."""
    for batch in batches:
        at = batch.column("_at").to_numpy()
        part = at >> ROW_BITS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)] if len(at) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(part[a]), at[a:b], batch.column("_group").slice(a, b - a), batch.column("_size").slice(a, b - a).to_numpy(), batch.slice(a, b - a)


def _segments(groups: pa.Array) -> Iterator[tuple[str, int, int]]:
    """(group, from, to) of runs of equal groups."""
    ids = groups.dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield groups[a].as_py(), a, b


SUMMARY = "part long, first string, last string, one boolean, own_start long, own_used long, room array<long>, start array<long>, used array<long>"


def _summaries(ordered: DataFrame, budget: int) -> DataFrame:
    """One row for each written partition: its first and last group, whether they are one, the last chunk if that group
    begins here, and its ``outcomes`` otherwise."""

    def of(part: int, first: str, last: str, one: bool, begin: int, sizes: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(sizes)
        own = int(last_starts(flat, budget)[0])
        room, start, used = outcomes(flat, budget) if one else (np.zeros(0, np.int64),) * 3
        start = np.where(start < 0, -1, start + begin)
        row = {"part": part, "first": first, "last": last, "one": one, "own_start": begin + own, "own_used": int(flat[own:].sum()), "room": room.tolist(), "start": start.tolist(), "used": used.tolist()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()), ("own_start", pa.int64()), ("own_used", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("room", "start", "used"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = last = None
        sizes: list[np.ndarray] = []
        for part, at, groups, size, _ in _parts(batches):
            if part != now:
                if now is not None:
                    yield of(now, first, last, one, begin, sizes)
                now, first, last, one = part, None, None, True
            for group, a, b in _segments(groups):
                if group != last:
                    one = one and first is None
                    first, last = group if first is None else first, group
                    sizes, begin = [], int(at[a] & ((1 << ROW_BITS) - 1))
                sizes.append(size[a:b])
        if now is not None:
            yield of(now, first, last, one, begin, sizes)

    return ordered.select("_at", "_group", "_size").mapInArrow(run, SUMMARY)


def _carries(summaries: DataFrame, budget: int) -> list[tuple[int, int, int]]:
    """(part, chunk, used): the chunk that is open where a partition begins, and its tokens. The driver sees one summary
    at a time; what it keeps is a row for each partition that begins within a group."""
    out, group, chunk, used = [], None, 0, 0
    for s in summaries.orderBy("part").toLocalIterator():
        base = s.part << ROW_BITS
        if s.first == group:
            out.append((s.part, chunk, used))
        if s.one and s.first == group:
            i = int(np.searchsorted(s.room, max(budget - used, -1), "right")) - 1
            chunk, used = (chunk, used + s.used[i]) if s.start[i] < 0 else (base + s.start[i], s.used[i])
        else:
            group, chunk, used = s.last, base + s.own_start, s.own_used
    return out


def _chunks(ordered: DataFrame, carries: list[tuple[int, int, int]], budget: int) -> DataFrame:
    """``ordered`` with _chunk: the _at of the row that opened the row's chunk."""
    known = {part: (chunk, used) for part, chunk, used in carries}
    sent = ordered.sparkSession.sparkContext.broadcast(known)  # a row for each partition at most
    schema = T.StructType([*ordered.schema.fields, T.StructField("_chunk", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for part, at, groups, size, rows in _parts(batches):
            if part != now:
                now, last = part, None
                chunk, used = sent.value.get(part, (None, 0))
            out = np.zeros(len(at), np.int64)
            for group, a, b in _segments(groups):
                if last is not None and group != last:
                    chunk = None
                last = group
                own, i = size[a:b], 0
                if chunk is not None:
                    sums = used + np.cumsum(own)
                    i = int(np.searchsorted(sums, budget, "right")) if used <= budget else 0
                    out[a : a + i] = chunk
                    used = int(sums[i - 1]) if i else used
                following = next_starts(own, budget)
                while i < b - a:
                    j = int(following[i])
                    out[a + i : a + j] = chunk = int(at[a + i])
                    used, i = int(own[i:j].sum()), j
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def pack(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """``df``, written, with _chunk: rows of a group (equal ``keys``; nulls are a group) in the order of ``order`` are
    packed into chunks of at most ``budget`` by ``size`` (whole numbers, null counts 0). A row of more has a chunk of its
    own. Chunks' numbers grow with the order within a group, and differ between groups.

    Rows are cut into ranges by keys and order, so neither a group nor all rows meet in one task; rows of equal order lie
    in one range, in any order that stays the same. An empty table gives no rows.
    """
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    sized = df.withColumns({"_group": group, "_size": F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))})
    by = ["_group", *[F.col(f"`{c}`") for c in order]]
    ranged = sized.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "pack-rows")
    ordered = ranged.repartition(parts, F.shiftright("_at", ROW_BITS)).sortWithinPartitions("_at")
    carries = _carries(_summaries(ordered, budget), budget)
    out = materialize(_chunks(ordered, carries, budget).drop("_group", "_size", "_at"), "pack-chunks")
    discard(ranged)
    return out
