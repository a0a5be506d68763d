"""Near-duplicates: SimHash fingerprints linked by pigeonhole blocks (op4), sets of word shingles linked by their Jaccard
similarity (the pipeline), components."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, bounded_broadcast, discard, materialize, pieces, release
from .components import connected_components

#: A bucket of more fingerprints than this is compared in pairs of parts, each pair a row group of its own.
BUCKET_PART = 1024
#: Bytes of text that are worked on at a time.
PIECE = 2 << 20
#: Bits of a set's parities.
BITS, MOST_BITS = 1024, 8192
#: Passes in which pairs of sets are verified: only one pass's sets are on disk in shuffles at a time. So many pairs go in
#: one pass.
PASSES, ONE_PASS = 4, 4096
#: The least Jaccard similarity of linked sets of shingles, as a fraction.
SIMILARITY = (4, 5)
#: Shingles that stand HOT times or more in about SAMPLE distinct texts come last in prefixes, HOTTEST of them at most.
#: That only sets the order in which shingles are tried, not which pairs are found.
SAMPLE, HOT, HOTTEST = 20_000, 8, 50_000
#: XXH64's seed, and the lower case of A to Z.
SEED = 42
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles; zero for a text without words."""
    data = LOWER[data]
    words = Words(data, offsets)
    lengths = words.ends - words.starts
    # All words again, one space after each: shingles are slices of it.
    room = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=room[1:])
    spaced = np.full(room[-1], 32, np.uint8)
    put = np.ones(room[-1], bool)
    put[room[1:] - 1] = False
    spaced[put] = data[words.inside]
    view, begin, end = memoryview(spaced.tobytes()), room[:-1], room[1:] - 1
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest, first = xxhash.xxh64_intdigest, words.first_word.tolist()
    for i in range(len(out)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        last = max(a + 1, b - shingle + 1)
        froms, tos = begin[a:last].tolist(), end[min(a + shingle, b) - 1 : b].tolist()
        ones, total = np.zeros(64, np.int64), 0
        for at in range(0, len(froms), 65536):
            h = np.array([digest(view[x:y], SEED) for x, y in zip(froms[at : at + 65536], tos[at : at + 65536])], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        out[i] = np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(docs: DataFrame, keep: list[str], shingle: int = 4) -> DataFrame:
    """The columns ``keep`` with ``fp``: the fingerprint of the whole text as a signed long. Null texts have no words."""
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in keep), T.StructField("fp", T.LongType())])
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "_s_text", PIECE):
            fp = fingerprints_of(data, offsets, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(fp)], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_s_text")).mapInArrow(run, schema)


def blocks_for(n: int, distance: int) -> int:
    """How many blocks to split fingerprints into. Texts at most ``distance`` bits apart agree on all but ``distance``
    blocks; the more blocks, the longer the keys they agree on. Keys get at least 3 bits more than n needs, so that
    unrelated fingerprints seldom meet, at any n."""
    for blocks in range(distance + 1, 17):
        if (blocks - distance) * 64 / blocks >= math.log2(max(n, 2)) + 3:
            return blocks
    return 16


def _masks(blocks: int, distance: int) -> list[int]:
    """A bit mask for each choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what fingerprints at most ``distance`` bits apart connect: from each member of a component to
    the one it was reached from."""
    left = fps.view(np.uint64)
    links = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(left[rest] ^ left[x]) <= distance
            if near.any():
                found = rest[near]
                links += [(int(fps[y]), int(fps[x])) for y in found.tolist()]
                queue += found.tolist()
                rest = rest[~near]
    return links


def near_links(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``, enough to connect all that are at most ``distance`` bits
    apart, each of them checked. Pigeonhole: such a pair agrees on every bit of some choice of blocks.

    Fingerprints meet by the bits of each choice. Buckets of one are dropped before Python sees them. A bucket yields
    the links of a spanning forest, fewer than its members, never all its pairs. A bucket over BUCKET_PART is dealt out
    as pairs of parts to separate groups, so its size bounds no task's memory and no link is lost.
    """
    distinct = distinct.select("fp")
    blocks = blocks or blocks_for(distinct.count(), distance)
    masks = _masks(blocks, distance)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "key"))).where("n > 1")
    parts = F.ceil(F.col("n") / BUCKET_PART)
    own = F.pmod(F.xxhash64("fp"), parts)
    met = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    group = F.struct("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    lists = met.groupBy(group.alias("g")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = set()
            for fps in batch.column(0):
                links.update(forest(fps.values.to_numpy(zero_copy_only=False), distance))
            ab = np.array(sorted(links), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return lists.where(F.size("fps") > 1).select("fps").mapInArrow(run, "a long, b long").distinct()


def roots(marked: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, first_id, root), a written table: the least fingerprint reachable over links from each one of the written
    table ``marked`` (doc_id, fp), and its own smallest doc_id."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    found = connected_components(near_links(distinct, distance)).withColumnRenamed("node", "n_fp")
    rooted = distinct.join(found, F.col("fp") == F.col("n_fp"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return materialize(rooted, "simhash-roots")


def components(marked: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, component_id) for the written table ``marked`` (doc_id, fp): the smallest doc_id reachable over links.

    A component of rows without a doc_id has none itself; null doc_ids take no part in the smallest otherwise.
    """
    rooted = roots(marked, distance)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id of its component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = materialize(fingerprint(docs, ["doc_id"]), "simhash-fp")
    found = components(marked).withColumnRenamed("fp", "c_fp")
    return marked.join(found, F.col("fp") == F.col("c_fp")).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` with _s_row, the whole row, and _s_h1 and _s_h2, a 128-bit key of all columns: rows
    that are equal in every column share it. Columns of ``docs`` may have any names."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cells = [x for c in columns for x in (c.isNull(), c)]
    return docs.select("doc_id", "text", F.struct(*columns).alias("_s_row"), F.xxhash64(*cells).alias("_s_h1"), F.xxhash64(F.lit("second"), *cells).alias("_s_h2"))


def one_of_each(keyed: DataFrame, grouped: DataFrame) -> DataFrame:
    """The whole rows of ``keyed`` (``row_keys``), one of each group, ``grouped`` (doc_id, _s_h1, _s_h2, root): the
    smallest doc_id, null ids last, then the least key. Picks come from partial aggregates; no task sorts a group."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_s_h1", "_s_h2")
    kept = grouped.groupBy("root").agg(F.min(row).alias("r")).select(F.col("r._s_h1").alias("_s_k1"), F.col("r._s_h2").alias("_s_k2"))
    rows = keyed.select("_s_row", "_s_h1", "_s_h2").join(kept, (F.col("_s_h1") == F.col("_s_k1")) & (F.col("_s_h2") == F.col("_s_k2")), "left_semi")
    rows = rows.dropDuplicates(["_s_h1", "_s_h2"])
    return rows.select(*[F.col("_s_row").getField(c).alias(c) for c in keyed.schema["_s_row"].dataType.names])


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; none for a text without words."""
    data = LOWER[data]
    words = Words(data, offsets)
    lengths = words.ends - words.starts
    room = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=room[1:])
    spaced = np.full(room[-1], 32, np.uint8)
    put = np.ones(room[-1], bool)
    put[room[1:] - 1] = False
    spaced[put] = data[words.inside]
    view, begin, end = memoryview(spaced.tobytes()), room[:-1], room[1:] - 1
    digest, first = xxhash.xxh64_intdigest, words.first_word.tolist()
    for a, b in zip(first[:-1], first[1:]):
        last = max(a + 1, b - shingle + 1)
        spans = zip(begin[a:last].tolist(), end[min(a + shingle, b) - 1 : b].tolist()) if b > a else ()
        yield np.unique(np.fromiter((digest(view[x:y], SEED) for x, y in spans), np.uint64)).view(np.int64)


def fingerprint_of_set(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles by their hashes, as a signed long; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        some = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits as longs: whether an odd number of the hashes falls to each. A hash that only one of two sets has flips one
    bit, so the bits of two sets differ in no more places than the sets have hashes of their own.

    There are as many bits as hashes, up to the next power of two, within BITS and MOST_BITS."""
    width = min(max(1 << max(len(hashes) - 1, 0).bit_length(), BITS), MOST_BITS)
    flips = np.bincount((hashes.view(np.uint64) >> np.uint64(13)) % np.uint64(width), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def narrowed(bits: Column, longs: Column) -> Column:
    """Parities as so many longs, or twice as many, as so many: the halves' parities add up."""
    halves = F.zip_with(F.slice(bits, F.lit(1), longs), F.slice(bits, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > longs, halves).otherwise(bits)


def shingle_sets(docs: DataFrame, keep: list[str], shingle: int, hot: dict[int, int] | None = None) -> DataFrame:
    """The columns ``keep`` with sid (a digest of the set of shingles, 0 if it is empty), fp (the set's SimHash), size, bits (``parities``) and
    shingles: all of them, or, if ``hot`` is given, the prefix: of all but the share SIMILARITY, and one more, the rarest
    first.

    The order is by how often ``hot`` has a shingle, then by hash, the same for all texts; so two sets of that similarity
    share a shingle of both prefixes.
    """
    up, down = SIMILARITY
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in keep), T.StructField("sid", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.LongType()))])
    names = schema.names
    sent = None if hot is None else docs.sparkSession.sparkContext.broadcast((np.array(sorted(hot), np.int64), np.array([hot[h] for h in sorted(hot)], np.int64)))

    def prefix(s: np.ndarray) -> np.ndarray:
        known, often = sent.value
        n = len(s) + (-up * len(s)) // down + 1 if len(s) else 0
        rank = np.zeros(len(s), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[at] == s, often[at], 0)
        return s[np.lexsort((s, rank))[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "_s_text", PIECE):
            sets = list(shingles_of(data, offsets, shingle))
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            lists = sets if sent is None else [prefix(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            odd = [parities(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in odd])]).astype(np.int32)
            bits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *odd])))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(sid), pa.array([fingerprint_of_set(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), bits, values], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_s_text")).mapInArrow(run, schema)


def hot_shingles(docs: DataFrame, shingle: int) -> dict[int, int]:
    """How often the most common shingles stand in a sample of distinct texts, drawn by their hash."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct()
    counts = shingle_sets(some, [], shingle).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    return {r.h: r.n for r in counts.orderBy(F.col("n").desc(), "h").limit(HOTTEST).collect()}


def simhash_pairs(sets: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of sids of the written table ``sets`` (sid, fp), enough to connect all whose fingerprints are at most
    ``distance`` bits apart: fingerprints by ``near_links``, and the sets of one fingerprint with the least of them."""
    firsts = materialize(sets.groupBy("fp").agg(F.min("sid").alias("first")), "dedup-fingerprints")
    near = near_links(firsts, distance).withColumnsRenamed({"a": "fa", "b": "fb"})
    one, other = (firsts.select(F.col("fp").alias(f), F.col("first").alias(x)) for f, x in (("fa", "x"), ("fb", "y")))
    met = near.join(one, "fa").join(other, "fb").select("x", "y")
    alike = sets.select("sid", "fp").join(firsts, "fp").where("sid <> first").select(F.col("sid").alias("x"), F.col("first").alias("y"))
    return met.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def same_size(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be of SIMILARITY."""
    up, down = SIMILARITY
    return down * F.least(a, b).cast("long") >= up * F.greatest(a, b).cast("long")


def enough(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of these sizes with so many common shingles have a Jaccard similarity of SIMILARITY or more."""
    up, down = SIMILARITY
    return (up + down) * common.cast("long") >= up * (a.cast("long") + b.cast("long"))


def may_reach(differing: Column, a: Column, b: Column) -> Column:
    """Whether sets of these sizes whose parities differ in so many bits can be of SIMILARITY: at least as many hashes
    belong to one set only."""
    return enough(F.floor((a + b - differing) / 2), a, b)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of SIMILARITY or more, in written tables. Pairs
    whose parities rule that out go first; the sets of the others come from one row of each and are shuffled by pair. As
    few queries run as the pairs need: none beyond the first without any."""
    one = sets.select(F.col("sid").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("x"))
    other = sets.select(F.col("sid").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("y"))
    longs = F.least(F.size("x"), F.size("y"))  # sizes within SIMILARITY have as many bits or twice as many
    differing = F.aggregate(F.zip_with(narrowed(F.col("x"), longs), narrowed(F.col("y"), longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    pairs = materialize(pairs.join(one, "a").join(other, "b").where(same_size(F.col("sa"), F.col("sb")) & may_reach(differing, F.col("sa"), F.col("sb"))).select("a", "b"), "dedup-pairs")
    n = pairs.count()
    if not n:
        return pairs
    ids = pairs.select(F.col("a").alias("i")).unionByName(pairs.select(F.col("b").alias("i"))).distinct()
    wanted = materialize(sets.join(ids, F.col("sid") == F.col("i"), "left_semi").select(F.col("h1").alias("_s_k1"), F.col("h2").alias("_s_k2")), "dedup-wanted")
    rows = docs.join(bounded_broadcast(wanted), (F.col("_s_h1") == F.col("_s_k1")) & (F.col("_s_h2") == F.col("_s_k2")), "left_semi").select("_s_h1", "_s_h2", "text")
    rows = rows.dropDuplicates(["_s_h1", "_s_h2"])  # rows that are equal in all columns
    full = materialize(shingle_sets(rows, [], shingle).select("sid", "shingles"), "dedup-sets")
    links, passes = None, 1 if n <= ONE_PASS else PASSES
    for k in range(passes):
        of_pass = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == k  # noqa: B023, E731
        left = pairs.where(of_pass("a")).join(full.where(of_pass("sid")).select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
        both = left.join(full.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
        found = materialize(both.where(enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "dedup-links")
        links = found if links is None else links.unionByName(found)
    discard(pairs, wanted, full)
    return links


def merged_keys(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (sid, size, pos, key) under keys of two sets or more, with keys that the same sets share as
    one: (sid, size, key, pos, w, least), the last of the set's places under them, how many they are and their least set
    (sid, size).

    Copies share long runs of shingles, so without that each pair would come up once for every shingle. A key is known
    by the 128 bits of its sets' digests.
    """
    own = Window.partitionBy("key")
    shared = keyed.withColumns({"n": F.count(F.lit(1)).over(own), "least": F.min(F.struct("sid", "size")).over(own), "x1": F.bit_xor(F.xxhash64("sid")).over(own), "x2": F.bit_xor(F.xxhash64(F.lit("second"), "sid")).over(own)})
    one = shared.where("n > 1").groupBy("x1", "x2", "sid").agg(F.first("size").alias("size"), F.max("pos").alias("pos"), F.count(F.lit(1)).alias("w"), F.first("least").alias("least"))
    return one.select("sid", "size", F.struct("x1", "x2").alias("key"), "pos", "w", "least")


def mixed(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (``merged_keys``) under keys that stand in more than one component of ``links``, a written
    table with the set's root and its key's number of rows, n."""
    near = materialize(connected_components(links), "dedup-near")
    placed = keyed.select("sid", "size", "pos", "w", "key").join(near, F.col("sid") == F.col("node"), "left").select("sid", "size", "pos", "w", "key", F.coalesce("root", "sid").alias("root"))
    own = Window.partitionBy("key")
    placed = placed.withColumns({"n": F.count(F.lit(1)).over(own), "lo": F.min("root").over(own), "hi": F.max("root").over(own)})
    out = materialize(placed.where("lo <> hi").drop("lo", "hi"), "dedup-mixed")
    discard(near)
    release(links.sparkSession)
    return out


def near_pairs(keyed: DataFrame, sets: DataFrame, trees: bool) -> DataFrame:
    """(a, b, sa, sb, pa, pb, w) of ``mixed`` rows that share a key, have different roots and can be of SIMILARITY by
    their sizes and their parities: sids, sizes, places and the key's weight, once for each key.

    With ``trees``, only pairs that parities estimate to be of SIMILARITY, and of a key's pairs a forest over its roots,
    likeliest pairs first: fewer than the key has rows. A key's rows over BUCKET_PART are dealt out as pairs of parts to
    separate groups."""
    up, down = SIMILARITY
    parts = F.ceil(F.col("n") / BUCKET_PART)
    bits = sets.select(F.col("sid").alias("b_sid"), "bits")
    met = keyed.join(bits, F.col("sid") == F.col("b_sid"))
    met = met.withColumn("own", F.pmod(F.xxhash64("sid"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    group = F.struct("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    lists = met.groupBy(group.alias("g")).agg(F.collect_list(F.struct("sid", "size", "pos", "root", "own", "w", "bits")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                sid, size, pos, root, own, w = (rows.values.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                if len(sid) < 2:
                    continue
                bits = rows.values.field(6)
                flat, ends = bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(bits.value_lengths().to_numpy())
                longs = np.diff(ends, prepend=0)
                wide = size.astype(np.int64)
                tree = np.unique(root, return_inverse=True)[1]
                for width in np.unique(longs):  # pairs whose shorter bits are so many, the longer ones narrowed
                    rows_of = lambda k: flat[(ends - longs)[k][:, None] + np.arange(longs[k[0]])] if len(k) else np.zeros((0, 2 * width), np.uint64)  # noqa: B023, E731
                    same, twice = np.flatnonzero(longs == width), np.flatnonzero(longs == 2 * width)
                    long = rows_of(twice)
                    parity = np.concatenate([rows_of(same), long[:, :width] ^ long[:, width:]])
                    met = np.concatenate([same, twice])
                    for at in range(0, len(same), 256):  # a few rows against all
                        here = met[at : min(at + 256, len(same))]
                        ok = (tree[here, None] != tree[met]) & ((sid[here, None] < sid[met]) | (np.arange(len(met)) >= len(same)))
                        ok &= down * np.minimum(wide[here, None], wide[met]) >= up * np.maximum(wide[here, None], wide[met])
                        if group["p"] != group["q"]:
                            ok &= own[here, None] != own[met]
                        x, y = np.nonzero(ok)
                        x += at
                        step = 65536 * BITS // 64 // int(width)
                        for a in range(0, len(x), step):
                            i, j = met[x[a : a + step]], met[y[a : a + step]]
                            both = wide[i] + wide[j]
                            differing = np.bitwise_count(parity[x[a : a + step]] ^ parity[y[a : a + step]]).sum(axis=1, dtype=np.int64)
                            if trees:
                                picked = forest_of(i, j, unshared(differing, int(width) * 64) / both, tree)
                            else:
                                picked = np.flatnonzero((up + down) * ((both - differing) // 2) >= up * both)
                            i, j = i[picked], j[picked]
                            i, j = np.where(sid[i] < sid[j], i, j), np.where(sid[i] < sid[j], j, i)
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (sid[i], sid[j], size[i], size[j], pos[i], pos[j], w[i])], names=["a", "b", "sa", "sb", "pa", "pb", "w"])

    return lists.select(F.struct("g.p", "g.q").alias("g"), "rows").mapInArrow(run, "a long, b long, sa int, sb int, pa int, pb int, w long")


def unshared(differing: np.ndarray, bits: int) -> np.ndarray:
    """How many hashes are expected to belong to one of two sets only, if so many of their parities of ``bits`` differ."""
    return -bits / 2 * np.log(1 - np.minimum(2 * differing, bits - 1) / bits)


def forest_of(i: np.ndarray, j: np.ndarray, distance: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The pairs (i, j), closest first, that join different trees, of those whose ``distance`` (the share of unshared
    hashes) stays within SIMILARITY. ``tree`` is each row's tree and is brought up to date."""
    up, down = SIMILARITY
    order = np.argsort(distance, kind="stable")
    order = order[distance[order] <= (down - up) / (down + up)]
    picked = []
    while len(order):
        order = order[tree[i[order]] != tree[j[order]]]
        if len(order):
            a, b = tree[i[order[0]]], tree[j[order[0]]]
            picked.append(order[0])
            tree[tree == b] = a
    return np.array(picked, np.int64)


def across(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), each once, of ``mixed`` rows that share a key, have different roots and can be of SIMILARITY by
    their sizes, their parities and by how many keys they share up to which places."""
    pairs = near_pairs(keyed, sets, trees=False).groupBy("a", "b").agg(F.sum("w").alias("n"), *[F.max(c).alias(c) for c in ("sa", "sb", "pa", "pb")])
    # Beyond the last common place of the prefixes, no more can be common than what follows in the shorter rest.
    return pairs.where(enough(F.col("n") + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")), F.col("sa"), F.col("sb"))).select("a", "b")


def similar_roots(docs: DataFrame, marked: DataFrame, shingle: int) -> DataFrame:
    """(sid, root) of every set that is linked to another one, for the written table ``marked`` (row keys, sid, size,
    bits, shingles: prefixes), which goes: links are all pairs of SIMILARITY or more, as far as they change components.

    Equal sets are one. First sets meet whose fingerprints are near (``simhash_pairs``). Fingerprints miss pairs at this
    similarity, and prefixes find the rest: each set meets one other, the least of those it shares a key of its prefix with. Under
    keys that then still stand in several components, these meet by a forest of the pairs that parities call similar; at
    last, under keys that stand in several components even so, all pairs from different components meet.
    """
    row = F.struct("_s_h1", "_s_h2")
    whole = marked.where("size > 0").groupBy("sid").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("shingles").alias("shingles"), F.min(row).alias("row"))
    whole = materialize(whole.select("sid", "fp", "size", "bits", "shingles", F.col("row._s_h1").alias("h1"), F.col("row._s_h2").alias("h2")), "dedup-distinct")
    sets = materialize(whole.select("sid", "fp", "size", "bits", "h1", "h2"), "dedup-names")
    discard(marked)
    keyed = whole.select("sid", "size", F.posexplode("shingles").alias("pos", "key")).withColumn("pos", F.col("pos") + 1)
    shared = materialize(merged_keys(keyed), "dedup-keys")
    discard(whole)
    release(docs.sparkSession)
    stars = shared.where((F.col("sid") != F.col("least.sid")) & same_size(F.col("size"), F.col("least.size"))).groupBy(F.col("sid").alias("a")).agg(F.min("least.sid").alias("b"))
    links = verified(simhash_pairs(sets).unionByName(stars).distinct(), docs, sets, shingle)
    left = mixed(shared, links)
    discard(shared)
    if not left.isEmpty():
        trees = near_pairs(left, sets, trees=True).select("a", "b").distinct()
        links = links.unionByName(verified(trees, docs, sets, shingle))
        rest = mixed(left, links)
        if not rest.isEmpty():
            links = links.unionByName(verified(across(rest, sets), docs, sets, shingle))
        discard(rest)
    out = materialize(connected_components(links), "dedup-roots")
    discard(left, sets)
    return out


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each component, whatever its doc_ids are: the row with the smallest doc_id (null
    ids last), of rows that share it the one with the least key. All columns are kept.

    Linked are all pairs of texts whose sets of ``shingle`` words have a Jaccard similarity of SIMILARITY or more. Texts
    without words are one group, which nothing else joins. Rows equal in every column are one. Texts are whole, however
    long, one at a time; an empty table stays empty; columns keep their names and values, whatever they are called."""
    keyed = row_keys(docs)
    marked = materialize(shingle_sets(keyed, ["doc_id", "_s_h1", "_s_h2"], shingle, hot_shingles(docs, shingle)), "dedup-marked")
    rows = materialize(marked.select("doc_id", "_s_h1", "_s_h2", "sid"), "dedup-rows")
    near = similar_roots(keyed, marked, shingle)
    rows = rows.join(near, F.col("sid") == F.col("node"), "left")
    return one_of_each(keyed, rows.withColumn("root", F.coalesce("root", "sid")))
