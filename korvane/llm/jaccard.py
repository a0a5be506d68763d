"""Similarity join of documents by the Jaccard similarity of their sets of word shingles: a blocked sparse matrix product.

The incidence matrix has a row for each set and a column for each shingle; its product with its own transpose holds the
overlaps of all pairs. Sizes bound what is needed of it: a set links only where at least the threshold's share of its own
shingles is common.

1. A first block of columns (a quarter of the shingles, by hash) drops the sets too many of whose shingles nobody else
   has. Most sets go here, without a pair being formed.
2. The remaining rows get all their columns, which drop more sets in the same way. Columns with the same sets become one with a weight, which leaves the
   product as it is; a set whose common weight stays below its bound goes.
3. Columns are ordered, the rarest first. A pair's first common column lies where each set's weight from there on still
   reaches its bound, so only those entries, the heads, bring sets together.
4. Each set is multiplied with one partner of its heads, the one with most weight there. Where that leaves sets of several
   components under a head, their whole rows are multiplied in blocks, and a block yields the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, binary_array, bounded_broadcast, discard, materialize, pieces
from .components import connected_components
from .simhash import LOWER, SEED

#: Two sets link if their common part is at least LINK[0] / LINK[1] of all that either has.
LINK = (85, 100)
#: One shingle in so many, by hash, is in the first block of columns.
FIRST_BLOCK = 4
#: Bytes of a column's hash by which sets that stand alone in it are found; columns that these bytes mix up count as shared.
KEY = 5
#: Columns of a batch of sets that are sent at a time, and the most sets of it.
SENT, SENT_ROWS = 1 << 20, (1 << 16) - 1
#: In place of a set's place in its batch: several sets of the batch stand in the column.
SEVERAL = (1 << 16) - 1
#: Rows of a block of the product; more sets under one column are dealt out as pairs of parts.
ROWS = 512
#: Columns of the product that are multiplied at a time.
COLUMNS = 2048
#: Bytes of text that are worked on at a time.
PIECE = 2 << 20


def needed(size: Column, link: tuple[int, int] = LINK) -> Column:
    """The least overlap of a set of that size with any set that it links with: its union has at least ``size``."""
    return F.ceil(size * link[0] / F.lit(link[1]).cast("decimal(9,0)")).cast("long")


def linked(overlap: Column, a: Column, b: Column, link: tuple[int, int] = LINK) -> Column:
    """Whether sets of sizes a and b with that overlap link."""
    return link[1] * overlap >= link[0] * (a + b - overlap)


def sizes_fit(a: Column, b: Column, link: tuple[int, int] = LINK) -> Column:
    return link[1] * F.least(a, b) >= link[0] * F.greatest(a, b)


def text_key(text: Column) -> dict[str, Column]:
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("second"), text)}


def stirred(h: np.ndarray) -> np.ndarray:
    """64-bit hashes stirred so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_rows(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, all in a row, and where each text's begin. Every distinct
    word is hashed once; a shingle's hash comes from those of its words in order and from their number."""
    data = LOWER[data]
    words = Words(data, offsets)
    codes = words.array(data).dictionary_encode()
    of_word = np.array([xxhash.xxh64_intdigest(w, SEED) for w in codes.dictionary.to_pylist()], np.uint64)
    h = of_word[codes.indices.to_numpy()] if len(of_word) else np.zeros(0, np.uint64)
    n_words, n_texts = np.diff(words.first_word), len(offsets) - 1
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))  # shingles of each text, repeats too
    doc = np.repeat(np.arange(n_texts), n)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + words.first_word[:-1][doc]
    length = np.minimum(n_words, shingle)[doc]
    out = stirred(length.astype(np.uint64))
    for k in range(shingle):
        inside = length > k
        out[inside] = stirred(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[begin[inside] + k])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.append(True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1]))[: len(out)]
    return out[new].view(np.int64), np.searchsorted(doc[new], np.arange(n_texts + 1))


def incidence(docs: DataFrame, keep: list[str], shingle: int, part: int = 1) -> DataFrame:
    """The columns ``keep`` of ``docs`` with s1 and s2 (128 bits that name the set; equal sets share them), size, and
    grams: the set's shingles as 64-bit hashes, or the keys (KEY bytes each) of those in the first of ``part`` blocks."""
    grams_type = T.BinaryType() if part > 1 else T.ArrayType(T.LongType())
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *(T.StructField(c, T.LongType()) for c in ("s1", "s2", "size")), T.StructField("grams", grams_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in pieces(batches, "_j_text", PIECE):
            grams, at = shingle_rows(data, offsets, shingle)
            names = np.array([np.frombuffer(xxhash.xxh3_128_digest(grams[a:b].tobytes(), SEED), np.int64) for a, b in zip(at[:-1], at[1:])]).reshape(-1, 2)
            sizes = pa.array(np.diff(at))
            if part > 1:
                chosen = grams.view(np.uint64) % np.uint64(part) == 0
                at = np.append(0, np.cumsum(chosen))[at]
                lists = binary_array(packed(keys_of(grams[chosen])), np.diff(at) * KEY)
            else:
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams))
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(keep))), pa.array(names[:, 0]), pa.array(names[:, 1]), sizes, lists], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_j_text")).mapInArrow(run, schema)


def keys_of(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.uint64) >> np.uint64(64 - 8 * KEY)


def packed(keys: np.ndarray) -> np.ndarray:
    """The bytes of keys, KEY each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].ravel()


def unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = data.reshape(-1, KEY)
    return out.view("<u8").ravel()


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and the length of each value."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64)


def set_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the columns that each set of ``grams`` stands in, in a row, and where each set's begin."""
    if pa.types.is_binary(column.type):
        data, lengths = column_bytes(column)
        return unpacked(data), np.append(0, np.cumsum(lengths // KEY))
    return keys_of(column.flatten().to_numpy()), np.append(0, np.cumsum(pa.compute.list_value_length(column).to_numpy()))


def sent_columns(rows: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, keys, who): what batches of the sets ``rows`` (id, s1, grams) send to each bucket of columns. A
    column costs a batch KEY + 2 bytes: its key, and the place in the batch (id - batch) of the one set in it, or SEVERAL."""

    def send(ids: np.ndarray, s1: np.ndarray, keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        _, first, which = np.unique(s1, return_index=True, return_inverse=True)
        once = first[which] == np.arange(n)  # the first of equal sets
        who = np.repeat(np.arange(n), np.diff(at))
        keys, who = keys[once[who]], who[once[who]]
        dealt = (keys % np.uint64(buckets) << np.uint64(8 * KEY)) | keys
        order = np.argsort(dealt)
        dealt, who = dealt[order], who[order]
        begin = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])[: len(dealt)])
        if len(begin):
            lo, hi = np.minimum.reduceat(who, begin), np.maximum.reduceat(who, begin)
            who = np.where(lo == hi, lo, SEVERAL)
        dealt = dealt[begin]
        some, length = np.unique(dealt >> np.uint64(8 * KEY), return_counts=True)
        columns = [pa.array(np.full(len(some), ids[0])), pa.array(some.astype(np.int64)), binary_array(packed(dealt), length * KEY), binary_array(who.astype("<u2").view(np.uint8), length * 2)]
        return pa.RecordBatch.from_arrays(columns, names=["batch", "bucket", "keys", "who"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, s1 = (batch.column(i).to_numpy() for i in (0, 1))
            keys, at = set_keys(batch.column(2))
            breaks = [*(np.flatnonzero(np.diff(ids) != 1) + 1), len(ids)]  # a set is found by its batch's first id
            a = 0
            while a < len(ids):
                fits = int(np.searchsorted(at, at[a] + SENT, "right")) - 1
                b = min(max(fits, a + 1), a + SENT_ROWS, breaks[int(np.searchsorted(breaks, a, "right"))])
                yield send(ids[a:b], s1[a:b], keys[at[a] : at[b]], at[a : b + 1] - at[a])
                a = b

    return rows.select("id", "s1", "grams").mapInArrow(run, "batch long, bucket long, keys binary, who binary")


def alone(rows: DataFrame, columns: int) -> DataFrame:
    """(a_id, counts) for the first set of each name in each batch of the sets ``rows`` (id, s1, grams; ids in a row in the
    order of the table), which stand in about so many ``columns`` in all. counts[n] is how many of its columns n batches
    sent, each for one set only; so those with n = the number of batches that hold the set are its own alone.

    Sets and columns meet by buckets of columns, then by batches. Each column costs some bytes, whatever the number of
    sets, buckets and partitions; a frequent one costs a batch no more than another.
    """
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), columns // SENT + 1)

    def counted(table: pa.Table) -> pa.Table:
        data, length = column_bytes(table["keys"])
        keys, who = unpacked(data), column_bytes(table["who"])[0].view("<u2")
        row = np.repeat(np.arange(len(length)), length // KEY)
        order = np.argsort(keys)
        of = np.zeros(len(keys), np.int64)
        of[order] = np.cumsum(np.append(True, np.diff(keys[order]) != 0)[: len(keys)]) - 1
        n = np.bincount(of)
        n[of[who == SEVERAL]] = 0
        n = np.where(n < 256, n, 0)[of]  # a set in more batches is taken for one without columns of its own
        row, who, n = row[n > 0], who[n > 0], n[n > 0]
        each = np.bincount(row, minlength=len(length))
        columns = [table["batch"].combine_chunks(), binary_array(who.view(np.uint8), each * 2), binary_array(n.astype(np.uint8), each)]
        return pa.table(columns, names=["batch", "who", "n"])

    def returned(table: pa.Table) -> pa.Table:
        who, n = column_bytes(table["who"])[0].view("<u2"), column_bytes(table["n"])[0]
        pair, count = np.unique(who.astype(np.int64) * 256 + n, return_counts=True)
        places, at = np.unique(pair // 256, return_index=True)
        width = np.append(at[1:], len(pair))[: len(at)] - 1
        begin = np.append(0, np.cumsum(pair[width] % 256 + 1))  # counts end with the largest n
        counts = np.zeros(begin[-1], np.int32)
        counts[np.repeat(begin[:-1], np.diff(np.append(at, len(pair)))) + pair % 256] = count
        ids = table["batch"][0].as_py() + places
        return pa.table([pa.array(ids), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(counts))], names=["a_id", "counts"])

    met = sent_columns(rows, buckets).groupBy("bucket").applyInArrow(counted, "batch long, who binary, n binary")
    return met.groupBy("batch").applyInArrow(returned, "a_id long, counts array<int>")


def common_sets(rows: DataFrame, columns: int, link: tuple[int, int], *more: Column) -> DataFrame:
    """(s1, s2, size, *more), ``more`` aggregated over its rows, of the sets of ``rows`` (id, s1, s2, size, grams) of which
    not too many shingles stand in that set alone."""
    told = rows.drop("grams").join(alone(rows, columns), F.col("id") == F.col("a_id"), "left")
    sets = told.where("size > 0").groupBy("s1", "s2").agg(F.first("size").alias("size"), F.count("counts").alias("held"), F.first("counts", True).alias("counts"), *more)
    own = F.coalesce(F.get("counts", F.col("held").cast("int")), F.lit(0))
    return sets.where(F.col("size") - own >= needed(F.col("size"), link)).drop("held", "counts")


def candidates(marked: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(s1, s2, row), written, of the sets of ``marked`` that the first block of columns leaves: not more of a set's
    shingles stand in that set alone than it can do without. ``row`` names the row with its smallest doc_id."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    columns = (marked.agg(F.sum("size")).first()[0] or 0) // FIRST_BLOCK
    return materialize(common_sets(marked, columns, link, F.min(row).alias("row")).select("s1", "s2", "row"), "jaccard-chosen")


def full_rows(docs: DataFrame, chosen: DataFrame, shingle: int, link: tuple[int, int]) -> DataFrame:
    """(id, s1, s2, size, grams), written, of those of the sets ``chosen`` that all their columns leave: their texts are
    read again, one row of each, and get a number."""
    wanted = chosen.select(F.col("row.doc_id").alias("w_id"), F.col("row.t1").alias("w1"), F.col("row.t2").alias("w2"))
    texts = docs.select("doc_id", "text", *[c.alias(k) for k, c in text_key(F.col("text")).items()])
    texts = texts.join(bounded_broadcast(wanted), (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    rows = materialize(incidence(texts, [], shingle).withColumn("id", F.monotonically_increasing_id()), "jaccard-rows")
    columns = rows.agg(F.sum("size")).first()[0] or 0
    kept = common_sets(rows, columns, link, F.min("id").alias("k_id")).select("k_id")  # one of the rows repeated with one doc_id
    kept = materialize(kept, "jaccard-kept")
    out = materialize(rows.join(bounded_broadcast(kept), F.col("id") == F.col("k_id"), "left_semi"), "jaccard-rows")
    discard(rows, kept)
    return out


def merged_columns(rows: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The entries (id, size, x1, x2, n, w, rest) of the product: columns that the same n sets share are one column, named
    by 128 bits of these sets, of weight w. ``rest`` is the set's weight from this column on, the rarest columns first.
    Only columns of two sets or more and sets that can reach their bound are left."""
    entries = rows.select("id", "size", F.explode("grams").alias("gram"))
    columns = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("x2")).where("n > 1")
    merged = entries.join(columns.withColumnRenamed("gram", "c_gram"), F.col("gram") == F.col("c_gram")).groupBy("id", "size", "x1", "x2", "n").agg(F.count(F.lit(1)).alias("w"))
    own = Window.partitionBy("id")  # a set's own columns: no more than its text has words
    merged = merged.withColumn("rest", F.sum("w").over(own.orderBy(F.desc("n"), F.desc("x1"), F.desc("x2")).rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.withColumn("total", F.max("rest").over(own))
    return merged.where(F.col("total") >= needed(F.col("size"), link)).drop("total")


def overlaps(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with sa, sb and overlap: the product's entry for each pair, summed over their common columns."""
    left = entries.select(F.col("id").alias("a"), F.col("size").alias("sa"), "x1", "x2", "w")
    right = entries.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    both = pairs.join(left, "a").join(right.withColumnRenamed("b", "r_b"), (F.col("b") == F.col("r_b")) & (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")))
    return both.groupBy("a", "b", "sa", "sb").agg(F.sum("w").alias("overlap"))


def partner_links(heads: DataFrame, entries: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(a, b), written: of each set and its one partner, those that link. The partner is, of the least sets under the
    heads, the one that shares most weight there."""
    least = heads.groupBy("x1", "x2").agg(F.min(F.struct("id", "size")).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = heads.join(least, ["x1", "x2"]).where((F.col("id") != F.col("least.id")) & sizes_fit(F.col("size"), F.col("least.size"), link))
    weights = met.groupBy(F.col("id").alias("a"), F.col("least.id").alias("b")).agg(F.sum("w").alias("w"))
    pairs = weights.groupBy("a").agg(F.max(F.struct("w", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b"))
    return materialize(overlaps(pairs, entries).where(linked(F.col("overlap"), F.col("sa"), F.col("sb"), link)).select("a", "b"), "jaccard-links")


def unsettled(heads: DataFrame, links: DataFrame) -> DataFrame:
    """The heads (id, x1, x2, root, m), written, of columns whose m sets belong to several components of ``links``."""
    near = materialize(connected_components(links), "jaccard-near")
    placed = heads.select("id", "x1", "x2").join(near, F.col("id") == F.col("node"), "left").select("id", "x1", "x2", F.coalesce("root", "id").alias("root"))
    several = placed.groupBy("x1", "x2").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    out = materialize(placed.join(several.drop("lo", "hi"), ["x1", "x2"]), "jaccard-unsettled")
    discard(near)
    return out


def product(cols: np.ndarray, row: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The n x n overlaps of rows given as entries (column number, row, weight). Few columns are laid out at a time."""
    out = np.zeros((n, n))
    count = np.bincount(cols)
    used = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[used] = np.arange(len(used))
    order = np.argsort(place[cols], kind="stable")
    at = place[cols][order]
    for begin in range(0, len(used), COLUMNS):
        lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
        e = order[lo:hi]
        dense = np.zeros((n, COLUMNS))
        dense[row[e], at[lo:hi] - begin] = 1
        weight = np.zeros(COLUMNS)
        weight[at[lo:hi] - begin] = weights[e]  # a column weighs the same in every row
        out += (dense * weight) @ dense.T
    return out


def numbered_columns(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Equal numbers from 0 for equal (x1, x2)."""
    order = np.lexsort((x2, x1))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(x1[order]) != 0) | (np.diff(x2[order]) != 0)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def gathered(mixed: DataFrame) -> DataFrame:
    """The groups (x1, x2) of sets (id, root) that meet, with the number m of their sets, written: any two sets under one
    column of ``mixed`` are in one group.

    Near copies share many columns, each with most of them. A column's hub is the largest one, of ROWS sets at most, that
    any of its sets stands in; columns with one hub are one group, so a set's row is sent there once. Where a hub would
    gather more than ROWS sets, each of its columns stays a group of its own, as larger columns do.
    """
    largest = mixed.where(F.col("m") <= ROWS).groupBy("id").agg(F.max(F.struct("m", "x1", "x2")).alias("largest"))
    hub = mixed.join(largest, "id", "left").groupBy("x1", "x2", "m").agg(F.max("largest").alias("hub"))
    hub = materialize(hub.select("x1", "x2", *[F.when(F.col("m") <= ROWS, F.col(f"hub.{x}")).otherwise(F.col(x)).alias(h) for x, h in (("x1", "h1"), ("x2", "h2"))]), "jaccard-hubs")
    under = materialize(mixed.join(bounded_broadcast(hub), ["x1", "x2"]).select("id", "root", "x1", "x2", "h1", "h2"), "jaccard-met")
    fits = materialize(under.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= ROWS), "jaccard-fits")
    met = under.join(bounded_broadcast(fits), ["h1", "h2"], "left")
    groups = materialize(met.select("id", "root", *[F.when(F.col("n").isNull(), F.col(x)).otherwise(F.col(h)).alias(x) for x, h in (("x1", "h1"), ("x2", "h2"))]).distinct(), "jaccard-groups")
    sizes = materialize(groups.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("m")), "jaccard-sizes")
    out = materialize(groups.join(bounded_broadcast(sizes), ["x1", "x2"]), "jaccard-gathered")
    discard(hub, under, fits, groups, sizes)
    return out


def block_links(mixed: DataFrame, entries: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(a, b), written: links that connect what links under an unsettled head, between different components only.

    The sets of a group meet in blocks of pairs of parts; each block multiplies its whole rows and yields a forest, fewer
    links than rows.
    """
    up, down = link
    groups = gathered(mixed)
    vectors = mixed.select("id").distinct().join(entries.withColumnRenamed("id", "e_id"), F.col("id") == F.col("e_id")).groupBy("id", "size").agg(F.collect_list(F.struct("x1", "x2", "w")).alias("row"))
    vectors = vectors.select("id", "size", *[F.col(f"row.{c}").alias(c) for c in ("x1", "x2", "w")])  # numbers side by side take less room than structs
    parts = F.ceil(F.col("m") / ROWS)
    met = groups.withColumn("own", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = met.select("id", "root", "own", F.struct("x1", "x2", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).alias("g"))
    blocks = met.join(vectors, "id").groupBy("g").agg(F.collect_list(F.struct("id", "root", "own", "size", *[F.col(c).alias(f"r_{c}") for c in ("x1", "x2", "w")])).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, across in zip(batch.column(0), batch.column(1).to_pylist()):
                ids, root, own, size = (rows.values.field(i).to_numpy() for i in range(4))
                x1, x2, w = (rows.values.field(i) for i in (4, 5, 6))
                n = len(ids)
                at = np.repeat(np.arange(n), pa.compute.list_value_length(x1).to_numpy())
                cols = numbered_columns(x1.flatten().to_numpy(), x2.flatten().to_numpy())
                overlap = product(cols, at, w.flatten().to_numpy().astype(np.float64), n)
                ok = (down * overlap >= up * (size[:, None] + size - overlap)) & (root[:, None] != root) & (np.arange(n)[:, None] < np.arange(n))
                if across:
                    ok &= own[:, None] != own
                tree, picked = np.unique(root, return_inverse=True)[1], []
                for i, j in zip(*np.nonzero(ok)):
                    if tree[i] != tree[j]:
                        tree[tree == tree[j]] = tree[i]
                        picked.append((ids[i], ids[j]))
                ab = np.array(picked, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    found = blocks.where(F.size("rows") > 1).select("rows", (F.col("g.p") != F.col("g.q")).alias("across")).mapInArrow(run, "a long, b long").distinct()
    out = materialize(found, "jaccard-links")
    discard(groups)
    return out


def set_roots(docs: DataFrame, chosen: DataFrame, shingle: int, link: tuple[int, int]) -> DataFrame:
    """(s1, s2, root), written, of the sets that link with another one: root is equal for all that links connect."""
    rows = full_rows(docs, chosen, shingle, link)
    entries = materialize(merged_columns(rows, link), "jaccard-entries")
    names = materialize(rows.select("id", "s1", "s2"), "jaccard-names")
    discard(chosen, rows)
    heads = entries.where(F.col("rest") >= needed(F.col("size"), link))
    first = partner_links(heads, entries, link)
    mixed = unsettled(heads, first)
    second = block_links(mixed, entries, link)
    near = connected_components(first.unionByName(second))
    out = materialize(near.join(names, F.col("node") == F.col("id")).select("s1", "s2", "root"), "jaccard-roots")
    discard(entries, names, first, mixed, second)
    return out


def components(docs: DataFrame, shingle: int = 4, link: tuple[int, int] = LINK) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles (the size of its set) and component_id, the
    smallest doc_id that links reach, its own included.

    A text's set holds its distinct shingles of ``shingle`` words (runs of characters other than ASCII white space, A to Z
    in lower case), or all its words as one if they are fewer. Sets link if their overlap is at least ``link`` of their
    union; equal sets do. Texts that are null or without words have an empty set and link with nothing. Null doc_ids are
    no smallest: a component without any doc_id has a null component_id. Repeated rows come out as often as they come in,
    ties don't arise, an empty table gives no rows, other columns are not read. Texts are whole, however long: one is
    worked on at a time, and its set must fit in a task. Shingles count as equal by 64 bits of their hash, sets and merged
    columns by 128.
    """
    keyed = docs.select("doc_id", "text", *[c.alias(k) for k, c in text_key(F.col("text")).items()])
    marked = materialize(incidence(keyed, ["doc_id", "t1", "t2"], shingle, FIRST_BLOCK).withColumn("id", F.monotonically_increasing_id()), "jaccard-marked")
    chosen = candidates(marked, link)
    rows = materialize(marked.select("doc_id", "s1", "s2", "size"), "jaccard-docs")
    discard(marked)
    near = set_roots(docs, chosen, shingle, link)
    sets = rows.where("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    rooted = sets.join(near, ["s1", "s2"], "left")
    of_root = rooted.where("root is not null").groupBy(F.col("root").alias("r_root")).agg(F.min("least").alias("r_least"))
    # Sets of one document that link with nothing need no row here.
    known = rooted.where("m > 1 or root is not null").join(of_root, F.col("root") == F.col("r_root"), "left")
    known = materialize(known.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.coalesce("r_least", "least").alias("component_id")), "jaccard-components")
    discard(near)
    out = rows.join(bounded_broadcast(known), (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's set size and component, for four-word shingles and 85 %."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as materialized (select r, doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) as grams, len(ws) as n_words from w),
s as materialized (select r, doc_id, case when n_words = 0 then 0 else len(grams) end as n from g),
e as materialized (select g.r, s.n, unnest(grams) as gram from g join s using (r) where s.n > 0),
p as (select x.r as a, y.r as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as o from e x join e y on x.gram = y.gram and x.r < y.r and 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) group by x.r, y.r),
l as materialized (select a, b from p where 100 * o >= 85 * (na + nb - o)),
both_ways as materialized (select a, b from l union all select b, a from l),
reach as (select r as a, r as b from s union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select doc_id, cast(n as bigint) as n_shingles, m as component_id from s join (select reach.a as r, min(s.doc_id) as m from reach join s on reach.b = s.r group by reach.a) using (r)
"""
