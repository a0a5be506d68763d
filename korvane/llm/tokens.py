"""Token ids of documents in Simple-8b files, and back."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from ._common import binary_array, bounded_broadcast, materialize, new_path, pieces

#: A row of a file holds whole documents of about so many ids.
ROW_IDS = 1 << 18
#: Distinct units that a Python worker remembers the ids of.
CACHE_UNITS = 300_000
#: Bytes of text that are encoded at a time.
PIECE = 2 << 20

FILE_SCHEMA = "shard int, row int, doc_ids array<long>, n_tokens array<int>, words binary, block_at array<int>, escapes binary"


#: What a byte is: printable ASCII; an ASCII letter; a pause mark; a space or line break; the first byte of a character of
#: two, none of which is white space; a later byte of a character.
_GRAPH, _LETTER, _PAUSE, _GAP, _LEAD, _FOLLOW = 1, 2, 4, 8, 16, 32
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((_GRAPH, range(33, 127)), (_LETTER, [*range(65, 91), *range(97, 123)]), (_PAUSE, b".,;:?!"), (_GAP, b" \n"), (_LEAD, range(0xC3, 0xE0)), (_FOLLOW, range(0x80, 0xC0))):
    _KINDS[list(_bytes)] |= _kind


def _kinds(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_KINDS.tobytes()), np.uint8)


def _ends_char(kinds: np.ndarray) -> np.ndarray:
    """Whether each byte ends a character that is surely not white space."""
    out = (kinds & _GRAPH) != 0
    out[1:] |= ((kinds[1:] & _FOLLOW) != 0) & ((kinds[:-1] & _LEAD) != 0)
    return out


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which a byte-level BPE's own split of the text surely has a boundary, texts' starts included.

    A single space or line break between two characters that are not white space begins a piece, and so does a pause
    mark after a letter. No token crosses such a place, so the units between can be encoded on their own.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    if n > 2:
        kinds = _kinds(data)
        cut[1 : n - 1] |= ((kinds[1:-1] & _GAP) != 0) & _ends_char(kinds)[:-2] & ((kinds[2:] & (_GRAPH | _LEAD)) != 0)
        cut[1:n] |= ((kinds[1:] & _PAUSE) != 0) & ((kinds[:-1] & _LETTER) != 0)
    return np.flatnonzero(cut[:n])


def binary_buffer(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes and offsets (from 0)."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = values.buffers()
    offsets = np.frombuffer(where, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def may_join(units: pa.BinaryArray) -> np.ndarray:
    """Which units may stand next to each other in one text: a space or line break and then text, as ``unit_starts`` cuts
    it on both sides, and no part of a special token."""
    data, offsets = binary_buffer(units)
    out = np.diff(offsets) > 1
    first, last = offsets[:-1][out], offsets[1:][out] - 1
    kinds = _kinds(data)
    out[out] = ((kinds[first] & _GAP) != 0) & ((kinds[first + 1] & (_GRAPH | _LEAD)) != 0) & _ends_char(kinds)[last]
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    out[np.searchsorted(offsets, special, "right") - 1] = False
    return out


class Encoder:
    """The tokenizers library, asked once for each distinct unit of text."""

    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # byte-level tokens: one character for each byte
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        #: The units known so far; after them in ``at`` and ``size`` their ids' places in the pool. Place 0 is the end id.
        self.known = pa.array([], pa.binary())
        self.pool, self.at, self.size = np.array([self.end_id or 0], np.uint32), np.array([0], np.int64), np.array([1], np.int64)
        self.met = np.zeros(1, np.int64)  # in how many pieces of text each was met

    def keep_frequent(self, limit: int) -> None:
        """Forget all but the ``limit`` units that were met most often."""
        kept = np.sort(np.argpartition(-self.met[1:], limit)[:limit])
        self.known = self.known.take(pa.array(kept))
        size = np.append(1, self.size[kept + 1])
        old, at = np.append(0, self.at[kept + 1]), np.cumsum(size) - size
        self.pool = self.pool[np.repeat(old - at, size) + np.arange(size.sum())]
        self.at, self.size, self.met = at, size, np.append(0, self.met[kept + 1])

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 64):  # a few at a time: the library's results take far more room than the ids
            yield from [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]

    def learn(self, units: pa.BinaryArray) -> np.ndarray:
        """Encode new units, those that may stand next to each other joined into longer texts, and give their places."""
        may = may_join(units)
        joint, alone = np.flatnonzero(may), [np.flatnonzero(~may)]
        ids, sizes, order = [], [], []
        together = units.take(pa.array(joint))
        data, offsets = binary_buffer(together)
        raw, begins = data.tobytes(), np.arange(0, len(together), 256).tolist()
        bounds = offsets[[*begins, len(together)]].tolist()
        for i, a, b, got in zip(begins, bounds, bounds[1:], self._encode([raw[a:b].decode() for a, b in zip(bounds, bounds[1:])])):
            group = joint[i : i + 256]
            flat = np.array(got, np.uint32)
            ends = offsets[i + 1 : i + 1 + len(group)] - a
            reach = np.cumsum(self.n_bytes[flat])
            cut = np.searchsorted(reach, ends)
            if len(flat) and cut[-1] < len(reach) and (reach[cut] == ends).all():
                ids.append(flat)
                sizes.append(np.diff(np.concatenate([[0], cut + 1])))
                order.append(group)
            else:
                alone.append(group)
        order = np.concatenate([*order, *alone])
        for got in self._encode([u.decode() for u in units.take(pa.array(np.concatenate(alone))).to_pylist()]):
            ids.append(np.array(got, np.uint32))
            sizes.append(np.array([len(got)], np.int64))
        new = np.concatenate(sizes)
        begin = len(self.pool) + np.cumsum(new) - new
        places = np.empty(len(units), np.int64)
        places[order] = len(self.at) + np.arange(len(order))
        self.known = pa.concat_arrays([self.known, units.take(pa.array(order))])
        self.at, self.size, self.pool = np.concatenate([self.at, begin]), np.concatenate([self.size, new]), np.concatenate([self.pool, *ids])
        self.met = np.append(self.met, np.zeros(len(new), np.int64))
        return places

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has), the end id included if there is one."""
        if len(self.known) > CACHE_UNITS:
            self.keep_frequent(CACHE_UNITS // 2)
        starts = unit_starts(data, offsets)
        lengths = np.diff(np.concatenate([starts, [len(data)]]))
        coded = binary_array(data, lengths).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        distinct = found.fill_null(-1).to_numpy().astype(np.int64) + 1
        if found.null_count:
            distinct[distinct == 0] = self.learn(coded.dictionary.filter(found.is_null()))
        self.met[distinct] += 1
        place = distinct[coded.indices.to_numpy()]
        ends = np.searchsorted(starts, offsets[1:])
        if self.end_id is not None:
            place = np.insert(place, ends, 0)
            ends = ends + np.arange(1, len(ends) + 1)
        size = self.size[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.at[place] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(np.concatenate([[0], upto[ends]]))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """A Python worker's own; kept from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2) -> None:
    """Write the ids of every whole text (null: empty), in ascending doc_id order (null first, then by text).

    Documents are range partitioned by doc_id; a partition is a shard, and its rows hold whole documents of about
    ROW_IDS ids: their doc_ids and numbers of ids, the Simple-8b words, the first word of each block and the escapes.
    Rows are written by Spark, so shards of lost tasks are written again whole, to any store that Spark writes to.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t_text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, row, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer, end_id)
        schema = pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("words", pa.binary()), ("block_at", pa.list_(pa.int32())), ("escapes", pa.binary())])
        for part, data, offsets in pieces(batches, "_t_text", PIECE):
            ids, counts = coder.encode(data, offsets)
            doc_ids, upto = part.column(0).to_pylist(), np.concatenate([[0], np.cumsum(counts)])
            i = 0
            while i < len(counts):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + ROW_IDS, "right")) - 1)
                words, first, escapes = simple8b.encode(ids[upto[i] : upto[j]])
                values = [[shard], [row], [doc_ids[i:j]], [counts[i:j].tolist()], [words.astype("<u8").tobytes()], [first.tolist()], [escapes.astype("<u8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)
                row, i = row + 1, j

    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_t_text").mapInArrow(run, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _row_ids(words: bytes, escapes: bytes) -> np.ndarray:
    return simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: (doc_id, start, n_tokens, ids_crc32)."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                ids = _row_ids(one["words"], one["escapes"]).astype("<u4")
                counts = np.array(one["n_tokens"], np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                k = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([one["shard"]] * k, pa.int32()), pa.array([one["row"]] * k, pa.int32()), pa.array(one["doc_ids"], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["shard", "row", "doc_id", "in_row", "n_tokens", "ids_crc32"])

    found = rows.select("shard", "row", "doc_ids", "n_tokens", "words", "escapes").mapInArrow(run, "shard int, row int, doc_id long, in_row long, n_tokens long, ids_crc32 long")
    sizes = rows.select("shard", "row", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("ids"))
    shards = sizes.groupBy("shard").agg(F.sum("ids").alias("ids"))  # one row for each file part
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("s_shard"), F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("shard_at"))
    in_shard = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("row_at", F.coalesce(F.sum("ids").over(in_shard), F.lit(0))).join(shards, F.col("shard") == F.col("s_shard"))
    sizes = materialize(sizes.select(F.col("shard").alias("z_shard"), F.col("row").alias("z_row"), (F.col("row_at") + F.col("shard_at")).alias("row_start")), "token-rows")
    out = found.join(bounded_broadcast(sizes), (F.col("shard") == F.col("z_shard")) & (F.col("row") == F.col("z_row")))
    return out.select("doc_id", (F.col("row_start") + F.col("in_row")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: (doc_id, ids), of every document of the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, counts, words, escapes = (batch.column(i)[r].as_py() for i in range(4))
                ids = _row_ids(words, escapes).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_ids", "n_tokens", "words", "escapes").mapInArrow(run, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids and read them back."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
