"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pieces
from .vocabulary import MARK, Vocabulary, units, vocabulary, with_prefix

#: Units longer than this are encoded one by one, so that a long unit doesn't make a batch take as many steps.
LONG_UNIT = 96
#: Units that advance together, and bytes of text that are worked on at a time.
UNITS, PIECE = 16_384, 2 << 20


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, vocab: Vocabulary) -> None:
        words = sorted((p, k) for k, (p, _, _) in enumerate(vocab.pieces))
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        free = wide = 1
        jobs = [(0, 0, len(words), 0)]
        while jobs:
            s, lo, hi, depth = jobs.pop()
            if len(words[lo][0]) == depth:
                self.value[s] = words[lo][1]
                while lo < hi and len(words[lo][0]) == depth:
                    lo += 1
            if lo == hi:
                continue
            spans, i = [], lo
            while i < hi:
                c, j = words[i][0][depth], i
                while j < hi and words[j][0][depth] == c:
                    j += 1
                spans.append((c, i, j))
                i = j
            codes = np.array([c + 1 for c, _, _ in spans])
            # Single children fill the gaps from the left; states with more are put behind all others of their kind.
            while taken[free]:
                free += 1
            at = max(free - int(codes[0]), 1) if len(codes) == 1 else wide
            while True:
                if at + 258 >= len(taken):
                    grow = len(taken)
                    self.base, taken = np.concatenate([self.base, np.zeros(grow, np.int32)]), np.concatenate([taken, np.zeros(grow, bool)])
                    self.check, self.value = np.concatenate([self.check, np.full(grow, -1, np.int32)]), np.concatenate([self.value, np.full(grow, -1, np.int32)])
                if not taken[at + codes].any():
                    break
                at += 1
            if len(codes) > 1:
                wide = at
            else:
                free = at + int(codes[0])
            self.base[s] = at
            for c, i, j in spans:
                t = at + c + 1
                taken[t], self.check[t] = True, s
                jobs.append((t, i, j, depth + 1))
        room = np.zeros(258, np.int32)
        self.base, self.check, self.value = np.concatenate([self.base, room]), np.concatenate([self.check, room - 1]), np.concatenate([self.value, room - 1])

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children; -1 where there is none."""
        t = self.base[state] + byte + 1
        return np.where((self.check[t] == state) & (self.base[state] > 0), t, -1)


class Unigram:
    """The best segmentation by the sum of piece scores.

    Places are visited from left to right, at each the pieces that begin there from short to long, then the unknown
    character if no piece is that character; a candidate replaces what ends at the same place only if it scores more.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.trie = vocab, DoubleArray(vocab)
        self.score = np.array([s for _, _, s in vocab.pieces], np.float32)
        self.id = np.array([i for _, i, _ in vocab.pieces], np.int64)
        self.unknown = np.float32(vocab.unknown_score)

    def encode_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each unit has)."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        n_long = int((lengths > LONG_UNIT).sum())
        texts = [self._one(data[offsets[i] : offsets[i + 1]]) for i in order[:n_long].tolist()]
        short = order[n_long:]
        # By length, a few at a time: the tables are as wide as the longest unit among them.
        done = [self._many(data, offsets[:-1][p], lengths[p]) for p in (short[i : i + UNITS] for i in range(0, len(short), UNITS))]
        ids = np.concatenate([np.zeros(0, np.int64), *texts, *(d[0] for d in done)])
        counts = np.concatenate([np.array([len(t) for t in texts], np.int64), *(d[1] for d in done)])
        # Back to the units' own order.
        begin = np.cumsum(counts) - counts
        where = np.empty(len(lengths), np.int64)
        where[order] = np.arange(len(order))
        size = counts[where]
        ends = np.cumsum(size)
        return ids[np.repeat(begin[where] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def _many(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longest = int(size[0])
        n = len(size)
        best = np.full((longest + 1, n), -np.inf, np.float32)
        came = np.zeros((longest + 1, n), np.int16)  # where the piece that ends here begins
        which = np.full((longest + 1, n), -1, np.int32)  # which piece it is; -1: an unknown character
        best[0] = 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        for i in range(longest):
            m = int(live[i])
            first = data[begin[:m] + i]
            who = np.flatnonzero((first & 0xC0) != 0x80)  # characters begin here
            char = np.ones(len(who), np.int64)
            lead = first[who]
            char += (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            char = np.minimum(char, size[who] - i)
            single = np.zeros(m, bool)
            here = best[i]
            at, state, k = who, np.zeros(len(who), np.int32), i
            char_of = np.zeros(m, np.int64)
            char_of[who] = char
            while len(at):
                state = self.trie.step(state, data[begin[at] + k].astype(np.int32))
                go = state >= 0
                at, state, k = at[go], state[go], k + 1
                value = self.trie.value[state]
                hit = value >= 0
                w, v = at[hit], value[hit]
                candidate = here[w] + self.score[v]
                single[w[char_of[w] == k - i]] = True
                better = candidate > best[k, w]
                w, v = w[better], v[better]
                best[k, w], came[k, w], which[k, w] = candidate[better], i, v
                more = size[at] > k
                at, state = at[more], state[more]
            w = who[~single[who]]
            if len(w):
                to = i + char_of[w]
                candidate = here[w] + self.unknown
                better = candidate > best[to, w]
                w, to = w[better], to[better]
                best[to, w], came[to, w], which[to, w] = candidate[better], i, -1
        # Walk back from the ends, all units together; pieces come out last first.
        at, who, steps = size.copy(), np.arange(n), []
        while len(who):
            v, back = which[at, who], came[at, who].astype(np.int64)
            steps.append((who, v, begin[who] + back, at - back))
            at = back
            go = at > 0
            at, who = at[go], who[go]
        turn = np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)])
        who, v, place, width = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((-turn, who))
        who, v, place, width = who[order], v[order], place[order], width[order]
        unknown = v < 0
        times = np.where(unknown, width, 1)
        ids = np.repeat(np.where(unknown, -1, self.id[v]), times)
        ends = np.cumsum(times)
        inner = np.arange(len(ids)) - np.repeat(ends - times, times)
        byte = data[np.repeat(place, times) + inner]
        fallback = self.vocab.byte_ids[byte]
        ids = np.where(ids < 0, np.where(fallback >= 0, fallback, self.vocab.unknown_id), ids)
        return ids, np.bincount(who, times, n).astype(np.int64)

    def _one(self, unit: np.ndarray) -> np.ndarray:
        raw, n = unit.tobytes(), len(unit)
        best, came, which = [np.float32(0)] + [np.float32(-np.inf)] * n, [0] * (n + 1), [-1] * (n + 1)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        i = 0
        while i < n:
            lead = raw[i]
            width = min(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), n - i)
            s, k, single = 0, i, False
            while k < n and base[s] > 0:
                t = int(base[s]) + raw[k] + 1
                if check[t] != s:
                    break
                s, k = t, k + 1
                if value[s] >= 0:
                    candidate = best[i] + score[value[s]]
                    single |= k - i == width
                    if candidate > best[k]:
                        best[k], came[k], which[k] = candidate, i, int(value[s])
            if not single:
                candidate = best[i] + self.unknown
                if candidate > best[i + width]:
                    best[i + width], came[i + width], which[i + width] = candidate, i, -1
            i += width
        out: list[int] = []
        while n > 0:
            if which[n] >= 0:
                out.append(int(self.id[which[n]]))
            else:
                b = [int(self.vocab.byte_ids[x]) for x in raw[came[n] : n]]
                out += [x if x >= 0 else self.vocab.unknown_id for x in reversed(b)]
            n = came[n]
        return np.array(out[::-1], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        data, offsets = with_prefix(data, offsets)
        starts, coded = units(data, offsets, self.vocab)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        values = coded.dictionary
        where = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
        pool, size = self.encode_units(np.frombuffer(values.buffers()[2], np.uint8), where)
        begin, unit = np.cumsum(size) - size, coded.indices.to_numpy()
        counts = size[unit]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(begin[unit] - upto[:-1], counts) + np.arange(upto[-1])]
        edges = np.searchsorted(starts, offsets)
        return ids, upto[edges[1:]] - upto[edges[:-1]]

    def decoder(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, and each id's place and length in them. Byte pieces are their byte."""
        texts = [t.encode() for t in self.vocab.text]
        for byte, i in enumerate(self.vocab.byte_ids.tolist()):
            if i >= 0:
                texts[i] = bytes([byte])
        texts[self.vocab.unknown_id] = " ⁇ ".encode()
        size = np.array([len(t) for t in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The bytes of each text: its pieces one after another, markers as spaces, without the space put before a text."""
    pool, begin, size = table
    times = size[ids]
    upto = np.concatenate([[0], np.cumsum(times)])
    raw = pool[np.repeat(begin[ids] - upto[:-1], times) + np.arange(upto[-1])].tobytes()
    edges = upto[offsets].tolist()
    return [raw[a:b].removeprefix(b" ") for a, b in zip(edges[:-1], edges[1:])]


_coders: dict[tuple, tuple[Unigram, tuple]] = {}


def coder(path: str, scores: str) -> tuple[Unigram, tuple]:
    """A Python worker's own; kept from task to task."""
    if (path, scores) not in _coders:
        model = Unigram(vocabulary(path, scores))
        _coders[path, scores] = model, model.decoder()
    return _coders[path, scores]


def encode_documents(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int), the ids of the whole text; null and empty texts have none.

    Every other column is kept; a column of that name is replaced. Rows are encoded one by one, so repeated rows and
    null doc_ids stay as they are.
    """
    keep = [c for c in docs.columns if c != "piece_ids"]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in keep), T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = coder(path, scores)
        for part, data, offsets in pieces(batches, "text", PIECE):
            ids, counts = model.encode(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*keep, "piece_ids"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str, into: str = "text", scores: str = "zipf") -> DataFrame:
    """``coded`` with the text of ``piece_ids`` as column ``into``; ``piece_ids`` goes. Ids are those of ``path``; null
    lists decode to an empty text, bytes that are no UTF-8 to U+FFFD."""
    keep = [c for c in coded.columns if c not in ("piece_ids", into)]
    schema = T.StructType([*(T.StructField(c, coded.schema[c].dataType, True) for c in keep), T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = coder(path, scores)
        for batch in batches:
            lists = batch.column(len(keep))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            texts = decode_ids(flat, np.concatenate([[0], np.cumsum(counts)]), table)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*keep, into])

    return coded.select(*[F.col(f"`{c}`") for c in keep], "piece_ids").mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, ids: bool = True, scores: str = "zipf") -> DataFrame:
    """``docs`` with n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip (whether decoding
    gives the text back, markers as spaces); with ``ids`` also piece_ids. Null text counts as empty; ``text`` goes.

    Both ways in one pass, so a task needs one Python worker and the texts come to it once.
    """
    new = [("n_pieces", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_())]
    keep = [c for c in docs.columns if c not in ("text", "piece_ids", *(n for n, _, _ in new))]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in keep), *(T.StructField(n, t) for n, t, _ in new)])
    if ids:
        schema = schema.add("piece_ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = coder(path, scores)
        for part, data, offsets in pieces(batches, "text", PIECE):
            found, counts = model.encode(data, offsets)
            upto = np.concatenate([[0], np.cumsum(counts)])
            texts = zip(decode_ids(found, upto, table), offsets[:-1].tolist(), offsets[1:].tolist())
            same = [t == data[a:b].tobytes().replace(MARK.encode(), b" ") for t, a, b in texts]
            small = found.astype("<i4")
            crc = [zlib.crc32(small[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            columns = [*(part.column(i) for i in range(len(keep))), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(small)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document: number and checksum of its ids, and whether its text came back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False)
