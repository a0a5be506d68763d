"""Token counts without tokens: Viterbi that carries the best score and the number of pieces only.

An Aho-Corasick automaton over the vocabulary reads each distinct unit of text once; at every byte it lists the pieces
that end there, longest first, and the dynamic programme keeps the best score and its piece count. All units of a batch
advance together, one byte at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pieces
from .vocabulary import Vocabulary, units, vocabulary, with_prefix

#: Units longer than this are counted one by one, so that a long unit doesn't make a batch take as many steps.
LONG_UNIT = 96


class Automaton:
    """Aho-Corasick over bytes, as tables: the next state of each state and byte, the longest piece that ends in a
    state, and the state of the next shorter one."""

    def __init__(self, vocab: Vocabulary) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, (piece, _, _) in enumerate(vocab.pieces):
            s = 0
            for byte in piece:
                nxt = children[s].get(byte)
                if nxt is None:
                    nxt = len(children)
                    children[s][byte] = nxt
                    children.append({})
                    ends.append(-1)
                s = nxt
            if ends[s] < 0:
                ends[s] = k
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        self.shorter = np.zeros(n, np.int32)  # 0: none
        own = np.array(ends)
        fail = np.zeros(n, np.int64)
        queue = deque()
        for byte, s in children[0].items():
            self.next[0, byte] = s
            queue.append(s)
        while queue:
            s = queue.popleft()
            f = int(fail[s])
            self.next[s] = self.next[f]
            self.shorter[s] = f if own[f] >= 0 else self.shorter[f]
            for byte, t in children[s].items():
                fail[t] = self.next[f, byte]
                self.next[s, byte] = t
                queue.append(t)
        self.length = np.array([len(vocab.pieces[k][0]) if k >= 0 else 0 for k in ends], np.int32)
        self.score = np.array([vocab.pieces[k][2] if k >= 0 else 0 for k in ends], np.float32)
        self.first = np.where(own >= 0, np.arange(n), self.shorter).astype(np.int32)  # the first state with a piece
        self.unknown = np.float32(vocab.unknown_score)
        self.fallback = bool((vocab.byte_ids >= 0).all())

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of pieces of the best segmentation of each unit.

        Ties keep the earlier candidate: longer pieces come first, and only a better score replaces one. A character
        that no piece covers alone may be unknown; it then counts as its bytes, or as 1 without byte fallback.
        """
        lengths = np.diff(offsets)
        out = np.zeros(len(lengths), np.int64)
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG_UNIT))
        for i in np.flatnonzero(lengths > LONG_UNIT).tolist():
            out[i] = self._one(data[offsets[i] : offsets[i + 1]].tobytes())
        if not len(short):
            return out
        short = short[np.argsort(-lengths[short], kind="stable")]
        size, begin = lengths[short], offsets[:-1][short]
        longest = int(size[0])
        best = np.full((longest + 1, len(short)), -np.inf, np.float32)
        made = np.zeros((longest + 1, len(short)), np.int32)
        best[0] = 0
        state = np.zeros(len(short), np.int32)
        char_at = np.zeros(len(short), np.int64)  # where the current character begins
        live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # units with so many bytes come first
        for j in range(1, longest + 1):
            n = int(live[j - 1])
            byte = data[begin[:n] + j - 1]
            follows = (byte & 0xC0) == 0x80
            char_at[:n] = np.where(follows, char_at[:n], j - 1)
            s = self.next[state[:n], byte]
            state[:n] = s
            single = np.zeros(n, bool)
            who = np.arange(n)
            at = self.first[s]
            top, num = best[j], made[j]
            while True:
                some = at > 0
                if not some.all():
                    who, at = who[some], at[some]
                if not len(who):
                    break
                back = j - self.length[at]
                candidate = best[back, who] + self.score[at]
                better = candidate > top[who]
                w = who[better]
                top[w] = candidate[better]
                num[w] = made[back[better], w] + 1
                single[who[back == char_at[who]]] = True
                at = self.shorter[at]
            # The last byte of a character ends here if the next byte doesn't follow it.
            last = np.ones(n, bool)
            more = int(live[j]) if j < longest else 0
            last[:more] = (data[begin[:more] + j] & 0xC0) != 0x80
            w = np.flatnonzero(last & ~single)
            if len(w):
                back = char_at[w]
                candidate = best[back, w] + self.unknown
                better = candidate > top[w]
                w, back = w[better], back[better]
                top[w] = candidate[better]
                num[w] = made[back, w] + (j - back if self.fallback else 1)
        out[short] = made[size, np.arange(len(short))]
        return out

    def _one(self, unit: bytes) -> int:
        n = len(unit)
        best, made, s, char_at = [0.0] + [-np.inf] * n, [0] * (n + 1), 0, 0
        plus = np.float32
        for j in range(1, n + 1):
            if unit[j - 1] & 0xC0 != 0x80:
                char_at = j - 1
            s = int(self.next[s, unit[j - 1]])
            at, single = int(self.first[s]), False
            while at > 0:
                back = j - int(self.length[at])
                candidate = plus(best[back]) + self.score[at]
                if candidate > best[j]:
                    best[j], made[j] = candidate, made[back] + 1
                single |= back == char_at
                at = int(self.shorter[at])
            if not single and (j == n or unit[j] & 0xC0 != 0x80):
                candidate = plus(best[char_at]) + self.unknown
                if candidate > best[j]:
                    best[j], made[j] = candidate, made[char_at] + (j - char_at if self.fallback else 1)
        return made[n]


_automata: dict[tuple, tuple[Vocabulary, Automaton]] = {}


def automaton(path: str, scores: str) -> tuple[Vocabulary, Automaton]:
    """A Python worker's own; kept from task to task."""
    if (path, scores) not in _automata:
        vocab = vocabulary(path, scores)
        _automata[path, scores] = vocab, Automaton(vocab)
    return _automata[path, scores]


def count_texts(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, auto: Automaton) -> np.ndarray:
    """Number of pieces of each text; the score starts anew with every unit."""
    data, offsets = with_prefix(data, offsets)
    starts, coded = units(data, offsets, vocab)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    values = coded.dictionary
    where = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    counts = auto.count(np.frombuffer(values.buffers()[2], np.uint8), where)[coded.indices.to_numpy()]
    upto = np.concatenate([[0], np.cumsum(counts)])
    edges = np.searchsorted(starts, offsets)
    return upto[edges[1:]] - upto[edges[:-1]]


def token_counts(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """(doc_id, n_tokens) of every whole text. Null and empty texts have none; rows are counted one by one, so repeated
    rows and null doc_ids stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, auto = automaton(path, scores)
        for part, data, offsets in pieces(batches, "_t_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_texts(data, offsets, vocab, auto))], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_t_text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
