"""What the operators of this subpackage share: Arrow text buffers, words, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..shared import discard, materialize, new_path, release, scope, shared_dir
from ..shared import small as bounded_broadcast

__all__ = ["Words", "binary_array", "bounded_broadcast", "discard", "materialize", "new_path", "per_text", "pieces", "release", "scope", "shared_dir", "text_buffer"]

#: Python works through a batch in pieces of about so many bytes of text, so memory does not follow the batch size.
PIECE_BYTES = 8 << 20


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text each, with the text's bytes and offsets (from 0)."""
    for batch in batches:
        data, off = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


#: Bytes that separate words: space, \t, \n, \v, \f, \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words (runs of bytes other than ASCII white space) of some texts: spans in the bytes, and each word's text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        inside = ~IS_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end also ends a word
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.inside = inside
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        #: Words of text i are first_word[i] to first_word[i + 1].
        self.first_word = np.searchsorted(self.starts, offsets)

    def array(self, data: np.ndarray) -> pa.BinaryArray:
        return binary_array(data[self.inside], self.ends - self.starts)


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """Contiguous values of the given lengths, without a copy."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds in each text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
