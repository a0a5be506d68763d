"""Simple-8b word-aligned coding of unsigned 64-bit integers, vectorised.

A 64-bit word holds a selector in its upper 4 bits and up to 60 values of equal width in the other 60. Values that
need more than 60 bits go to a list of escapes; their word, with selector 0, holds their place in that list. Values are
coded in blocks of BLOCK that share no word, and each block's first word is recorded, so blocks decode on their own.
"""

from __future__ import annotations

import numpy as np

#: How many values a word holds, and their width, by selector. Selector 0 is the escape.
COUNTS = (1, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 4096
#: Selector 1 stays free: a run of values is never coded by it.
USED = range(15, 1, -1)


def _runs(ok: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` values in a row are ok, counted from each place; False where fewer follow."""
    out, have = ok, 1
    while have < n:
        step = min(have, n - have)
        nxt = np.zeros_like(out)
        if step >= len(out):
            return nxt
        nxt[: len(out) - step] = out[: len(out) - step] & out[step:]
        out, have = nxt, have + step
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes), all of unsigned integers."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    place = np.arange(n) % BLOCK
    room = np.minimum(BLOCK - place, n - np.arange(n)).astype(np.int32)
    select = np.zeros(n, np.uint8)
    for s in USED:  # rising counts: the last that fits holds the most values
        ok = values < np.uint64(1 << WIDTHS[s])
        if ok.any():
            select[_runs(ok, COUNTS[s]) & (room >= COUNTS[s])] = s
    step, mark, i = np.array(COUNTS, np.uint8)[select].tobytes(), bytearray(n), 0
    while i < n:
        mark[i] = 1
        i += step[i]
    starts = np.flatnonzero(np.frombuffer(mark, np.uint8))
    chosen = select[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        at = np.flatnonzero(chosen == s)
        if s == 0:
            words[at] |= np.arange(len(at), dtype=np.uint64)
            continue
        begin, held = starts[at], np.zeros(len(at), np.uint64)
        for k in range(COUNTS[s]):
            held |= values[begin + k] << np.uint64(WIDTHS[s] * k)
        words[at] |= held
    first = np.searchsorted(starts, np.arange(0, n, BLOCK)).astype(np.uint32)
    return words, first, values[starts[chosen == 0]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of whole blocks."""
    select = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array(COUNTS, np.int64)[select]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - counts
    for s in np.unique(select).tolist():
        at = np.flatnonzero(select == s)
        w = words[at]
        if s == 0:
            out[begin[at]] = escapes[(w & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[begin[at] + k] = (w >> np.uint64(WIDTHS[s] * k)) & mask
    return out


def decode_blocks(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, block: int, n_blocks: int = 1) -> np.ndarray:
    """The values of ``n_blocks`` blocks from ``block`` on, read from their words alone."""
    end = int(first[block + n_blocks]) if block + n_blocks < len(first) else len(words)
    return decode(words[int(first[block]) : end], escapes)
