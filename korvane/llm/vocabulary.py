"""The pieces of a SentencePiece file as a unigram vocabulary, and texts cut where no piece can cross.

White space is written as byte 0x20 here, inside pieces too, instead of the marker U+2581; a marker that a text itself
holds is taken for a space, as the tokenizer does.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._common import binary_array

MARK = "▁"
#: The tokenizer takes the lowest score less this for a character that no piece covers.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with log scores.

    ``scores``: "file" takes the file's own; "zipf" gives a piece the log of a share that falls with its rank, as a
    merge list's scores are ranks and no logarithms. Scores are float32, as in the tokenizer.
    """

    def __init__(self, path: str, scores: str = "zipf") -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.unknown_id = n, sp.unk_id()
        self.byte_ids = np.full(256, -1, np.int64)
        self.pieces: list[tuple[bytes, int, float]] = []
        self.text = [""] * n
        self.is_byte = np.zeros(n, bool)
        total = math.log(sum(1 / (r + 1) for r in range(n)))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.is_byte[i] = True
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = piece.replace(MARK, " ")
                score = sp.get_score(i) if scores == "file" else -math.log(1 - sp.get_score(i)) - total
                self.pieces.append((self.text[i].encode(), i, float(np.float32(score))))
        self.unknown_score = np.float32(np.float32(min(s for _, _, s in self.pieces)) - np.float32(UNKNOWN_PENALTY))
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if any(b" " in p.lstrip(b" ") for p, _, _ in self.pieces):
            raise ValueError("a piece holds white space after other text: words can't be segmented on their own")
        # Single bytes that no piece holds: a text can be cut on both sides of them.
        used = np.zeros(256, bool)
        used[list(set(b"".join(p for p, _, _ in self.pieces)))] = True
        self.lone = ~used & (np.arange(256) < 128)


@lru_cache(maxsize=2)
def vocabulary(path: str, scores: str = "zipf") -> Vocabulary:
    return Vocabulary(path, scores)


def with_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with markers as spaces and a space before each text that isn't empty, as the tokenizer does."""
    raw = data.tobytes()
    if MARK.encode() in raw:
        texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        raw, offsets = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(raw, np.uint8)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    out = np.insert(data, offsets[full], 32)
    grown = np.zeros(len(offsets), np.int64)
    grown[1:] = np.cumsum(offsets[1:] > offsets[:-1])
    return out, offsets + grown


def units(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(first bytes, texts) of the units of texts: runs of spaces with what follows them, and lone bytes. No piece
    crosses their ends, so the best segmentation of a text is that of its units."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    if n > 1:
        space = data == 32
        cut[1:n] |= space[1:] & ~space[:-1]
        lone = vocab.lone[data]
        cut[:n] |= lone
        cut[1 : n + 1] |= lone
    starts = np.flatnonzero(cut[:n])
    return starts, binary_array(data, np.diff(np.concatenate([starts, [n]]))).dictionary_encode()
