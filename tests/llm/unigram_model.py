"""A unigram model for the sentencepiece library with the pieces of a file and the scores of a Vocabulary."""

from __future__ import annotations

import struct

import sentencepiece


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _fields(raw: bytes):
    i = 0

    def read():
        nonlocal i
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while i < len(raw):
        key = read()
        kind = key & 7
        if kind == 0:
            yield key, read()
        elif kind == 2:
            n = read()
            yield key, raw[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key, raw[i : i + n]
            i += n


def _write(fields) -> bytes:
    out = b""
    for key, value in fields:
        out += _varint(key) + (_varint(value) if key & 7 == 0 else _varint(len(value)) + value if key & 7 == 2 else value)
    return out


def unigram_processor(path: str, scores: dict[int, float]) -> sentencepiece.SentencePieceProcessor:
    """Pieces get ``scores`` by id; the others keep theirs. Field numbers are those of the library's public format."""
    raw = open(path, "rb").read()
    parts, n = [], 0
    for key, value in _fields(raw):
        if key == 1 << 3 | 2:
            piece = dict(_fields(value))
            if n in scores:
                piece[2 << 3 | 5] = struct.pack("<f", scores[n])
            value, n = _write(sorted(piece.items())), n + 1
        elif key == 2 << 3 | 2:
            spec = [(k, 1 if k == 3 << 3 else v) for k, v in _fields(value)]
            value = _write(spec)
        parts.append(_varint(key) + _varint(len(value)) + value if key & 7 == 2 else _write([(key, value)]))
    return sentencepiece.SentencePieceProcessor(model_proto=b"".join(parts))
