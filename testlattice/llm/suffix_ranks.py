"""Ranks of a text's positions by prefix doubling, and the positions that stand for all others."""

from __future__ import annotations

import numpy as np
import xxhash

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
SLICE = 1 << 20
_U = np.uint64
FIRST = (np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F) >> _U(29))
SECOND = (np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F) >> _U(31))


def _odd(have: int, table: np.ndarray) -> np.uint64:
    """The multiplier of the left rank when ranks of ``have`` bytes are paired."""
    return table[(have * 37 + 11) % 256] | _U(1)


def ranks(data: np.ndarray, length: int, table: np.ndarray = FIRST) -> np.ndarray:
    """Rank of the ``length`` bytes from every position: names of rank pairs at offset 1, 2, 4, ... and of what is left to ``length``.

    The name of a pair is left * odd + right modulo 2^64, with another odd number for each offset; names are mixed at the end.
    """
    out, have = table[data], 1
    while have < length:
        step = min(have, length - have)
        paired = out[: max(0, len(out) - step)] * _odd(have, table)
        paired += out[step:]
        out = paired
        have += step
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    out ^= out >> _U(29)
    return out


def least(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` consecutive values."""
    out, have = values, 1
    while have < window:
        step = min(have, window - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: (rank of the gram, rank of the anchor's block, first window, number of windows, how many of them follow each other).

    Each window of LENGTH bytes belongs to the gram in it with the least rank, the first one on ties. Equal windows thus
    belong to equal grams at equal places. The windows of an anchor follow each other; together they are its block, which is named
    by its bytes and the anchor's place in it. In a text of a short period every period has an anchor, with the same block again and
    again: such a run is one anchor with a count.
    """
    parts = []
    total = len(text)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, total - LENGTH + 1), SLICE):
        piece = data[at : at + SLICE + LENGTH - 1]
        gram = ranks(piece, GRAM)
        place = np.arange(len(gram), dtype=np.uint64)
        owner = (least((gram >> _U(21) << _U(21)) | place, WINDOW) & _U((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        size = np.diff(np.append(first, len(owner)))
        inside = owner[first] - first
        head = np.flatnonzero(~_again(piece, gram[owner[first]], first, size, inside))
        count = np.diff(np.append(head, len(first)))
        first, size, inside = first[head], size[head], inside[head]
        ends = first + size + LENGTH - 1
        block = np.fromiter((xxhash.xxh3_64_intdigest(text[at + a : at + b], seed=k) for a, b, k in zip(first.tolist(), ends.tolist(), inside.tolist(), strict=True)), _U, len(first))
        parts.append((gram[owner[first]], block, first + at, size, count))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _again(piece: np.ndarray, gram: np.ndarray, first: np.ndarray, size: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether an anchor has the block of the one before: the same gram as far from its place, as many windows, and bytes that repeat after so many."""
    out = np.zeros(len(first), bool)
    alike = 1 + np.flatnonzero((gram[1:] == gram[:-1]) & (size[1:] == size[:-1]) & (inside[1:] == inside[:-1]) & (size[1:] <= GRAM))
    for period in np.unique(size[alike]).tolist():
        own = alike[size[alike] == period]
        differ = np.append(0, np.cumsum(piece[period:] != piece[:-period]))
        before = first[own] - period
        out[own] = differ[before + period + LENGTH - 1] == differ[before]
    return out
