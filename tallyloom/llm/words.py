"""Vectorised word and shingle hashes of text columns.

Texts are bytes; A-Z count as a-z; words are maximal runs of bytes other than ASCII white space.  A word's hash
is the sum of its bytes' random 64-bit values times powers of an odd constant, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def random_values(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BASE = _U(0x100000001B3 * 2 + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = random_values(256, 11)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        _powers = np.concatenate(([_U(1)], np.full(size - 1, _BASE))).cumprod(dtype=np.uint64)
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls, without copying the bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _hash_piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of ``data``; a cut always ends a word."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = cuts[cuts < len(data)]
    start[inner] = ~space[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    spans = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = _VALUE[data[starts[0] :]] * _power(int(spans.max()))[at]
    sums = np.add.reduceat(values, starts - starts[0])
    sizes = np.add.reduceat(~space[starts[0] :], starts - starts[0], dtype=np.int64)
    return starts, mix(sums + sizes.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, their end positions by text): text i has hashes[ends[i]:ends[i + 1]]."""
    starts, hashes, at, n = [], [], 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not _SPACE[data[to]]:  # pieces end at white space, however long a word is
            near = np.flatnonzero(_SPACE[data[to : to + PIECE]])
            to = to + int(near[0]) if len(near) else min(n, to + PIECE)
        inside = offsets[(offsets >= at) & (offsets < to)] - at
        s, h = _hash_piece(data[at:to], inside)
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, sorted; of fewer words the whole sequence is one; none of none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    weights = random_values(size, 77) | _U(1)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += mix(words[j : n - k + 1 + j] + weights[j]) * weights[j]
    return np.unique(mix(h + _U(k)))


def each_text_words(column: pa.Array) -> Iterator[np.ndarray]:
    hashes, ends = word_hashes(*text_buffer(column))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield hashes[a:b]
