"""Vectorised words and word-window hashes over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; on UTF-8 this
equals the code-point rule, as those bytes never occur inside a longer sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55  # odd
_POW = np.array([1], np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 256), _BASE, np.uint64)
            steps[0] = 1
            _POW = np.multiply.accumulate(steps)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of rows i..j of a batch: start, end (byte offsets in raw), row (from 0), hash, and first[r]..first[r+1] per row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        n = len(raw)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(self.rows + 1, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        solid = ~_SPACE[raw]
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = ~solid[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        edge[cuts] = True  # a text's first byte starts a word though no space is before it
        self.start = np.flatnonzero(solid & edge)
        stop = np.empty(n, bool)
        stop[-1] = True
        stop[:-1] = ~solid[1:]
        stop[cuts - 1] = True
        self.end = np.flatnonzero(solid & stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        length = self.end - self.start
        if not len(length):
            self.hash = np.zeros(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            text = (_LOWER[raw] if lower else raw)[solid].astype(np.uint64) + np.uint64(1)
            begin = np.cumsum(length) - length
            place = np.arange(len(text)) - np.repeat(begin, length)
            self.hash = mix(np.add.reduceat(text * _powers(int(length.max()))[place], begin) + length.astype(np.uint64))

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, word index) of every run of k words inside one row."""
        return windows(self.hash, self.first, k)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    per = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(per)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + first[:-1][row]
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        step = _powers(k + 1)
        for j in range(k):
            total += h[at + j] * step[k - j]
    return mix(total), row, at


def per_chunk(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of rows i..j) in pieces of bounded size."""
    raw, offsets = buffers(texts)
    for i, j in chunks(offsets):
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
