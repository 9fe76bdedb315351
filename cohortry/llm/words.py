"""Word and n-gram hashes of whole Arrow columns, vectorised over blocks of documents.

A word is a longest run of bytes outside ``[\x20\x09-\x0D]``.  Its hash is a polynomial over GF-free 64-bit
arithmetic (a random value for each byte, an odd multiplier for each place), mixed at the end; n-gram hashes
combine word hashes.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20250101))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _place(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _PLACE, np.uint64))])
    return _powers


def hash_runs(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes; the runs follow one another in data and none is empty."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lens) - lens
    place = np.arange(len(data)) - np.repeat(starts, lens)
    return mix(np.add.reduceat(_BYTE[data] * _place(int(lens.max()))[place], starts))


class Words:
    """Words of a block: hash, document, and byte span in data; first[d]:first[d+1] are those of document d."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool):
        """ends: where each document ends in data."""
        n = len(ends)
        self.data, self.n = (_LOWER[data] if lower else data), n
        self.bounds = np.concatenate([[0], ends]).astype(np.int64)
        word = ~SPACE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.bounds] = True
        prev = np.concatenate([[False], word[:-1]]) if len(word) else word
        start = np.flatnonzero(word & (~prev | edge[:-1]))
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.start, self.end, self.lens = start, end, end - start
        self.first = np.searchsorted(start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self.hash = hash_runs(self.data[word], self.lens)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of its first word) of every n-word window that lies in one document."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:m].copy()
        for k in range(1, n):
            h = h * _GRAM + self.hash[k : m + k]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(h[at] + np.uint64(n)), at

    def whole(self, d: int) -> np.uint64:
        """Hash of all words of a document as one sequence."""
        h = self.hash[self.first[d] : self.first[d + 1]]
        out = h[:1].copy()
        for x in h[1:]:
            out = out * _GRAM + x
        return mix(out + np.uint64(len(h)))[0]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(texts: pa.Array, lower: bool = False, block_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of successive blocks; a document is never split."""
    data, offsets = buffers(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right"))
        hi = min(max(hi - 1, lo + 1), n)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo], lower)
        lo = hi


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values within each [bounds[i], bounds[i+1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
