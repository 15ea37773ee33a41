"""Words and shingles of whole Arrow batches of texts, as NumPy arrays.

A word is a longest run of ASCII digits, ASCII letters (A-Z read as a-z) and
characters beyond ASCII.  In UTF-8 every byte of the last kind is 128 or more,
so words, their hashes and those of their shingles come from byte tables and
running sums over the texts of a batch side by side, without a loop over texts
or words.  Hashes are 64-bit and only choose candidates; whoever uses them
compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18  # texts handled at once; one longer text is a piece by itself
STRETCH_BYTES = 1 << 18  # bytes hashed at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: its powers never vanish


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.where(_IS_WORD, mix(np.arange(1, 257, dtype=np.uint64) * _STEP), np.uint64(0))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_STEP), pow(int(_STEP), -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse."""
    up, down = _powers(max(STRETCH_BYTES, 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


@dataclass
class Words:
    """Words of some texts: text i has words ``first[i]`` to ``first[i + 1]``;
    word j is ``data[start[j]:end[j]]``."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        out, lo, n = [np.zeros(0, np.uint64)], 0, len(self.start)
        while lo < n:  # a long text goes in stretches of whole words
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, base + STRETCH_BYTES, "right")))
            begin, until = self.start[lo:hi] - base, int(self.end[hi - 1] - base)
            power, inverse = powers(until)
            value = _BYTE[self.data[base:base + until]]
            value *= power
            size = (self.end[lo:hi] - self.start[lo:hi]).astype(np.uint64)
            # bytes between words are 0, so a sum may run on to the next word
            out.append(mix(np.add.reduceat(value, begin) * inverse[begin] + size * _STEP))
            lo = hi
        return np.concatenate(out)

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every run of ``k`` words inside one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.full(n, k, np.uint64)
        for j, p in enumerate(powers(k + 1)[0][1:]):
            total += hashes[j:j + n] * p
        last = np.repeat(self.first[1:], np.diff(self.first))
        word = np.flatnonzero(np.arange(n) + k <= last[:n])
        return word, mix(total[word])

    def text(self, begin: int, end: int) -> str:
        """The words ``begin`` to ``end`` joined by blanks."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(
            self.start[begin:end].tolist(), self.end[begin:end].tolist())).decode()


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = _LOWER[data]
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False])) if len(data) else word
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(data, np.searchsorted(start, offsets), start, end)


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of stretches of a string array of texts
    without nulls, each of about ``most`` bytes."""
    n = len(texts)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, buffer = texts.buffers()
    offsets = np.frombuffer(where, kind, n + 1, texts.offset * kind().itemsize).astype(np.int64)
    every = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, words_of(every[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi
