"""Hashes of byte spans and of words in numpy, for whole batches of text at once."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
MOST_SPARE = 1 << 18  # powers made ahead of need


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & _MASK)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def letters(seed: int = 0) -> np.ndarray:
    """A random number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE), seed)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, min(2 * len(cls.up), MOST_SPARE), 1 << 16)
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, out=powers))
        return cls.up[:n], cls.down[:n]


class Prefix:
    """Polynomial prefix hashes of a byte array: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        up, self.down = Powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = self.sums[1:]  # made in place: a batch's memory is a few times these 8 bytes a byte
        np.take(letters(seed), data, out=terms, mode="clip")
        terms *= up[: len(data)]
        np.cumsum(terms, out=terms)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words `[^\\x20\\x09-\\x0D]+`; no word crosses a row."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    before = np.r_[False, solid[:-1]] if len(data) else solid
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.r_[solid[1:], False] if len(data) else solid
    stops = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, stops, np.searchsorted(ends, starts, side="right") - 1


def shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the distinct word shingles of every row, sorted by both.

    Letters A-Z count as a-z. A row with fewer words than `size` has its whole sequence as one shingle,
    one without words none.
    """
    data = LOWER[data]
    starts, stops, rows = words(data, ends)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = mix(Prefix(data).spans(starts, stops))
    per_row = np.bincount(rows, minlength=len(ends) - 1)
    first = np.cumsum(per_row) - per_row
    left = per_row[rows] - (np.arange(len(rows)) - first[rows])
    begins = np.flatnonzero((left >= size) | ((per_row[rows] < size) & (left == per_row[rows])))
    value = np.zeros(len(begins), np.uint64)
    for k in range(size):
        there = begins + k
        held = left[begins] > k
        part = mix(codes[np.minimum(there, len(codes) - 1)], 2 * k + 3)
        value += np.where(held, part, np.uint64(0))
    value, row = mix(value), rows[begins]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    return row[new], value[new]
