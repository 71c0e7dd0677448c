"""Vectorised work on the bytes of many texts at once.

A column of strings is one byte array with offsets. Tokens are runs of bytes of one class;
they are hashed together by prefix sums of a polynomial modulo 2**64 and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Class 0 separates: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK_SEPARATED = np.ones(256, dtype=np.uint8)
BLANK_SEPARATED[[9, 10, 11, 12, 13, 32]] = 0


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; NULL is empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows in slices of about ``target`` bytes: first row, end row, bytes, offsets.
    A row longer than that is a slice of its own."""
    data, offsets = column(array)
    low = 0
    while low < len(array):
        high = int(np.searchsorted(offsets, offsets[low] + target, side="right")) - 1
        high = min(max(high, low + 1), len(array))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero class inside a row."""
    n = len(classes)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = classes[at[:-1]] != 0
    return at[:-1][keep], at[1:][keep]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Powers:
    """Powers of the hash base and of its inverse. Those of up to ``KEPT`` bytes are remembered,
    16 bytes of memory for each; a longer text gets its own, which go with it."""

    KEPT = 1 << 21

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _made(size: int) -> list[np.ndarray]:
        return [
            np.concatenate([[_U(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
            for b in (_BASE, _INVERSE)
        ]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            up, down = self._made(n)
            return up, down
        if len(self.up) < n:
            self.up, self.down = self._made(min(self.KEPT, max(n, 2 * len(self.up))))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every run."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of every row's runs in the list of runs."""
    return np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive runs inside a row, and the offsets of every row's.
    A shorter row has none."""
    count = np.diff(rows)
    kept = np.maximum(count - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(kept)])
    n = len(hashes) - width + 1
    if n <= 0 or not out[-1]:
        return np.empty(0, np.uint64), out
    h = np.full(n, _U(width))
    for i in range(width):
        h = mix(h * _U(0x9FB21C651E98DF25) + hashes[i : i + n])
    return h[spread(rows[:-1], kept)], out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every row, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct word shingles of every row: words between blanks, A-Z lowered.
    A row with fewer words has them all as one shingle; without words the set is empty."""
    data = LOWER[data]
    starts, ends = runs(BLANK_SEPARATED[data], offsets)
    hashes, rows = hash_runs(data, starts, ends), rows_of(starts, offsets)
    wide, out = grams(hashes, rows, width)
    sets = []
    for i in range(len(offsets) - 1):
        have = rows[i + 1] - rows[i]
        if have >= width:
            sets.append(np.unique(wide[out[i] : out[i + 1]]))
        elif have:
            sets.append(grams(hashes[rows[i] : rows[i + 1]], np.array([0, have]), have)[0])
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
