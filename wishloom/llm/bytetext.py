"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A block is one buffer with document offsets. Words and their 64-bit hashes
come from table look-ups and running sums, never from a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Words that end at ASCII white space only.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of ASCII letters, digits and every byte beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0"):ord("9") + 1] = ALNUM[ord("A"):ord("Z") + 1] = ALNUM[ord("a"):ord("z") + 1] = True
ALNUM[0x80:] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

HELD_POWERS = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents of about `limit` bytes: first, last + 1, bytes, offsets.

    A longer document is a block of its own.
    """
    buf, off = buffer_of(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def powers(n: int, base: np.uint64) -> np.ndarray:
    """Powers 0 to n, read-only; those of usual blocks are computed once per worker."""
    held = _POWERS.get(int(base))
    if held is None or len(held) <= n:
        out = np.full(max(n, min(2 * n, HELD_POWERS)) + 1, base, dtype=np.uint64)
        out[0] = 1
        held = np.cumprod(out, dtype=np.uint64)
        held.flags.writeable = False
        if n <= HELD_POWERS:
            _POWERS[int(base)] = held
    return held[:n + 1]


class Rolling:
    """Hashes of any stretch of a sequence in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        terms = (values.astype(np.uint64) + np.uint64(1)) * powers(n, BASE)[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.back = powers(n, BACK)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the document it is in."""
    inside = kind[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1])) if len(buf) else inside
    after = np.concatenate((inside[1:], [False])) if len(buf) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(LOWER[buf])(start, end)
