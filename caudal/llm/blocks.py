"""Bounded blocks of texts and whole-block word arithmetic for Arrow functions.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Functions here work on all words
of a block at once with numpy, so a block's size (``BLOCK_BYTES``) bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def blocks(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` text bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text begins (one more entry closes the last)."""
    array = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | opens[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | opens[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up = np.full(size, base, np.uint64)
    down = np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Runs:
    """Hashes of any runs of a sequence of 64-bit values, from one prefix sum.

    The hash of a run depends on its values and their order, not on where it stands.
    """

    def __init__(self, values: np.ndarray, base: int = _ODD) -> None:
        size = 1 << max(12, int(len(values)).bit_length())
        self.up, self.down = _powers(base & _MASK | 1, size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(total ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1):
    """A 64-bit hash of every word."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F * seed & _MASK))
    return Runs(table[data]).of(starts, ends)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
