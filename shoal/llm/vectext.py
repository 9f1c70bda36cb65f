"""Words of many texts at once, on Arrow's own byte buffers.

A word is a run of bytes other than space and \\x09-\\x0D, as in the pattern
``[^\\x20\\x09-\\x0D]+``. Word hashes are sums of byte values times powers of an odd number
mod 2^64, taken from running sums, so any run of words, too, is hashed in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; temporary arrays take up to eighty times as much.
BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Two independent tables of byte values.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the splitmix64 finaliser); a new array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = int(_ODD)
    return _powers(1 << max(16, (n - 1).bit_length()), pow(base, -1, 1 << 64) if inverse else base)[:n]


class RunHash:
    """Hashes of the runs values[i:j], each from two running sums."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(max(1, len(values)))[: len(values)], dtype=np.uint64, out=self.sums[1:])
        self.back = powers(len(values) + 1, inverse=True)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and, for row i, their bounds offsets[i] and offsets[i + 1]; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices whose texts have about ``size`` bytes (a longer text alone)."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's bounds in that list."""
    seen = ~SPACE[data]
    first, last = seen.copy(), seen.copy()
    first[1:] &= ~seen[:-1]
    last[:-1] &= ~seen[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = seen[edges]
    last[edges - 1] = seen[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, in slices so that a very long text needs no more memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low = starts[at]
        part = RunHash(_BYTES[table][data[low : ends[to - 1]]])
        out[at:to] = part.runs(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def word_counts(column: pa.Array) -> np.ndarray:
    return np.diff(word_spans(*utf8(column))[2])
