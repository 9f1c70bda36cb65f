"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from shoal.llm import vectext

_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1) for i in range(8)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


class Characters:
    """Lower-cased code points of texts, each between two spaces and closed by a 0."""

    def __init__(self, texts: list[str | None], letters_only: bool = False):
        joined = "".join(f" {(t or '').lower()} \0" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(points == 0)
        if len(ends) != len(texts):  # a text holds the character 0
            joined = "".join(f" {(t or '').lower().replace(chr(0), ' ')} \0" for t in texts)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.flatnonzero(points == 0)
        self.starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        self.ends = ends
        letter = _letters()[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
        sums = np.concatenate(([0], np.cumsum(letter)))
        self.letters = sums[ends] - sums[self.starts] if len(ends) else ends
        if letters_only:
            points = np.where(letter | (points == 0), points, np.uint32(0x20))
        self.points = points.astype(np.uint64)
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.append(self.starts, len(points)))) if len(texts) else ends

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of the n-gram at each place, and which places' n-grams lie in one text."""
        size = max(0, len(self.points) - n + 1)
        h = np.full(size, n, np.uint64)
        inside = np.ones(size, bool)
        for i in range(n):
            part = self.points[i : i + size]
            h += part * _ODD[i]
            inside &= part != 0
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - bits)).astype(np.int64), inside


def text_blocks(batch, column: int, size: int = vectext.BLOCK):
    """Slices of a batch with about ``size`` bytes of text."""
    return vectext.blocks(iter([batch]), column, size)
