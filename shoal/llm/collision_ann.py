"""Approximate nearest neighbours by collision counting over query-aware windows.

Each hash function is one random projection, kept as a sorted array of all vectors' values.
A query's bucket is not a fixed cell but a window centred on its own value. Two vectors
collide if one lies in the other's window; a vector that collides in at least a given number
of functions becomes a candidate and is verified by its exact score. Virtual rehashing widens
the windows step by step: the arrays stay as they are, and only the entries that a step adds
on both sides of a window are counted (a step that adds a large part of all is counted anew). It ends once the windows are so wide that a vector
nearer than the answers so far would have collided often enough.

Largest inner products become nearest neighbours by one more component that lifts all
vectors to the same length; queries have 0 there. Lest that component drown the others, blocks
hold vectors of similar length (see ``vectors``) and are cut into parts of still more similar
length, each lifted to its own greatest. A query meets the longest part first and is done once
no vector of a part is long enough for a better answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.vectors import answers, best_each, nearest_copies, searched, usable

#: Vectors in a block, about.
BLOCK = 16_384


@dataclass(frozen=True)
class CollisionHashing:
    """``functions`` projections; collisions in ``threshold`` of them make a candidate.

    Windows end at the half width at which a vector as near as the worst answer so far collides
    with probability ``likely`` in each function. They start at ``start`` times the width that
    the score known beforehand asks for and grow by ``growth`` a step, no further than the
    answers so far ask for. A part's lengths differ
    by a factor of ``spread`` at most, unless it has under ``floor`` times the answers asked
    for: all of such a part are verified.
    """

    functions: int = 96
    threshold: int = 68
    likely: float = 0.75
    start: float = 0.5
    growth: float = 1.25
    floor: int = 8
    spread: float = 1.15
    seed: int = 11

    def __post_init__(self):
        if not 0 < self.threshold <= self.functions or not 0 < self.likely < 1 or not 0 < self.start <= 1 < self.growth:
            raise ValueError("threshold, likely, start or growth out of range")

    @property
    def reach(self) -> float:
        """Half width of a window in units of the distance that it is to cover."""
        return NormalDist().inv_cdf((1 + self.likely) / 2)


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, summed in component order."""
    total = np.zeros(len(vectors))
    for i, x in enumerate(query.tolist()):
        total += x * vectors[:, i]
    return total


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    return (np.sqrt(((vectors / largest) ** 2).sum(axis=1, keepdims=True)) * largest)[:, 0]


def parts_of(lengths: np.ndarray, spread: float, least: int) -> list[slice]:
    """Descending lengths cut where they fall by ``spread``; a part has ``least`` rows, the last maybe fewer."""
    out, first = [], 0
    while first < len(lengths):
        end = int(np.searchsorted(-lengths, -lengths[first] / spread, "right"))
        end = min(len(lengths), max(end, first + least))
        out.append(slice(first, end))
        first = end
    return out


#: A step that adds more than this part of all entries is counted on the vectors' ranks, those
#: of so many functions at a time.
WIDE, SWEPT = 0.125, 16

#: What sets the functions' sorted arrays apart in one long array; projections stay far below.
_APART = 64.0


class SortedProjections:
    """The sorted arrays of one part, end to end, and what each entry's vector is."""

    def __init__(self, vectors: np.ndarray, longest: float, how: CollisionHashing):
        n, d = vectors.shape
        lines = np.random.default_rng([how.seed, d]).standard_normal((d + 1, how.functions))
        # Scaled, lest squares overflow.
        scaled = vectors / longest
        lift = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
        values = np.hstack((scaled, lift[:, None])) @ lines
        self.n, self.lines, self.offsets = n, lines[:-1], _APART * np.arange(how.functions)
        order = np.argsort(values, axis=0, kind="stable").T
        self.vector = order.ravel()
        self.value = (np.take_along_axis(values, order.T, axis=0).T + self.offsets[:, None]).ravel()
        self.first = n * np.arange(how.functions)
        self.rank = np.empty(order.shape, np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=self.rank.dtype)[None, :], axis=1)
        # Used again by every query: fresh memory costs more than what is done in it.
        self._entries = np.empty(int(WIDE * order.size), order.dtype)
        self._past, self._inside = np.empty_like(self.rank[:SWEPT]), np.empty((SWEPT, n), bool)

    def centre(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.lines + self.offsets

    def places(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.value, values)

    def widened(self, counts: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, high: np.ndarray) -> int:
        """Adds to ``counts`` what the windows first:last gain as low:high; how many entries that is.

        Few entries are walked. Of many, it takes less to look at all ranks in one sweep for
        those in the windows.
        """
        added = int((first - low).sum() + (high - last).sum())
        if added <= len(self._entries):
            entries = [self.vector[a:z] for a, z in zip(low.tolist(), first.tolist(), strict=True)]
            entries += [self.vector[a:z] for a, z in zip(last.tolist(), high.tolist(), strict=True)]
            counts += np.bincount(np.concatenate(entries, out=self._entries[:added]), minlength=self.n)
        else:
            kind = self.rank.dtype
            start, size = (low - self.first).astype(kind)[:, None], (high - low).astype(kind)[:, None]
            counts[:] = 0
            for i in range(0, len(size), SWEPT):
                to = slice(i, i + SWEPT)
                # Unsigned: what lies before the start is past the end.
                past = np.subtract(self.rank[to], start[to], out=self._past[: len(size[to])])
                inside = np.less(past, size[to], out=self._inside[: len(past)])
                counts += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return added


class CollisionIndex:
    """A block's vectors, indexed part by part. ``touched`` array entries were counted and
    ``verified`` vectors scored so far, for ``asked`` (query, vector) pairs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seeds: np.ndarray, top: int, how: CollisionHashing):
        lengths = lengths_of(vectors)
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self.seeds, self.top, self.how = seeds[order], top, how
        self.parts = parts_of(self.lengths, how.spread, how.floor * top)
        small = how.floor * top
        self.index = [SortedProjections(self.vectors[p], self.lengths[p.start], how) if p.stop - p.start > small else None for p in self.parts]
        self._rows = np.empty_like(self.vectors)
        self.touched = self.verified = self.asked = 0

    def __call__(self, queries: np.ndarray, bounds: np.ndarray):
        norms = lengths_of(queries)
        out = [self._answer(q, norm, bound) for q, norm, bound in zip(queries, norms.tolist(), bounds.tolist(), strict=True)]
        at = np.repeat(np.arange(len(out)), [len(found) for found, _ in out])
        found = np.concatenate([found for found, _ in out])
        return best_each(at, self.ids[found], np.concatenate([score for _, score in out]), self.top)

    def _answer(self, query: np.ndarray, norm: float, bound: float):
        """Places and exact scores of what is verified and may be among the best."""
        self.asked += len(self.ids)
        known = -np.inf if np.isnan(bound) else bound
        best = Best(self.top, known)
        unit = query / norm
        for part, index in zip(self.parts, self.index, strict=True):
            # A hair above, since lengths are rounded; equal scores still count.
            if norm * self.lengths[part.start] * (1 + 1e-9) < best.least:
                break
            if index is None:
                self._verify(query, np.arange(part.start, part.stop), best)
            else:
                self._widen(query, unit, norm * float(self.lengths[part.start]), part, index, best)
        return best.places, _exact(query, self.vectors[best.places])

    def _widen(self, query: np.ndarray, unit: np.ndarray, most: float, part: slice, index: SortedProjections, best: Best) -> None:
        how = self.how
        done = self.seeds[part].copy()
        self._verify(query, part.start + np.flatnonzero(done), best)
        counts = np.zeros(index.n, np.int64)
        centre = index.centre(unit)
        first = last = index.places(centre)
        half = how.start * self._needed(best, most)
        while True:
            wider = index.places(np.concatenate((centre - half, centre + half)))
            low, high = wider[: how.functions], wider[how.functions :]
            self.touched += index.widened(counts, low, first, last, high)
            new = (counts >= how.threshold) & ~done
            done |= new
            self._verify(query, part.start + np.flatnonzero(new), best)
            needed = self._needed(best, most)
            if half >= needed:
                return
            first, last = low, high
            half = min(half * how.growth, needed)

    def _needed(self, best: Best, most: float) -> float:
        """The half width at which a vector with the least score that counts is likely to collide."""
        cosine = best.least / most if best.least > -np.inf else -1.0
        return self.how.reach * float(np.sqrt(max(0.0, 2 - 2 * max(-1.0, cosine))))

    def _verify(self, query: np.ndarray, places: np.ndarray, best: Best) -> None:
        if len(places):
            self.verified += len(places)
            rows = np.take(self.vectors, places, axis=0, out=self._rows[: len(places)], mode="clip")
            best.add(places, rows @ query)


class Best:
    """The best ``top`` scores so far, with all that rounding could put among them."""

    def __init__(self, top: int, known: float):
        self.top, self.least = top, known
        self.places, self._scores = np.zeros(0, np.int64), np.zeros(0)

    def add(self, places: np.ndarray, scores: np.ndarray) -> None:
        near = scores >= self.least - self._slack(scores)
        self.places = np.concatenate((self.places, places[near]))
        self._scores = np.concatenate((self._scores, scores[near]))
        if len(self._scores) >= self.top:
            kth = float(np.partition(self._scores, -self.top)[-self.top])
            self.least = max(self.least, kth - self._slack(self._scores))
            keep = self._scores >= self.least - self._slack(self._scores)
            self.places, self._scores = self.places[keep], self._scores[keep]

    @staticmethod
    def _slack(scores: np.ndarray) -> float:
        return 1e-9 * max(1e-300, float(np.abs(scores).max(initial=0.0)))


def indexed(top: int, how: CollisionHashing):
    return lambda ids, vectors, seeds: CollisionIndex(ids, vectors, seeds, top, how)


def nearest(vectors: DataFrame, every: int, top: int, how: CollisionHashing | None = None, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: about the ``top`` greatest inner products of each query.

    Queries are the rows whose id ``every`` divides, candidates every other row of the same
    dimension; scores are exact, ties go to smaller ids. Vectors that are null, all zero or
    hold a null or non-finite component take no part, nor do rows without an id; rows that
    repeat an id are one if their vectors are equal, else both count. Every vector is
    indexed. An empty table gives no rows.
    """
    how = how or CollisionHashing()
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    good = vectors.where(usable(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x != 0) & F.col(id_col).isNotNull())
    rows = good.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("v")).distinct()
    base = nearest_copies(rows, top + 1)
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = asked.groupBy("v").agg(F.min("query_id").alias("q")).select("q", "v")
    found = searched(base, queries, top + 1, lambda q, v: q @ v.T, indexed(top + 1, how), pa.float64(), 1e-9, BLOCK)
    return answers(found, queries, asked, top)
