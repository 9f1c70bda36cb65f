"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into blocks (see ``vectors``), and those of a block into buckets
of descending length. For a query with the score t of its k-th best so far, a bucket whose
greatest length is l can only hold better vectors with a cosine of at least t / (|q| l):
above 1, the bucket and all after it are done with. Otherwise the bucket's local threshold
decides how to prune: by length when it is low (the vectors long enough to reach t at all),
by coordinates when it is high (the ranges that a unit vector must lie in along the query's
largest coordinates). Only what remains is multiplied, in exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.vectors import answers, nearest_copies, searched, usable

BUCKET = 1_024
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.5
FOCUS = 4
#: Vectors in a block, about.
BLOCK = 8_192
_SAFE = float(1 << 53)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where every partial sum is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < _SAFE:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = queries.astype(object) @ vectors.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class NormBuckets:
    """A block's vectors in buckets of descending length. ``computed`` of ``possible`` products
    were made so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: int, bucket: int = BUCKET):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths, self.top = ids[order], vectors[order], lengths[order], top
        self.starts = range(0, len(ids), bucket)
        self.bucket = bucket
        # By coordinate, so that a coordinate's values are read in one run.
        self.unit = (self.vectors / np.maximum(self.lengths, 1e-300)[:, None]).T.copy()
        self.most = float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        self.real = self.vectors.astype(np.float64)
        self.computed = self.possible = 0

    def __call__(self, queries: np.ndarray, bounds: np.ndarray):
        """(query index, id, score) of each query's best ``top`` that reach its bound (NaN: none)."""
        out = [self._answer(q, bound) for q, bound in zip(queries, bounds.tolist(), strict=True)]
        at = np.repeat(np.arange(len(out)), [len(ids) for ids, _ in out])
        return at, np.concatenate([ids for ids, _ in out]), np.concatenate([score for _, score in out])

    def _answer(self, query: np.ndarray, bound: float):
        asked = query.astype(np.float64)
        norm = float(np.sqrt((asked**2).sum()))
        plain = self.most * float(np.abs(asked).max(initial=0)) < _SAFE
        unit = asked / max(norm, 1e-300)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        threshold = -np.inf if np.isnan(bound) else bound
        self.possible += len(self.ids)
        for first in self.starts:
            rows: slice | np.ndarray = slice(first, first + self.bucket)
            if threshold > 0:
                # A hair below, since lengths are rounded; equal scores still count.
                need = threshold / max(norm, 1e-300) * (1 - 1e-9)
                if need > self.lengths[first]:
                    break
                long_enough = int(np.searchsorted(-self.lengths[rows], -need, "right"))
                rows = slice(first, first + long_enough)
                cosine = need / self.lengths[first]
                if cosine >= COORDINATE_FROM:
                    rows = first + np.flatnonzero(self._inside(rows, unit, focus, min(1.0, cosine)))
            if plain:
                found = (self.real[rows] @ asked).astype(np.int64)
            else:
                found = _products(query[None], self.vectors[rows])[0]
            self.computed += len(found)
            hit = np.flatnonzero(found >= threshold)
            if len(hit):
                ids, score = np.concatenate((ids, self.ids[rows][hit])), np.concatenate((score, found[hit]))
                best = np.lexsort((ids, -score))[: self.top]
                ids, score = ids[best], score[best]
                if len(ids) == self.top:
                    threshold = max(threshold, float(score[-1]))
        return ids, score

    def _inside(self, rows: slice, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Which unit vectors can have that cosine, by their largest-weighted coordinates.

        At an angle up to arccos(cosine) from the query, coordinate f of a unit vector lies
        between x * cosine -+ sin * sqrt(1 - x^2), x being the query's; the side that x itself
        points to is open if the query's own axis is within that angle.
        """
        sine = np.sqrt(max(0.0, 1 - cosine * cosine))
        inside = np.ones(rows.stop - rows.start, bool)
        for f in focus.tolist():
            x, values = float(unit[f]), self.unit[f, rows]
            reach = sine * np.sqrt(max(0.0, 1 - x * x)) + 1e-9
            if x > -cosine:
                inside &= values >= x * cosine - reach
            if x < cosine:
                inside &= values <= x * cosine + reach
        return inside


def bucketed(top: int):
    return lambda ids, vectors, seeds: NormBuckets(ids, vectors, top)


def top_products(vectors: DataFrame, every: int, top: int, scale: float = 256.0, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` greatest integer products of each query.

    Components become floor(scale * x); queries are the rows whose id ``every`` divides,
    candidates every other row of the same dimension. Ties go to smaller ids. Null vectors
    and those with a null or non-finite component take no part, nor do rows without an id;
    rows that repeat an id are one if their vectors are equal, else both count. Scores beyond
    64 bits are clipped to them. An empty table gives no rows.
    """
    integers = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = good.select(F.col(id_col).cast("long").alias("vec_id"), integers.alias("v")).distinct()
    base = nearest_copies(rows, top + 1)
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = asked.groupBy("v").agg(F.min("query_id").alias("q"))
    found = searched(base, queries, top + 1, _products, bucketed(top + 1), pa.int64(), 0.0, BLOCK)
    return answers(found, queries, asked, top)
