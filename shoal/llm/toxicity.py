"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams, taken over all of it. The ratio of a feature is the
log of its smoothed frequency in toxic over that in other labelled texts; the features with
the strongest association are kept, scaled by their ratio, and weighed by a regularised
logistic regression. It learns from a bounded sample of labelled rows (``rows``, the ones
with the least hash of their id); counting features is a grouped aggregation, and only the
kept features of the sample come to the driver. Scoring is one scan with a small broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.chartext import Characters, text_blocks
from shoal.llm.spread import settled


@dataclass(frozen=True)
class ToxicityTraining:
    """``rows`` bounds the sample of labelled rows, ``features`` what is kept of 2^bits buckets.

    ``toxic_weight`` is what a toxic row counts for, since few rows are. ``rounds`` and
    ``precise`` (the largest part of the gradient) end the regression.
    """

    rows: int = 30_000
    features: int = 4_000
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    smoothing: float = 1.0
    penalty: float = 3.0
    toxic_weight: float = 3.0
    rounds: int = 100
    precise: float = 1e-4

    def __post_init__(self):
        if not 0 < self.features < 1 << 16:
            raise ValueError("features must be from 1 to 65535")


@dataclass(frozen=True)
class ToxicityModel:
    sizes: tuple[int, ...]
    bits: int
    features: np.ndarray
    weights: np.ndarray
    bias: float


def _found(texts: list[str | None], sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None):
    """Distinct (row, bucket) of the texts, sorted; only wanted buckets if given (a mask)."""
    c = Characters(texts)
    rows, buckets = [], []
    for n in sizes:
        h, inside = c.grams(n, bits)
        at = np.flatnonzero(inside if wanted is None else inside & wanted[h])
        rows.append(c.row[at])
        buckets.append(h[at])
    both = np.unique((np.concatenate(rows) << bits) | np.concatenate(buckets))
    return both >> bits, both & ((1 << bits) - 1)


def _sample(docs: DataFrame, labels: DataFrame, how: ToxicityTraining) -> DataFrame:
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = named.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "toxic").limit(how.rows)
    # At most ``rows`` rows of two numbers.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, mod 5, is 0; so for a null id."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, how: ToxicityTraining | None = None) -> ToxicityModel:
    """Learns from ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text), held-out rows aside.

    Null labels and ids are left out; a null text counts as empty, a long one whole. A row that
    is repeated in either table, or labelled in several ways, counts each time. Without labels
    of both kinds, or with an empty table, the model has no features and its bias is the
    smoothed log ratio of toxic to other rows.
    """
    how = how or ToxicityTraining()
    sample = settled(_sample(docs, labels, how))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << how.bits), np.int32)
        for batch in batches:
            for b in text_blocks(batch, 1):
                toxic = b.column(2).to_numpy()
                row, bucket = _found(b.column(1).to_pylist(), how.sizes, how.bits, None)
                for kind in (0, 1):
                    totals[kind] += np.bincount(bucket[toxic[row] == kind], minlength=1 << how.bits).astype(np.int32)
        at = np.flatnonzero(totals.any(axis=0))
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            arrays = [pa.array(part), pa.array(totals[1, part].astype(np.int64)), pa.array(totals[0, part].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "p", "q"])

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    prior = float(np.log((bad + 1) / (good + 1)))
    if not bad or not good:
        return ToxicityModel(how.sizes, how.bits, np.zeros(0, np.int64), np.zeros(0, np.float32), prior)
    counts = sample.mapInArrow(counted, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    # The chi-square of presence against the label ranks the features; ties by bucket.
    a, b = F.col("p").cast("double"), F.col("q").cast("double")
    spread = (a + b) * (bad + good - a - b)
    chi = F.when(spread > 0, (a * (good - b) - b * (bad - a)) ** 2 * (bad + good) / (spread * bad * good)).otherwise(0.0)
    top = counts.where("p + q >= 3").withColumn("chi", chi).orderBy(F.desc("chi"), "bucket").limit(how.features).collect()
    features = np.array(sorted((r["bucket"] for r in top)), np.int64)
    p = {r["bucket"]: (r["p"], r["q"]) for r in top}
    present = np.array([p[f] for f in features.tolist()], np.float64).reshape(-1, 2)
    frequency = (present + how.smoothing) / (np.array([bad, good]) + 2 * how.smoothing)
    ratio = np.log(frequency[:, 0] / frequency[:, 1])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << how.bits, bool)
        wanted[features] = True
        for batch in batches:
            for b in text_blocks(batch, 1):
                row, bucket = _found(b.column(1).to_pylist(), how.sizes, how.bits, wanted)
                at = np.searchsorted(features, bucket).astype(np.uint16)
                ends = pa.py_buffer((np.searchsorted(row, np.arange(b.num_rows + 1)) * 2).astype(np.int32))
                blobs = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(at.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), blobs], names=["doc_id", "toxic", "found"])

    rows = sample.mapInArrow(kept, "doc_id long, toxic int, found binary").orderBy("doc_id", "toxic", "found").collect()
    y = np.array([r["toxic"] for r in rows], np.float64)
    parts = [np.frombuffer(r["found"], np.uint16) for r in rows]
    weights, bias = _regression(parts, y, ratio, prior, how)
    keep = weights != 0
    return ToxicityModel(how.sizes, how.bits, features[keep], (weights * ratio)[keep].astype(np.float32), bias)


def _regression(parts: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, how: ToxicityTraining):
    """Logistic regression on presence times ratio, L2-regularised (the bias aside).

    The loss is convex; it is minimised by L-BFGS over all rows.
    """
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    column = np.concatenate(parts).astype(np.int64)
    value, n = ratio[column], len(y)
    cost = np.where(y == 1, how.toxic_weight, 1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias = x[:-1], x[-1]
        z = bias + np.bincount(row, w[column] * value, n)
        off = cost * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gradient = np.append(np.bincount(column, off[row] * value, len(ratio)) + how.penalty * w, off.sum())
        total = (cost * (np.logaddexp(0, z) - y * z)).sum() + how.penalty * (w @ w) / 2
        return total / n, gradient / n

    x = minimised(loss, np.append(np.zeros(len(ratio)), prior), how.rounds, how.precise)
    return x[:-1], float(x[-1])


def minimised(loss, x: np.ndarray, rounds: int, precise: float, memory: int = 10) -> np.ndarray:
    """L-BFGS: the curvature comes from the last ``memory`` steps; steps halve until they pay."""
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() <= precise:
            break
        move, weights = gradient.copy(), []
        for s, g, r in reversed(steps):
            a = r * (s @ move)
            weights.append(a)
            move -= a * g
        if steps:
            s, g, r = steps[-1]
            move *= 1 / (r * (g @ g))
        for (s, g, r), a in zip(steps, reversed(weights), strict=True):
            move += s * (a - r * (g @ move))
        slope = gradient @ move
        if slope <= 0:
            move, slope, steps = gradient.copy(), gradient @ gradient, []
        length = 1.0
        while True:
            new = x - length * move
            new_value, new_gradient = loss(new)
            if new_value <= value - 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-12:
                return x
        s, g = new - x, new_gradient - gradient
        if s @ g > 1e-14:
            steps = [*steps, (s, g, 1 / (s @ g))][-memory:]
        x, value, gradient = new, new_value, new_gradient
    return x


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    A text is scored whole, however long; a null one as an empty one. Rows are scored as they
    come, repeated ones and those without an id too. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights))
    sizes, bits, bias = model.sizes, model.bits, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = shared.value
        table = np.zeros(1 << bits, np.float64)
        table[features] = weights
        wanted = np.zeros(1 << bits, bool)
        wanted[features] = True
        for batch in batches:
            for b in text_blocks(batch, 2):
                row, bucket = _found(b.column(2).to_pylist(), sizes, bits, wanted)
                z = bias + np.bincount(row, table[bucket], b.num_rows)
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                arrays = [b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
