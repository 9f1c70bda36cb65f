"""Connected components of an edge list, by alternating star contractions.

Each round rewrites the edges so that every node points to smaller ones: the large step sends
a node's larger neighbours to its smallest, the small step sends the smaller ones there. The
rounds end when the edges are stars around their components' smallest nodes; their number
grows with the logarithm of the component size. A union-find inside each partition contracts
the edges first. No node's neighbour list is ever gathered: minima are partial aggregates
and the rewriting is a join, which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(nodes))
    left, right = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as stars; self-loops stay, so that every node remains."""
    for b in batches:
        if b.num_rows:
            nodes, roots = union_find(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches' edges at once to nodes and roots."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, roots = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))


def connected_components(edges: DataFrame, src: str, dst: str, settled, alone: int = 0) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can reach.

    ``edges`` has two long columns; direction, repeats and self-loops don't matter, rows with
    a null end are left out. ``settled`` cuts lineage (a checkpoint in shared storage). An
    empty edge list gives no rows. Up to ``alone`` edges, after the first contraction, are
    finished by one task's union-find; the result is the same.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()
    state = pairs.mapInArrow(_contracted, "u long, v long").distinct()
    loops = state = settled(state)
    if alone and state.limit(alone + 1).count() <= alone:
        one = state.coalesce(1).mapInArrow(_together, "node long, component long")
        return one
    state = state.where("u <> v")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = state.union(state.select("v", "u")).distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both.where("v > u"), least)
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least).union(least.select("u", F.col("m").alias("v")))
        state = settled(small.where("u <> v").distinct())
        sums = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError("components did not settle")
    roots = loops.select(F.col("v").alias("node")).union(loops.select("u")).distinct()
    return roots.join(state.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
