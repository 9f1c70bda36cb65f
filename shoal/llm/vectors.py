"""What the two vector searches share: blocks by length, queries that meet only blocks they
can gain from, merging of answers.

Base vectors are grouped by length, in ranges whose lengths differ by SPREAD at most, and the
ranges are cut into blocks. Each task holds one block and answers the queries sent to it as
they stream by. A fixed number of seed vectors gives every query a score that its answers
must reach; a query is sent to the blocks long enough for that score, which come first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.spread import settled

#: Bytes of the vectors in a block at most, about.
BLOCK_BYTES = 1 << 24
#: Queries that one task answers, about, where a block has more.
STREAM = 65_536
#: Queries a task is worth having for.
WORTH = 256
#: Lengths in a range differ by this factor at most. The lengths of doubles span 1490 in logs,
#: so there are some 31,000 ranges at most.
SPREAD = 1.05
#: Vectors that every query meets first: the longest, others by hash, and their bytes at most.
SEED_LONGEST, SEED_OTHERS, SEED_BYTES = 256, 1_024, 1 << 23
_ZERO = -(1 << 20)

Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (ids, vectors, seed mask) of a block to a function of (query vectors, bounds), which gives
#: (query index, id, score), some best ones of each query among those that reach its bound.
Build = Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], Found]]


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component present and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def nearest_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors (n, v), the ``keep`` rows with the smallest ids.

    Among equal vectors a search prefers smaller ids, so the others can't be in any answer of
    fewer than ``keep`` rows. The rank filter is applied in each task before the exchange.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    return vectors.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= keep).drop("_copy")


def with_log_length(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the log of the length of ``v`` as ``name``, null for a vector of zeros.

    Only where the squares' sum leaves the range of doubles are they scaled, element by element.
    """
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    plain = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    scaled = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / most) * (x.cast("double") / most))
    far = F.when(most > 0, F.ln(most) + F.ln(scaled) / 2)
    log = F.when(F.col("_sum").between(1e-200, 1e300), F.ln("_sum") / 2).otherwise(far)
    return rows.withColumn("_sum", plain).withColumn(name, log).drop("_sum")


def log_lengths(rows: np.ndarray) -> np.ndarray:
    most = np.abs(rows).max(axis=1, keepdims=True).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(most[:, 0]) + np.log(((rows / most) ** 2).sum(axis=1)) / 2
    return np.where(most[:, 0] > 0, logs, -np.inf)


@dataclass(frozen=True)
class Layout:
    """Length ranges in blocks: ``table`` has (range, first block, blocks); group g of ranges
    has vectors up to the log length ``limits[g]`` (descending) and ends at block ``ends[g]``."""

    table: list[tuple[int, int, int]]
    limits: np.ndarray
    ends: np.ndarray

    def reach(self, need: np.ndarray) -> np.ndarray:
        """How many blocks, from the first, may hold vectors of at least those log lengths."""
        groups = np.searchsorted(-self.limits, -(need - 1e-9), "right")
        return np.concatenate(([0], self.ends))[groups]


def layout(counts: list[tuple[int, int, float]], rows: int) -> Layout:
    """(range, vectors, greatest log length) to blocks of about ``rows``; small ranges share one."""
    groups: list[list] = []
    for r, n, longest in sorted(counts, reverse=True):
        if not groups or groups[-1][0] + n > 2 * rows:
            groups.append([0, longest, []])
        groups[-1][0] += n
        groups[-1][2].append(r)
    table, ends, first = [], [], 0
    for n, _, ranges in groups:
        blocks = max(1, -(-n // rows))
        table += [(r, first, blocks) for r in ranges]
        first += blocks
        ends.append(first)
    return Layout(table, np.array([g[1] for g in groups], float), np.array(ends, np.int64))


def _seeds(base: DataFrame, dimension: int) -> DataFrame:
    """A fixed number of vectors: the longest, and those with the least hash of their id."""
    most = max(16, SEED_BYTES // (8 * dimension))
    longest = base.orderBy(F.desc("range"), F.desc("log"), "vec_id", "v").limit(min(SEED_LONGEST, most))
    others = base.orderBy(F.xxhash64("vec_id", F.lit(31)), "vec_id", "v").limit(min(SEED_OTHERS, most))
    return longest.select("vec_id", "v").union(others.select("vec_id", "v")).distinct()


def searched(
    base: DataFrame,
    queries: DataFrame,
    top: int,
    products: Callable[[np.ndarray, np.ndarray], np.ndarray],
    build: Build,
    score_type: pa.DataType,
    slack: float,
    rows: int,
) -> DataFrame:
    """(q, vec_id, score): each query's best ``top`` of every block that it meets, or more.

    ``base`` has (vec_id, v), ``queries`` (q, v): distinct query vectors. Only vectors of the
    same dimension meet. ``products`` gives a matrix of scores, of which ``slack`` (relative)
    is rounding; blocks have ``rows`` vectors, about. On the driver are the length ranges and the seeds, both bounded.
    """
    spark = base.sparkSession
    number = F.coalesce(F.ceil(F.col("log") / math.log(SPREAD)).cast("int"), F.lit(_ZERO))
    base, queries = settled(with_log_length(base, "log")).withColumn("range", number), settled(queries)
    dimension = base.agg(F.max(F.size("v"))).first()[0] or 1
    rows = max(16, min(rows, BLOCK_BYTES // (8 * dimension)))
    by_range = base.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("log").alias("log")).collect()
    plan = layout([(r["range"], r["n"], -math.inf if r["log"] is None else r["log"]) for r in by_range], rows)

    seeds = _seeds(base, dimension)
    sampled = seeds.collect()
    held = {d: np.array([r["v"] for r in sampled if len(r["v"]) == d]) for d in {len(r["v"]) for r in sampled}}
    shared = spark.sparkContext.broadcast((held, plan))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, plan = shared.value
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            bounds, reach = np.full(b.num_rows, np.nan), np.zeros(b.num_rows, np.int64)
            for d in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == d), -(-(sizes == d).sum() // 256)):
                    v = _matrix(b.column(1).take(pa.array(at)), d)
                    known = held.get(int(d))
                    if known is not None and len(known) >= top:
                        score = products(v, known).astype(np.float64)
                        kth = np.partition(score, -top, axis=1)[:, -top]
                        kth = kth - slack * np.abs(score).max(axis=1)
                        bounds[at] = np.where(np.isfinite(kth), kth, np.nan)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        need = np.where(bounds[at] > 0, np.log(bounds[at]) - log_lengths(v), -np.inf)
                    reach[at] = plan.reach(np.where(np.isnan(need), -np.inf, need))
            arrays = [b.column(0), b.column(1), pa.array(bounds, pa.float64(), from_pandas=True), pa.array(reach)]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "v", "bound", "reach"])

    kind = "double" if pa.types.is_floating(score_type) else "long"
    queries = queries.select("q", "v").mapInArrow(bounded, f"q long, v array<{kind}>, bound double, reach long")
    blocks, asked = int(plan.ends[-1]) if len(plan.ends) else 0, queries.count()
    wide = spark.sparkContext.defaultParallelism
    columns = max(1, -(-asked // STREAM), min(-(-wide // max(1, blocks)), asked // WORTH))
    table = F.broadcast(spark.createDataFrame(plan.table, "range int, first long, blocks long"))
    is_seed = seeds.select("vec_id", "v", F.lit(True).alias("seed"))
    placed = base.join(table, "range").join(F.broadcast(is_seed), ["vec_id", "v"], "left")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), "blocks")
    every = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    size = F.size("v").alias("d")
    left = placed.select(size, block.alias("block"), every.alias("column"), F.lit(0).alias("side"), F.col("vec_id").alias("i"), "v", F.when(F.col("seed"), 1.0).alias("bound"))
    mine = F.pmod(F.xxhash64("q"), F.lit(columns)).cast("int").alias("column")
    met = queries.where("reach > 0").withColumn("block", F.explode(F.expr("sequence(0L, reach - 1)")))
    right = met.select(size, "block", mine, F.lit(1).alias("side"), F.col("q").alias("i"), "v", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answer, last = [], None, None
        for d, key, part in _runs(batches):
            if key != last:
                held, answer, last = [], None, key
            side = part.column(3).to_numpy()
            if (side == 0).any():
                held.append(part.filter(pa.array(side == 0)))
            asking = part.filter(pa.array(side == 1))
            if not asking.num_rows or not (held or answer):
                continue
            if answer is None:
                t = pa.Table.from_batches(held).combine_chunks()
                seed = t.column(6).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
                answer, held = build(t.column(4).to_numpy(), _matrix(t.column(5).combine_chunks(), d), seed), []
            at, found, score = answer(_matrix(asking.column(5), d), asking.column(6).to_numpy(zero_copy_only=False))
            arrays = [pa.array(asking.column(4).to_numpy()[at]), pa.array(found), pa.array(score, score_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "vec_id", "score"])

    both = left.union(right).repartition("d", "block", "column").sortWithinPartitions("d", "block", "column", "side", "i")
    return both.mapInArrow(run, f"q long, vec_id long, score {kind}")


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, pa.RecordBatch]]:
    """(dimension, key, rows) of runs of rows with the same (d, block, column)."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield int(keys[0, a]), tuple(keys[:, a].tolist()), b.slice(a, z - a)


def best_each(at: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int):
    """At most ``top`` rows for each query index: highest score, ties to smaller ids."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    place = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
    keep = place < top
    return at[keep], ids[keep], score[keep]


def answers(found: DataFrame, queries: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(q, vec_id, score) of distinct query vectors to each asked row's ranked answers.

    ``asked`` has (query_id, v), ``queries`` (q, v). A query's own row is not an answer; since
    ``top`` + 1 were searched, leaving it out leaves enough.
    """
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top + 1).drop("_place")
    to = asked.join(queries.select("q", "v"), "v").select("query_id", "q")
    rows = to.join(found, "q").where("query_id <> vec_id")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= top)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
