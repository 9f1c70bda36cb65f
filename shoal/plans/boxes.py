"""Histogram-driven space partitioning: a plan of boxes that tile the data's bounds.

The plan is control data: its input is dimensions times buckets numbers, whatever the
number of points. Splits look at marginal histograms, so counts of nested boxes are
estimates, and a box may turn out larger than aimed at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shoal.operators.stats import OPEN, bounds, histogram
from shoal.params import ClusterParams

BOXES = "pid int, bounds array<struct<lower:double,upper:double>>, estimate long"


@dataclass(frozen=True)
class Leaf:
    """Bucket ranges [from, to) for each dimension, and the points expected inside."""

    ranges: tuple[tuple[int, int], ...]
    estimate: int


def split_point(counts: list[int], start: int, end: int, total: int) -> int | None:
    """Where to cut [start, end): after its emptiest bucket if that lies in the middle third,
    else at the bucket where half of ``total``, rounded down, is reached, else in the middle.
    None if that would leave one side empty."""
    part = counts[start:end]
    low = start + part.index(min(part))
    third = (end - start) // 3
    if start + third <= low < end - third:
        cut = low + 1
    else:
        cut, running = (start + end) // 2 + 1, 0
        for i in range(start, end):
            running += counts[i]
            if running >= total // 2:
                cut = i
                break
    return cut if start < cut < end else None


def plan_leaves(histograms: list[list[int]], total: int, max_size: int, within: bool = False) -> list[Leaf]:
    """Recursive splits until the estimates fit ``max_size``; left before right.

    A child's estimate is its part of the whole histogram times its parent's estimate; with
    ``within`` it is its part of the parent's range, so that estimates add up to the counts in
    one dimension.

    The dimension with the greatest variance of bucket counts in its range goes first, lower
    dimensions winning ties; where it can't be cut the next one is tried, and a range that no
    dimension can cut stays whole. Each cut shortens a range, so the splitting ends.
    """
    leaves: list[Leaf] = []
    todo = [(tuple((0, len(h)) for h in histograms), total)]
    sums = [sum(h) or 1 for h in histograms]
    while todo:
        ranges, count = todo.pop()
        cut = None
        if count > max_size:
            for d in sorted(range(len(ranges)), key=lambda d: -_variance(histograms[d][slice(*ranges[d])])):
                start, end = ranges[d]
                if end - start > 1 and (cut := split_point(histograms[d], start, end, count)):
                    break
        if not cut:
            leaves.append(Leaf(ranges, count))
            continue
        whole = (sum(histograms[d][start:end]) or 1) if within else sums[d]
        left = int(sum(histograms[d][start:cut]) / whole * count)
        todo.append(((*ranges[:d], (cut, end), *ranges[d + 1 :]), count - left))
        todo.append(((*ranges[:d], (start, cut), *ranges[d + 1 :]), left))
    return leaves


def _variance(counts: list[int]) -> float:
    mean = sum(counts) / len(counts)
    return sum((n - mean) ** 2 for n in counts) / len(counts)


def boxes(leaves: list[Leaf], edges: list[tuple[float, float]], buckets: int) -> list[tuple]:
    """Rows (pid, bounds, estimate); both sides of a cut come from one expression, so boxes tile.

    The last box of a dimension reaches beyond its bound where adding the open end was lost to
    rounding.
    """

    def edge(d: int, k: int) -> float:
        low, high = edges[d]
        if k == buckets and high - OPEN >= high:
            return high * (1 + 1e-15) if high > 0 else high * (1 - 1e-15)
        return low + (high - low) * k / buckets

    return [
        (pid, [(edge(d, a), edge(d, b)) for d, (a, b) in enumerate(leaf.ranges)], leaf.estimate)
        for pid, leaf in enumerate(leaves)
    ]


def plan_from(edges: DataFrame, histogram: DataFrame, params: ClusterParams, within: bool = False) -> DataFrame:
    """(pid, bounds, estimate) from (dim, lower, upper) and (dim, bucket, n): numbers whose
    count is dimensions times buckets, whatever the number of points."""
    spark: SparkSession = edges.sparkSession
    ends = {r["dim"]: (r["lower"], r["upper"]) for r in edges.collect()}
    if not ends:
        return spark.createDataFrame([], BOXES)
    counts = [[0] * params.buckets for _ in ends]
    for r in histogram.collect():
        counts[r["dim"]][r["bucket"]] = r["n"]
    totals = {sum(c) for c in counts}
    if len(totals) != 1:
        raise ValueError(f"dimensions have different counts: {sorted(totals)}")
    leaves = plan_leaves(counts, totals.pop(), params.max_partition_size, within)
    return spark.createDataFrame(boxes(leaves, [ends[d] for d in sorted(ends)], params.buckets), BOXES)


def plan_partitions(points: DataFrame, params: ClusterParams, within: bool = False) -> DataFrame:
    """(pid, bounds, estimate) for the points; an empty table gives no boxes."""
    edges = bounds(points)
    return plan_from(edges, histogram(points, params.buckets, edges), params, within)
