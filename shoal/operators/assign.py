"""Points to boxes, with copies in the margins of neighbouring boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.geometry import OUTER, role

#: Boxes up to this number are broadcast, in at most SLICES rows each.
BROADCAST_BOXES = 4096
SLICES = 64


def assign_partitions(points: DataFrame, boxes: DataFrame, eps: float) -> DataFrame:
    """(id, vec, pid, role): a row for each box whose widening by eps holds the point.

    Boxes are cut into slices along the first dimension, which points find by equality; the
    role in the box decides. The number of boxes grows with the data, so it is checked: a
    short list (at most BROADCAST_BOXES * SLICES rows) is broadcast, a long one is joined
    by its slices, finer ones. A NaN coordinate matches no slice and gets no box.
    """
    few = boxes.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES
    low, high = F.col("bounds")[0]["lower"], F.col("bounds")[0]["upper"]
    ends = boxes.agg(F.min(low).alias("a"), F.max(high).alias("b")).first()
    start, end = (ends["a"], ends["b"]) if ends["a"] is not None else (0.0, 1.0)
    width = max((end - start) / (SLICES if few else 64 * SLICES), eps)
    at = lambda v: F.floor((v - F.lit(start)) / F.lit(width)).cast("long")
    # One slice more on each side: rounding can't lose a box.
    sliced = boxes.select("pid", "bounds", F.explode(F.sequence(at(low - eps) - 1, at(high + eps) + 1)).alias("slice"))
    met = points.withColumn("slice", at(F.col("vec")[0])).join(F.broadcast(sliced) if few else sliced, "slice")
    placed = met.withColumn("role", role(F.col("vec"), F.col("bounds"), eps)).where(F.col("role").isNotNull())
    return placed.select("id", "vec", "pid", "role")


def partition_sizes(assigned: DataFrame) -> DataFrame:
    """(pid, role, n)."""
    return assigned.groupBy("pid", "role").agg(F.count(F.lit(1)).alias("n"))


def point_copies(assigned: DataFrame) -> DataFrame:
    """(id, copies, home): boxes that hold the point, and the one whose inside it is."""
    home = F.min(F.when(F.col("role") != OUTER, F.col("pid")))
    return assigned.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), home.alias("home"))
