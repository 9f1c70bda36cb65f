"""Per-dimension statistics of points: long form, bounds, equi-width histograms and their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to each upper bound, so that the largest value lies below it.
OPEN = 1e-6


def unpivot_dims(points: DataFrame) -> DataFrame:
    """(id, dim, value): one row for each coordinate."""
    return points.select("id", F.posexplode("vec").alias("dim", "value"))


def dim_counts(points: DataFrame) -> DataFrame:
    """(dim, n); all n are equal if the dimensions agree."""
    return unpivot_dims(points).groupBy("dim").agg(F.count(F.lit(1)).alias("n"))


def bounds(points: DataFrame) -> DataFrame:
    """(dim, lower, upper) with an open upper end; NaN values don't count."""
    values = unpivot_dims(points).where(~F.isnan("value"))
    return values.groupBy("dim").agg(F.min("value").alias("lower"), (F.max("value") + F.lit(OPEN)).alias("upper"))


def histogram(points: DataFrame, buckets: int, given: DataFrame | None = None) -> DataFrame:
    """(dim, bucket, n) for every bucket of every dimension, empty ones too.

    Bounds are computed unless given. They come to the driver (two numbers a dimension) and enter as literals, so the counts
    are one scan with a partial aggregation and no join.
    """
    spark = points.sparkSession
    edges = {r["dim"]: (r["lower"], r["upper"]) for r in (bounds(points) if given is None else given).collect()}
    if not edges:
        return spark.createDataFrame([], "dim int, bucket long, n long")
    counted = _bucketed(points, edges, buckets).groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"))
    dims = spark.createDataFrame([(d,) for d in sorted(edges)], "dim int")
    every = dims.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    return every.join(counted, ["dim", "bucket"], "left").select("dim", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _bucketed(points: DataFrame, edges: dict[int, tuple[float, float]], buckets: int) -> DataFrame:
    lower = F.create_map(*[F.lit(x) for d, (a, _) in edges.items() for x in (d, a)])[F.col("dim")]
    upper = F.create_map(*[F.lit(x) for d, (_, b) in edges.items() for x in (d, b)])[F.col("dim")]
    inside = F.greatest(F.least(F.col("value"), upper), lower)
    place = F.floor((inside - lower) / (upper - lower) * F.lit(float(buckets))).cast("long")
    place = F.when(F.isnan("value"), F.lit(0)).otherwise(F.least(place, F.lit(buckets - 1)))
    return unpivot_dims(points).select("dim", place.cast("long").alias("bucket"))


def histogram_array(counts: DataFrame) -> DataFrame:
    """(dim, total, histogram): bucket counts in order, as one string."""
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    joined = F.array_join(F.transform(ordered, lambda x: x["n"].cast("string")), ",")
    return counts.groupBy("dim").agg(F.sum("n").alias("total"), joined.alias("histogram"))


def bucket_variance(counts: DataFrame) -> DataFrame:
    """(dim, variance): population variance of the bucket counts."""
    return counts.groupBy("dim").agg(F.round(F.var_pop("n"), 6).alias("variance"))


def histogram_prefix(counts: DataFrame) -> DataFrame:
    """(dim, bucket, prefix): running counts."""
    up_to = Window.partitionBy("dim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("dim", "bucket", F.sum("n").over(up_to).alias("prefix"))


def count_rate(counts: DataFrame, dim: int, start: int, end: int) -> float:
    """The part of a dimension's points in buckets [start, end)."""
    inside = F.sum(F.when((F.col("bucket") >= start) & (F.col("bucket") < end), F.col("n")).otherwise(0))
    row = counts.where(F.col("dim") == dim).agg(inside.alias("part"), F.sum("n").alias("whole")).first()
    return row["part"] / row["whole"] if row["whole"] else 0.0
