"""Exact density-based clustering with canonical labels.

Core points have at least ``min_pts`` neighbours (themselves aside) closer than eps;
clusters are the components of core points over neighbour pairs, numbered from 0 by their
smallest core id; a border point takes the lowest cluster among its core neighbours; noise
is -1. Nothing depends on row order or partitioning.

Points at the same place are first collapsed into one with a weight, so a place that holds a
third of all rows costs one row in the joins. In cells so small that any two of their points
are neighbours, a crowd is core without any distance, and one of it stands for all in the
component search. The grid join runs three times: for the counts, between cores of different
small cells, and from the others to the cores. Each feeds an aggregation or a contraction at
once; no list of pairs is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.geometry import distance
from shoal.operators.components import connected_components
from shoal.operators.neighbors import GRID_DIMS, Grid, collapsed, eps_pairs, grid_of, neighbor_sums
from shoal.params import ClusterParams
from shoal.session import settled
from shoal.sources.points import checked

#: Component edges up to this number are finished by one task.
ALONE = 1_000_000
CORE, BORDER, NOISE = "CORE", "BORDER", "NOISE"


def _small_cells(vec: Column, dims: int, eps: float) -> dict[str, Column]:
    """Cells in which any two points are closer than eps; null for NaN."""
    side = F.lit(eps / math.sqrt(dims) * (1 - 1e-9))
    return {f"_k{i}": F.when(~F.isnan(vec[i]), F.floor(vec[i] / side).cast("long")) for i in range(dims)}


def core_places(places: DataFrame, dims: int, params: ClusterParams, grid: Grid) -> DataFrame:
    """``places`` with core. A small cell with more than ``min_pts`` points is core throughout."""
    if dims > GRID_DIMS:
        counted = neighbor_sums(places, places, dims, params.eps, grid)
        return counted.withColumn("core", F.col("neighbors") >= params.min_pts).drop("neighbors")
    cells = _small_cells(F.col("vec"), dims, params.eps)
    placed = places.withColumns(cells)
    crowds = placed.groupBy(*cells).agg(F.sum("weight").alias("_n")).where(F.col("_n") > params.min_pts)
    for k in cells:
        # Beyond that, rounding may put points of neighbouring cells into one.
        crowds = crowds.where(F.col(k).between(1 - (1 << 20), (1 << 20) - 1))
    # Cells and places grow with the data, and their estimates miss that: merged, not broadcast.
    # A semi or anti join would be pushed below the collapse, to all points of a place.
    crowds = settled(crowds.select(*cells, F.lit(True).alias("_crowd")))
    met = placed.join(crowds.hint("merge"), list(cells), "left")
    crowded = met.where("_crowd").select(*places.columns, F.lit(True).alias("core"))
    rest = met.where("_crowd is null").select(*places.columns)
    rest = neighbor_sums(rest, places, dims, params.eps, grid).withColumn("core", F.col("neighbors") >= params.min_pts)
    return crowded.unionByName(rest.drop("neighbors"))


def core_points(points: DataFrame, dims: int, params: ClusterParams) -> DataFrame:
    """(id) of the core points: each place is judged once, whatever number of points it holds."""
    known = points.where("id is not null")
    places = core_places(collapsed(known), dims, params, grid_of(known, dims, params.eps))
    return known.join(places.where("core").select("vec").hint("merge"), "vec", "left_semi").select("id")


def classified(points: DataFrame, dims: int, params: ClusterParams) -> DataFrame:
    """(id, neighbors, tag, component): component is the smallest core id of the point's cluster.

    A border point's component is the smallest among its core neighbours'; noise has none.
    """
    grid = grid_of(points, dims, params.eps)
    places = collapsed(points)
    counted = neighbor_sums(places, places, dims, params.eps, grid)
    places = settled(counted.withColumn("core", F.col("neighbors") >= params.min_pts))
    labelled = places.select("id", "neighbors").join(labelled_places(places, dims, params, grid), "id")
    return points.join(labelled.select("vec", "neighbors", "tag", "component"), "vec").select("id", "neighbors", "tag", "component", "vec")


def label_places(points: DataFrame, dims: int, params: ClusterParams) -> DataFrame:
    """(vec, id, tag, component) of the distinct places."""
    grid = grid_of(points, dims, params.eps)
    return labelled_places(settled(core_places(collapsed(points), dims, params, grid)), dims, params, grid)


def stand_ins(cores: DataFrame, dims: int, eps: float, by: tuple[str, ...] = (), node: str = "id") -> DataFrame:
    """``cores`` with stand: the smallest core node of the small cell.

    Such cells collapse crowded places for the component search. A core whose distance to its
    stand-in isn't below eps, by rounding, stands for itself; so do all where the cells would
    be too fine to matter.
    """
    if dims > GRID_DIMS:
        return cores.withColumn("stand", F.col(node))
    cells = _small_cells(F.col("vec"), dims, eps)
    keys = [*by, *cells]
    placed = cores.withColumns(cells)
    firsts = settled(placed.groupBy(*keys).agg(F.min(F.struct(F.col(node).alias("node"), "vec")).alias("_first")))
    close = distance(F.col("vec"), F.col("_first.vec"), dims) < F.lit(float(eps))
    stand = F.when(close, F.col("_first.node")).otherwise(F.col(node))
    return placed.join(firsts, keys).select(*cores.columns, stand.alias("stand"))


def core_components(
    places: DataFrame, dims: int, params: ClusterParams, grid: Grid, by: tuple[str, ...] = (), node: str = "id"
) -> DataFrame:
    """(by..., id, vec, node, component) of core places; component is the smallest ``node`` of
    the cluster, nodes being numbers of their own for each place."""
    columns = list(dict.fromkeys([*by, "id", "vec", node]))
    cores = settled(stand_ins(places.where("core").select(*columns), dims, params.eps, by, node))
    met = eps_pairs(cores, cores, dims, params.eps, grid, by, keep=F.col("a_stand") > F.col("b_stand"))
    labels = connected_components(met.select("a_stand", "b_stand"), "a_stand", "b_stand", settled, ALONE).withColumnRenamed("node", "_node")
    own = cores.join(labels, F.col("stand") == F.col("_node"), "left")
    return settled(own.select(*columns, F.coalesce("component", "stand").alias("component")))


def least_beside(places: DataFrame, cores: DataFrame, value: str, dims: int, eps: float, grid: Grid, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, value): the least ``value`` among the cores beside each of the places that aren't."""
    edge = places.where("not core").select(*by, "id", "vec")
    met = eps_pairs(edge, cores.select(*by, "id", "vec", value), dims, eps, grid, by)
    return met.groupBy(*[F.col(f"a_{k}").alias(k) for k in (*by, "id")]).agg(F.min(f"b_{value}").alias(value))


def tagged_places(places: DataFrame, cores: DataFrame, border: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., vec, id, tag, value) of all places from those of cores and border places."""
    keys = [*by, "id"]
    known = cores.select(*keys, value, F.lit(CORE).alias("tag")).union(border.select(*keys, value, F.lit(BORDER).alias("tag")))
    return places.select(*by, "vec", "id").join(known, keys, "left").select(*by, "vec", "id", F.coalesce("tag", F.lit(NOISE)).alias("tag"), value)


def labelled_places(places: DataFrame, dims: int, params: ClusterParams, grid: Grid) -> DataFrame:
    """(vec, id, tag, component) of places with core."""
    cores = core_components(places, dims, params, grid)
    return tagged_places(places, cores, least_beside(places, cores, "component", dims, params.eps, grid), "component")


def mapped(cluster_id: Column, component: Column) -> Column:
    """The cluster of a component; -1 without one. A component without a cluster is an error."""
    missing = F.raise_error(F.concat(F.lit("no cluster for component "), component.cast("string")))
    return F.when(component.isNull(), F.lit(-1)).otherwise(F.coalesce(cluster_id, missing.cast("int")))


def numbered(labelled: DataFrame) -> DataFrame:
    """(component, cluster_id): clusters numbered from 0 in the order of their smallest core id.

    Components are dealt by range; each range counts its own, and the ranges' totals (a row a
    partition) give it its start, so no task orders all clusters.
    """
    kinds = labelled.where("component is not null").select("component").distinct()
    dealt = settled(kinds.repartitionByRange("component").withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("component")) - 1
    rows = dealt.withColumn("place", place).join(starts, "slice")
    return rows.select("component", (F.col("start") + F.col("place")).cast("int").alias("cluster_id"))


def cluster_points(points: DataFrame, params: ClusterParams, nan_as_noise: bool = False) -> DataFrame:
    """(id, cluster_id, vec) of every point, noise -1.

    Raises InvalidPoints for input that can't be clustered; an empty table gives no rows.
    """
    points, dims = checked(points, nan_as_noise)
    if not dims:
        return points.select("id", F.lit(-1).alias("cluster_id"), "vec")
    labelled = settled(label_places(points, dims, params))
    ids = numbered(labelled)
    named = labelled.join(ids, "component", "left").select("vec", mapped(F.col("cluster_id"), F.col("component")).alias("cluster_id"))
    return points.join(named, "vec").select("id", "cluster_id", "vec")


def cluster_sizes(result: DataFrame) -> DataFrame:
    """(cluster_id, n), noise included as -1."""
    return result.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def cluster_centroids(result: DataFrame) -> DataFrame:
    """(cluster_id, dim, mean, lower, upper) of the clusters, means rounded to 6 digits."""
    values = result.where("cluster_id >= 0").select("cluster_id", F.posexplode("vec").alias("dim", "value"))
    return values.groupBy("cluster_id", "dim").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lower"), F.max("value").alias("upper"))


def cluster_boxes(result: DataFrame) -> DataFrame:
    """(cluster_id, n, dim, lower, upper): the clusters' bounding boxes, one row a dimension."""
    values = result.where("cluster_id >= 0").select("cluster_id", F.posexplode("vec").alias("dim", "value"))
    return values.groupBy("cluster_id", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lower"), F.max("value").alias("upper"))


def noise_ratio(result: DataFrame) -> DataFrame:
    """One row: the share of noise points."""
    return result.agg(F.avg((F.col("cluster_id") == -1).cast("double")).alias("noise_ratio"))
