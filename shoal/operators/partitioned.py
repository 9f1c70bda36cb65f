"""Clustering box by box: copies in margins, local clusters, merging, relabelling.

Core flags are exact on a point's home copy, whose whole neighbourhood is in the box widened
by eps. The exact strategies therefore count neighbours of home copies only and carry the
flags to all copies; merging by shared core points can then neither abort nor join too much.
As on the grid, places are collapsed and no list of pairs is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.geometry import OUTER
from shoal.operators.assign import assign_partitions
from shoal.operators.cluster import ALONE, CORE, NOISE, core_components, least_beside, mapped, numbered, stand_ins, tagged_places
from shoal.operators.components import connected_components
from shoal.operators.neighbors import Grid, eps_pairs, grid_of, neighbor_sums
from shoal.params import ClusterParams
from shoal.plans.boxes import plan_partitions
from shoal.session import settled
from shoal.sources.points import checked


def box_places(assigned: DataFrame) -> DataFrame:
    """Distinct places of each box: (pid, vec, id, weight, home); id is the smallest there."""
    home = F.max(F.col("role") != OUTER).alias("home")
    return assigned.groupBy("pid", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), home)


def home_cores(places: DataFrame, dims: int, params: ClusterParams, grid: Grid) -> DataFrame:
    """The ids of core places, counted where they are at home."""
    counted = neighbor_sums(places.where("home"), places, dims, params.eps, grid, ("pid",))
    return counted.where(F.col("neighbors") >= params.min_pts).select("id")


def local_clusters(assigned: DataFrame, dims: int, params: ClusterParams, exact: bool = False) -> DataFrame:
    """(pid, id, tag, local_id): each box clustered by itself, its margin copies included.

    Tags are those of the box's own view (a margin copy may have fewer neighbours there), or
    with ``exact`` the home copies'. Local ids count from 0 in a box by smallest core id;
    noise has -1.
    """
    places = box_places(assigned)
    grid = grid_of(assigned, dims, params.eps)
    if exact:
        places = settled(places)
        cores = home_cores(places, dims, params, grid).withColumn("core", F.lit(True))
        flags = places.join(cores, "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    else:
        flags = neighbor_sums(places, places, dims, params.eps, grid, ("pid",)).withColumn("core", F.col("neighbors") >= params.min_pts)
    # A node for each place of a box; settled at once, so that it keeps its number.
    flags = settled(flags.select("pid", "id", "vec", "core", F.monotonically_increasing_id().alias("node")))
    cores = core_components(flags, dims, params, grid, ("pid",), "node")
    least = cores.groupBy("pid", "component").agg(F.min("id").alias("first"))
    order = Window.partitionBy("pid").orderBy("first")
    least = settled(least.withColumn("local_id", F.row_number().over(order) - 1).select("pid", "component", "local_id"))
    cores = settled(cores.join(least, ["pid", "component"]).select("pid", "id", "vec", "local_id"))
    border = least_beside(flags, cores, "local_id", dims, params.eps, grid, ("pid",))
    known = tagged_places(flags, cores, border, "local_id", ("pid",)).select("pid", "vec", "tag", "local_id")
    return assigned.join(known, ["pid", "vec"]).select("pid", "id", "tag", F.coalesce("local_id", F.lit(-1)).alias("local_id"))


def cluster_refs(local: DataFrame) -> DataFrame:
    """(pid, local_id): the local clusters, noise left out."""
    return local.where("local_id >= 0").select("pid", "local_id").distinct()


def copy_pairs(local: DataFrame) -> DataFrame:
    """(id, pid_a, local_a, pid_b, local_b), pid_a < pid_b: copies of a point that is noise in
    neither box and core in at least one."""
    seen = local.where(F.col("tag") != NOISE).select("id", "pid", "local_id", "tag")
    a = seen.withColumnsRenamed({"pid": "pid_a", "local_id": "local_a", "tag": "tag_a"})
    b = seen.withColumnsRenamed({"pid": "pid_b", "local_id": "local_b", "tag": "tag_b"})
    met = a.join(b, "id").where((F.col("pid_a") < F.col("pid_b")) & ((F.col("tag_a") == CORE) | (F.col("tag_b") == CORE)))
    return met.select("id", "pid_a", "local_a", "pid_b", "local_b")


def distinct_edges(pairs: DataFrame) -> DataFrame:
    """(pid_a, local_a, pid_b, local_b): the local clusters that share a point."""
    return pairs.select("pid_a", "local_a", "pid_b", "local_b").distinct()


def merge_edges(local: DataFrame) -> DataFrame:
    """(pid_a, local_a, pid_b, local_b), pid_a < pid_b: local clusters that share a point
    which is noise in neither and core in at least one."""
    return distinct_edges(copy_pairs(local))


def cluster_map(local: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, local_id, cluster_id): the merged cluster of each local one, numbered from 0 by
    smallest core id."""
    refs = local.where(F.col("tag") == CORE).groupBy("pid", "local_id").agg(F.min("id").alias("first"))
    refs = settled(refs.withColumn("node", F.monotonically_increasing_id()))
    node = refs.select("pid", "local_id", "node")
    a, b = (node.withColumnsRenamed({"pid": f"pid_{x}", "local_id": f"local_{x}", "node": x}) for x in "ab")
    met = edges.join(a, ["pid_a", "local_a"]).join(b, ["pid_b", "local_b"]).select("a", "b")
    labels = connected_components(met, "a", "b", settled, ALONE).withColumnRenamed("component", "merged")
    where = settled(refs.join(labels, "node", "left").withColumn("merged", F.coalesce("merged", "node")))
    lowest = settled(where.groupBy("merged").agg(F.min("first").alias("component")))
    named = where.join(lowest, "merged")
    return named.join(numbered(lowest), "component").select("pid", "local_id", "cluster_id")


def relabelled(local: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster_id): the lowest cluster among a point's copies, -1 if all are noise.

    A local cluster without an entry in ``clusters`` is an error.
    """
    met = local.where("local_id >= 0").join(clusters, ["pid", "local_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no cluster for local cluster "), F.col("pid").cast("string"), F.lit("_"), F.col("local_id").cast("string")))
    met = met.select("id", F.coalesce("cluster_id", missing.cast("int")).alias("cluster_id"))
    lowest = met.groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    ids = local.select("id").distinct()
    return ids.join(lowest, "id", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def cluster_by_partitions(points: DataFrame, params: ClusterParams, boxes: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id, vec): the same result as the grid strategy, found box by box.

    Home places look for their neighbours among all places of their box: one pass counts, one
    contracts pairs of cores, one gathers the others' cores. ``boxes`` default to the plan
    made from the points' histograms; they must tile the points.
    """
    points, dims = checked(points)
    if not dims:
        return points.select("id", F.lit(-1).alias("cluster_id"), "vec")
    boxes = plan_partitions(points, params) if boxes is None else boxes
    assigned = assign_partitions(points, boxes, params.eps)
    places = settled(box_places(assigned))
    if places.where("home").agg(F.sum("weight")).first()[0] != points.count():
        raise ValueError("the boxes don't tile the points")
    grid = grid_of(points, dims, params.eps)
    cores = settled(home_cores(places, dims, params, grid))
    home = places.where("home").select("pid", "id", "vec")
    found = settled(stand_ins(home.select("id", "vec").join(cores, "id"), dims, params.eps))
    copies = settled(places.select("pid", "id", "vec").join(found.select("id", "stand"), "id"))
    inside = home.join(found.select("id", "stand"), "id").select("pid", "id", "vec", "stand")
    met = eps_pairs(inside, copies, dims, params.eps, grid, ("pid",), keep=F.col("a_stand") != F.col("b_stand"))
    labels = connected_components(met.select("a_stand", "b_stand"), "a_stand", "b_stand", settled, ALONE).withColumnRenamed("node", "stand")
    own = settled(found.join(labels, "stand", "left").select("id", F.coalesce("component", "stand").alias("component")))
    edge = home.join(cores, "id", "left_anti").select("pid", "id", "vec")
    near = eps_pairs(edge, copies.select("pid", "id", "vec").join(own, "id"), dims, params.eps, grid, ("pid",))
    border = near.groupBy(F.col("a_id").alias("id")).agg(F.min("b_component").alias("component"))
    known = settled(home.select("id", "vec").join(own.union(border), "id", "left"))
    named = known.join(numbered(known), "component", "left").select("vec", mapped(F.col("cluster_id"), F.col("component")).alias("cluster_id"))
    return points.join(named, "vec").select("id", "cluster_id", "vec")
