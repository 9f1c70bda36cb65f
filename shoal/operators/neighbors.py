"""The eps self-join as an equi-join on cells.

A condition ``distance < eps`` alone would compare all pairs. Here one side looks into its
cell's neighbourhood (three cells for each key), the join is on equal cells, and the distance
is a residual condition. It is a merge join whatever the tables' estimated sizes, which don't
see the copies: a broadcast of them would grow with the data. Adaptive execution splits crowded
cells.

Keys are coordinates where those spread over several eps, else distances to pivots: by the
triangle inequality neighbours' distances to any point differ by less than eps. Data that
neither spreads (narrow and of many dimensions) can't be pruned exactly; its pairs are dealt
out over blocks, so that no task or broadcast grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.geometry import cell, distance, finite
from shoal.operators.blocks import block_pairs, block_sums

#: Keys that a join uses at most; each multiplies the copies of one side by three.
GRID_DIMS = 3
#: Points and coordinates in a block where nothing can be pruned, about.
BLOCK_POINTS, BLOCK_NUMBERS = 8_192, 1 << 22
#: Points of a place in a list, about.
MEMBERS = 256


@dataclass(frozen=True)
class Grid:
    """What cells are made of: dimensions and pivots; without either, blocks a side."""

    dims: tuple[int, ...] = ()
    pivots: tuple[tuple[float, ...], ...] = ()
    blocks: int = 1

    def cells(self, vec: Column, dims: int, eps: float) -> list[Column]:
        far = [distance(vec, F.array(*map(F.lit, p)), dims) for p in self.pivots]
        return [cell(x, eps) for x in [*(vec[i] for i in self.dims), *far]]


def grid_of(points: DataFrame, dims: int, eps: float) -> Grid:
    """The dimensions widest in eps, at most GRID_DIMS, and only those wider than two cells
    (the neighbourhood covers two); where they are fewer, pivots whose distances spread as far.

    A pivot is the point farthest from the one before, the first from the mean: one pass of
    aggregates each. NaN coordinates (points without neighbours) don't count.
    """
    if dims <= GRID_DIMS:
        return Grid(tuple(range(dims)))
    some = points.where(~F.exists("vec", F.isnan)).select("vec")
    columns = [f(F.col("vec")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max), ("m", F.avg))]
    ends = some.agg(*columns, F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return Grid()
    spread = {i: (ends[f"b{i}"] - ends[f"a{i}"]) / eps for i in range(dims)}
    wide = tuple(sorted(sorted((i for i in spread if spread[i] > 2), key=lambda i: -spread[i])[:GRID_DIMS]))
    pivots: list[tuple[float, ...]] = []
    place = tuple(ends[f"m{i}"] for i in range(dims))
    for step in range(GRID_DIMS - len(wide) + 1):
        far = distance(F.col("vec"), F.array(*map(F.lit, place)), dims)
        found = some.select("vec", far.alias("far")).agg(F.min("far").alias("a"), F.max("far").alias("b"), F.max_by("vec", F.struct("far", "vec")).alias("vec")).first()
        if step:
            if (found["b"] - found["a"]) / eps <= 2:
                break
            pivots.append(place)
        place = tuple(found["vec"])
    return Grid(wide, tuple(pivots), 1 if wide or pivots else -(-ends["n"] // max(1, min(BLOCK_POINTS, BLOCK_NUMBERS // dims))))


def _sides(left: DataFrame, right: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may have neighbours, columns as a_* and b_*."""
    a, b = (df.where(F.col("id").isNotNull() & finite(F.col("vec"), dims)) for df in (left, right))
    return a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])


def eps_pairs(
    left: DataFrame, right: DataFrame, dims: int, eps: float, grid: Grid, by: tuple[str, ...] = (), keep: Column | None = None, selves: bool = False
) -> DataFrame:
    """All (left row, right row) with different ids, or any if ``selves``, and distance < eps: columns a_* and b_* without
    vectors, and distance. Rows without id or with a coordinate that isn't finite have no neighbours.

    ``by`` are columns that must also be equal (a box number); ``keep`` is one more residual
    condition on the a_ and b_ columns.
    """
    a, b = _sides(left, right, dims)
    if not (grid.dims or grid.pivots):
        met = block_pairs(a, b, dims, eps, grid.blocks, by, selves)
        return met if keep is None else met.where(keep)
    mine, theirs = grid.cells(F.col("a_vec"), dims, eps), grid.cells(F.col("b_vec"), dims, eps)
    keys = [f"_c{i}" for i in range(len(mine))]
    a = a.withColumns(dict(zip(keys, mine, strict=True)))
    # The place is computed before the rows are multiplied.
    b = b.withColumns({f"_b{k}": c for k, c in zip(keys, theirs, strict=True)})
    shift = [F.struct(*[F.lit(s).cast("long").alias(k) for s, k in zip(shifts, keys, strict=True)]) for shifts in product((-1, 0, 1), repeat=len(keys))]
    b = b.withColumn("_s", F.explode(F.array(*shift)))
    b = b.withColumns({f"_b{k}": F.col(f"_b{k}") + F.col("_s")[k] for k in keys}).drop("_s")
    far = distance(F.col("a_vec"), F.col("b_vec"), dims)
    condition = far < F.lit(float(eps))
    if not selves:
        condition = (F.col("a_id") != F.col("b_id")) & condition
    for c in by:
        condition = condition & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    if keep is not None:
        condition = condition & keep
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_b{k}"))
    met = a.join(b.hint("merge"), condition).withColumn("distance", far)
    return met.drop("a_vec", "b_vec", *keys, *[f"_b{k}" for k in keys])


def gathered(points: DataFrame) -> DataFrame:
    """(id, vec, members): the ids at a place, in lists of about MEMBERS where they are more; id is the list's least."""
    points = points.where("id is not null")
    crowds = points.groupBy("vec").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MEMBERS)
    lists = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("_n", F.lit(1)) / MEMBERS))
    dealt = points.join(crowds, "vec", "left").select("id", "vec", lists.alias("_list"))
    return dealt.groupBy("vec", "_list").agg(F.min("id").alias("id"), F.collect_list("id").alias("members")).drop("_list")


def _member_pairs(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(id, neighbor, distance) of ordered pairs of different points closer than eps.

    The join meets lists of points at the same place; their members are paired after it, by the
    task that found them.
    """
    lists = gathered(points)
    met = eps_pairs(lists, lists, dims, eps, grid_of(points, dims, eps), selves=True)
    firsts = met.select(F.explode("a_members").alias("id"), "b_members", "distance")
    return firsts.select("id", F.explode("b_members").alias("neighbor"), "distance").where("id <> neighbor")


def eps_neighbors(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(id, neighbor): ordered pairs of different points closer than eps."""
    return _member_pairs(points, dims, eps).select("id", "neighbor")


def pair_distance(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(id, neighbor, distance) of pairs id < neighbor closer than eps."""
    pairs = _member_pairs(points, dims, eps).where("id < neighbor")
    return pairs.select("id", "neighbor", F.round("distance", 9).alias("distance"))


def collapsed(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct places: (by..., id, vec, weight), id being the smallest there."""
    return points.groupBy(*by, "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))


def neighbor_sums(places: DataFrame, others: DataFrame, dims: int, eps: float, grid: Grid, by: tuple[str, ...] = ()) -> DataFrame:
    """``places`` with neighbors: points closer than eps among ``others``, of the own place all but one."""
    keys = [*by, "id"]
    if grid.dims or grid.pivots:
        met = eps_pairs(places, others, dims, eps, grid, by).withColumnRenamed("b_weight", "weight")
    else:
        met = block_sums(*_sides(places, others, dims), dims, eps, grid.blocks, by)
    found = met.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys]).agg(F.sum("weight").alias("_others"))
    counted = places.join(found, keys, "left")
    # Points that aren't finite are no neighbours even of their like.
    own = F.when(finite(F.col("vec"), dims), F.col("weight") - 1).otherwise(0)
    return counted.withColumn("neighbors", F.coalesce("_others", F.lit(0)) + own).drop("_others")


def neighbor_counts(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(id, neighbors), also where there is none; each place is counted once."""
    places = collapsed(points.where("id is not null"))
    found = neighbor_sums(places, places, dims, eps, grid_of(points, dims, eps)).select("vec", "neighbors")
    n = F.when(F.col("id").isNotNull(), F.col("neighbors"))
    return points.join(found, "vec", "left").select("id", F.coalesce(n, F.lit(0)).alias("neighbors"))
