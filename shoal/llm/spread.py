"""Positions and running sums inside keys of any size; what tells rows apart.

A key may hold a third of all rows, so no window here is partitioned by the key alone: rows
are dealt over hash slices of each key, as many as the number of rows asks for, and the
slices' totals (a row each) give every slice its start.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.session import reachable, settled, sweep

__all__ = ["in_arrow", "in_pandas", "key_order", "numbered", "one_of_each", "ranked", "row_hash", "rows_of", "running_start", "settled", "sweep", "text_key"]

#: Slices of a key at least, and rows in a slice at most, about, if one key has all.
SLICES, SLICE_ROWS = 128, 1_000_000


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's call that hands free memory back; other C libraries have none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Hands memory that is free, but kept by the allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def _giving_back(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` by workers that hold no more than they need once a task is over.

    Python workers are used again and wait beside the executor until then, more of them than
    it has cores: a stage may have several of them a task.
    """
    return df.mapInArrow(_giving_back(f), schema)


def in_pandas(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInPandas``, likewise."""
    return df.mapInPandas(_giving_back(f), schema)


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null has one byte of its own."""
    text = text.cast("string")
    return F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit("00")))


def key_order(id_col: str) -> tuple[Column, Column]:
    """Two columns that are never null, in the order of ids: null is larger than any other."""
    key = F.col(id_col).cast("long")
    return key.isNull(), F.coalesce(key, F.lit(0).cast("long"))


def slices(rows: int) -> int:
    return max(SLICES, -(-rows // SLICE_ROWS))


def running_start(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same keys that come before.

    The order inside a key is (hash slice, ``order``): fixed by the rows themselves, the same
    in every run. Keys must not be null. ``order`` should tell rows apart; rows alike in all of
    it take their places in any order. ``rows`` is the number of rows, counted if not given.
    """
    count = slices(df.count() if rows is None else rows)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(count)).cast("int"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(amount).alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    running = sliced.withColumn(
        "_running", F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    )
    return (
        running.join(starts, [*keys, "_slice"])
        .withColumn(name, (F.col("_start") + F.col("_running")).cast("long"))
        .drop("_slice", "_start", "_running")
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int | None = None) -> DataFrame:
    """Adds ``name``: each row's place in its keys, gapless from 0, in an order as above."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_start(one, keys, order, "_one", name, rows).drop("_one")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The distinct values of ``order`` (not null) with ``name``: their places in it, from 0.

    They are dealt by range, and the ranges' totals (a row a partition) give each its start.
    """
    dealt = settled(rows.select(*order).distinct().repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    found = dealt.withColumn("_place", place).join(starts, "_slice")
    return found.select(*order, (F.col("_start") + F.col("_place")).cast("long").alias(name))


def row_hash(df: DataFrame, names: list[str]) -> Column:
    """A hash of the columns ``names``, without those that hold maps (they have no hash)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return F.xxhash64(*[F.col(c) for c in names if "map<" not in kinds[c] and "variant" not in kinds[c]])


def one_of_each(df: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with one row of each of the ``keys`` in ``repeated`` and all other rows.

    Which one depends on the rows alone: that with the least hash.
    """
    several = df.join(repeated.select(*keys), keys, "left_semi").select(*df.columns)
    one = several.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(keys)]).agg(
        F.min_by(F.struct(*df.columns), row_hash(df, df.columns)).alias("_row")
    )
    others = df.join(repeated.select(*keys), keys, "left_anti").select(*df.columns)
    return others.union(one.select("_row.*"))
