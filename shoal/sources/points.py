"""Points from tables and from delimited text; results to text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])


class InvalidPoints(ValueError):
    """Input that can't be clustered: duplicate or null ids, mixed dimensions, non-finite values."""


def points_from(df: DataFrame, id_col: str, features: list[str] | str) -> DataFrame:
    """(id, vec) from scalar columns or from one array column; only those are read."""
    if isinstance(features, str):
        vec = F.transform(F.col(features), lambda x: x.cast("double"))
    else:
        vec = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def read_points(
    spark: SparkSession, path: str, delimiter: str = " ", header: bool = False, with_id: bool = True, regex: bool = False
) -> DataFrame:
    """Points of the ``*.csv`` files (any case) under ``path``: optional id, then numbers.

    ``path`` may also be a single such file.

    Lines are trimmed; blank ones don't count. ``header`` drops each file's first line. Lines
    with no feature are skipped, yet keep their number. Without an id column the id is the
    line's number over all files in path order, from 0. The delimiter is literal unless
    ``regex``. A token that isn't a number fails the query that reads it.
    """
    need_order = header or not with_id
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", "true").text(path)
    if need_order:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"))
        lines = _numbered(_cleaned(lines), header)
    return points_of_lines(lines, delimiter, with_id, regex)


def _cleaned(lines: DataFrame) -> DataFrame:
    """Trimmed lines, without blank ones."""
    return lines.withColumn("value", F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).where(F.length("value") > 0)


def points_of_lines(lines: DataFrame, delimiter: str = " ", with_id: bool = True, regex: bool = False) -> DataFrame:
    """Points of lines (``value``; ``number`` where there is no id column), as in ``read_points``."""
    spec = delimiter if regex else re.escape(delimiter)
    tokens = _cleaned(lines).withColumn("tokens", F.split("value", spec, -1))
    first = 1 if with_id else 0
    kept = tokens.where(F.size("tokens") > first)
    bad = lambda x, kind: F.when(F.trim(x).try_cast(kind).isNull(), F.raise_error(F.concat(F.lit("not a number: "), x)))
    parsed = lambda x, kind: F.coalesce(F.trim(x).try_cast(kind), bad(x, kind).cast(kind))
    vec = F.transform(F.slice("tokens", first + 1, F.size("tokens")), lambda x: parsed(x, "double"))
    ident = parsed(F.col("tokens")[0], "long") if with_id else F.col("number")
    return kept.select(ident.alias("id"), vec.alias("vec"))


def _numbered(lines: DataFrame, header: bool) -> DataFrame:
    """Each line's place in its file and over all files, found from per-block counts.

    A file's blocks are read in order, so a line's place is its rank in its block plus the
    lines of the blocks before; only the block counts (one row a block) are summed up.
    """
    from pyspark.sql import Window

    within = Window.partitionBy("file", "at").orderBy("seq")
    ranked = lines.withColumn("rank", F.row_number().over(within) - 1)
    blocks = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.col("n") - F.when((F.col("start") == 0) & F.lit(header), 1).otherwise(0)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(kept).over(before), F.lit(0)))
    skipped = F.when((F.col("start") == 0) & F.lit(header), 1).otherwise(0)
    placed = ranked.join(blocks.drop("n"), ["file", "at"])
    if header:
        placed = placed.where((F.col("start") > 0) | (F.col("rank") > 0))
    return placed.select("value", (F.col("before") + F.col("rank") - skipped).cast("long").alias("number"))


def checked(points: DataFrame, nan_as_noise: bool = False) -> tuple[DataFrame, int]:
    """The points and their dimension, after one pass of aggregates over them.

    Raises InvalidPoints for null or repeated ids, null vectors, mixed dimensions and
    non-finite values; with ``nan_as_noise`` rows with a NaN pass (no distance to them is
    ever small, so they become noise).
    """
    infinite = F.exists("vec", lambda x: x.isNull() | (F.abs(x) == float("inf")) | (F.lit(not nan_as_noise) & F.isnan(x)))
    stats = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("id").isNull() | F.col("vec").isNull()).cast("int")).alias("null"),
        F.min(F.size("vec")).alias("low"),
        F.max(F.size("vec")).alias("high"),
        F.sum(infinite.cast("int")).alias("odd"),
    ).first()
    if not stats["n"]:
        return points, 0
    if stats["null"]:
        raise InvalidPoints(f"{stats['null']} points without id or vector")
    if stats["low"] != stats["high"] or stats["low"] < 1:
        raise InvalidPoints(f"dimensions from {stats['low']} to {stats['high']}")
    if stats["odd"]:
        raise InvalidPoints(f"{stats['odd']} points with non-finite values")
    if twice := duplicate_ids(points).limit(1).collect():
        raise InvalidPoints(f"id {twice[0]['id']} is not unique")
    return points, stats["low"]


def duplicate_ids(points: DataFrame) -> DataFrame:
    """(id, n) of ids that more than one row has."""
    return points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def result_lines(result: DataFrame) -> DataFrame:
    """(value): lines of id, cluster and [v1, v2, ...] with tabs between."""
    vec = F.concat(F.lit("["), F.array_join(F.transform("vec", lambda x: x.cast("string")), ", "), F.lit("]"))
    return result.select(F.concat_ws("\t", F.col("id").cast("string"), F.col("cluster_id").cast("string"), vec).alias("value"))


def write_result(result: DataFrame, path: str, form: str = "parquet") -> None:
    """(id, cluster_id, vec) to Parquet, or to lines of text (``tsv``), over any older output."""
    if form == "parquet":
        result.write.mode("overwrite").parquet(path)
    elif form == "tsv":
        result_lines(result).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such form: {form}")
