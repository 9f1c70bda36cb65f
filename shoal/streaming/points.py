"""Points that arrive as files: the same parsing on a stream, and running statistics of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators.stats import OPEN


def stream_points(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """(id, vec) from new ``*.csv`` files under ``path``, each line an id and numbers.

    Lines with no feature are skipped; a token that isn't a number stops the stream.
    """
    lines = spark.readStream.option("pathGlobFilter", "*.[cC][sS][vV]").text(path)
    tokens = F.split(F.trim("value"), re.escape(delimiter), -1)
    rows = lines.where(F.length(F.trim("value")) > 0).select(tokens.alias("tokens")).where(F.size("tokens") > 1)
    bad = lambda x, kind: F.raise_error(F.concat(F.lit("not a number: "), x)).cast(kind)
    parsed = lambda x, kind: F.coalesce(F.trim(x).try_cast(kind), F.when(F.trim(x).try_cast(kind).isNull(), bad(x, kind)))
    vec = F.transform(F.slice("tokens", 2, F.size("tokens")), lambda x: parsed(x, "double"))
    return rows.select(parsed(F.col("tokens")[0], "long").alias("id"), vec.alias("vec"))


def running_bounds(points: DataFrame) -> DataFrame:
    """(dim, n, lower, upper) of all points so far: state is one row a dimension."""
    values = points.select(F.posexplode("vec").alias("dim", "value")).where(~F.isnan("value"))
    return values.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lower"), (F.max("value") + F.lit(OPEN)).alias("upper"))
