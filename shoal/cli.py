"""Command line: the clustering in one go, or its nine stages, over text or Parquet points.

    python -m shoal.cli --job-conf=job.xml [--stage=1-9|all]
    python -m shoal.cli --input points/ --output out/ --eps 3 --min-pts 8 [--stage direct]

A stage (a number from 1 to 9, or its name) reads the saved outputs of earlier ones and saves
its own; ``all`` runs the nine in order. ``direct`` finds the same clusters on a grid, without
boxes and without outputs in between. Options override the job file's settings. The exit code
is 0, 1 for wrong usage, 2 for a stage that doesn't exist, and N if stage N failed (9: direct).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from shoal.operators import cluster
from shoal.params import Job, read_job
from shoal.session import reachable
from shoal.sources.points import points_from, read_points, write_result
from shoal.stages import NAMES, StageFailed, Stages


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="shoal", description=__doc__.splitlines()[0])
    parser.add_argument("--job-conf", "--jobConf")
    parser.add_argument("--stage")
    parser.add_argument("--input")
    parser.add_argument("--output", help="folder of stages without one of their own; of the result for direct")
    parser.add_argument("--eps")
    parser.add_argument("--min-pts")
    parser.add_argument("--buckets")
    parser.add_argument("--max-partition-size")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--delimiter")
    parser.add_argument("--literal-delimiter", action="store_true", help="the delimiter is no pattern")
    parser.add_argument("--header", action="store_const", const="true")
    parser.add_argument("--no-id", dest="with_id", action="store_const", const="false")
    parser.add_argument("--id-column", default="id")
    parser.add_argument("--feature-columns", default="vec", help="comma-separated columns, or one array column (Parquet)")
    parser.add_argument("--output-format", choices=["parquet", "tsv"], default="parquet")
    return parser


def stage_numbers(stage: str) -> list[int] | None:
    """The stages to run: none for direct, and no list for a stage that doesn't exist."""
    stage = stage.strip().lower()
    if stage == "all":
        return list(range(1, 10))
    if stage == "direct":
        return []
    if stage in NAMES:
        return [NAMES.index(stage) + 1]
    return [int(stage)] if stage in {str(n) for n in range(1, 10)} else None


def _points(spark: SparkSession, job: Job, given: argparse.Namespace) -> DataFrame:
    if given.format == "csv":
        return read_points(spark, job.input, job.delimiter, job.header, job.with_id, regex=not given.literal_delimiter)
    features = given.feature_columns.split(",")
    df = spark.read.parquet(job.input)
    array = len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array"
    return points_from(df, given.id_column, features[0] if array else features)


def main(args: list[str] | None = None) -> int:
    try:
        given = _parser().parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    stage = given.stage or ("all" if given.job_conf else "direct")
    if (numbers := stage_numbers(stage)) is None:
        print(f"no such stage: {stage}", file=sys.stderr)
        return 2
    spark = reachable(SparkSession.builder.appName("shoal").getOrCreate())
    try:
        settings = read_job(given.job_conf, spark) if given.job_conf else {}
        names = ["input", "eps", "min_pts", "buckets", "max_partition_size", "delimiter", "header", "with_id"]
        settings |= {n: getattr(given, n) for n in names if getattr(given, n) is not None}
        job = Job.from_mapping(settings, given.output)
    except (ValueError, OSError) as e:
        print(f"{e}\n{_parser().format_usage()}", file=sys.stderr)
        return 1
    stages = Stages(spark, job, lambda: _points(spark, job, given), given.output_format)
    try:
        for number in numbers:
            stages.run(number)
        if not numbers:
            result = cluster.cluster_points(_points(spark, job, given), job.params)
            write_result(result, given.output or job.outputs[9], given.output_format)
    except StageFailed as e:
        print(e, file=sys.stderr)
        return e.number
    except Exception as e:  # the message is what a caller of the command needs
        print(f"{stage} failed: {e}", file=sys.stderr)
        return 9
    return 0


if __name__ == "__main__":
    sys.exit(main())
