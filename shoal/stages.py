"""The clustering in nine stages, each restartable from the saved outputs of earlier ones.

1 bounds, 2 histogram, 3 plan of boxes, 4 points to boxes, 5 clusters of each box, 6 copies
that join clusters, 7 distinct edges, 8 merged clusters, 9 a cluster for each point. Outputs
are Parquet; the last may be text. Core flags are those of home copies, so the result is the
same as that of ``cluster_points``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shoal.operators import assign, partitioned, stats
from shoal.params import Job
from shoal.plans.boxes import plan_from
from shoal.sources.points import checked, read_points, write_result

NAMES = ["bounds", "histogram", "plan", "partition", "local", "pairs", "edges", "merge", "relabel"]


class StageFailed(RuntimeError):
    """A stage that failed: its number and why."""

    def __init__(self, number: int, cause: Exception):
        super().__init__(f"stage {number} ({NAMES[number - 1]}) failed: {cause}")
        self.number = number


@dataclass(frozen=True)
class Stages:
    """The stages of a job; ``points`` reads the input where that isn't delimited text."""

    spark: SparkSession
    job: Job
    points: Callable[[], DataFrame] | None = None
    final: str = "parquet"

    def read(self, number: int) -> DataFrame:
        """The saved output of a stage."""
        return self.spark.read.parquet(self.job.outputs[number])

    def given(self) -> DataFrame:
        """The checked points."""
        job = self.job
        points = self.points() if self.points else read_points(self.spark, job.input, job.delimiter, job.header, job.with_id, regex=True)
        return checked(points)[0]

    def bounds(self) -> DataFrame:
        return stats.bounds(self.given())

    def histogram(self) -> DataFrame:
        return stats.histogram(self.given(), self.job.params.buckets, self.read(1))

    def plan(self) -> DataFrame:
        return plan_from(self.read(1), self.read(2), self.job.params)

    def partition(self) -> DataFrame:
        return assign.assign_partitions(self.given(), self.read(3), self.job.params.eps)

    def local(self) -> DataFrame:
        """(pid, id, tag, local_id, vec)."""
        assigned = self.read(4)
        first = assigned.select("vec").first()
        found = partitioned.local_clusters(assigned, len(first["vec"]) if first else 1, self.job.params, exact=True)
        return found.join(assigned.select("pid", "id", "vec"), ["pid", "id"])

    def pairs(self) -> DataFrame:
        return partitioned.copy_pairs(self.read(5))

    def edges(self) -> DataFrame:
        return partitioned.distinct_edges(self.read(6))

    def merge(self) -> DataFrame:
        return partitioned.cluster_map(self.read(5), self.read(7))

    def relabel(self) -> DataFrame:
        local = self.read(5)
        found = partitioned.relabelled(local, self.read(8))
        return found.join(local.select("id", "vec").dropDuplicates(["id"]), "id")

    def run(self, number: int) -> DataFrame:
        """Runs a stage, saves its output over any older one, and reads it back."""
        try:
            result = getattr(self, NAMES[number - 1])()
            where = self.job.outputs[number]
            if number == 9:
                write_result(result.select("id", "cluster_id", "vec"), where, self.final)
                return self.spark.read.text(where) if self.final == "tsv" else self.read(9)
            result.write.mode("overwrite").parquet(where)
            return self.read(number)
        except Exception as e:
            raise StageFailed(number, e) from e
