"""Parameters of a run, checked when they are made, and the files that hold them."""

from __future__ import annotations

import math
import os
import re
import sys
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ClusterParams:
    """``eps``: points closer than this are neighbours. ``min_pts``: neighbours of a core point,
    itself not counted. ``buckets``: histogram buckets a dimension. ``max_partition_size``:
    points that the planner aims at for a box, margins aside."""

    eps: float
    min_pts: int
    buckets: int = 128
    max_partition_size: int = 3000

    def __post_init__(self):
        if not (math.isfinite(self.eps) and self.eps > 0):
            raise ValueError("eps must be a positive number")
        for name in ("min_pts", "buckets", "max_partition_size"):
            value = getattr(self, name)
            if int(value) != value or value < 1:
                raise ValueError(f"{name} must be an integer of at least 1")

    @classmethod
    def from_mapping(cls, settings: dict[str, str]) -> ClusterParams:
        """From string settings; missing required ones are an error."""
        missing = [k for k in ("eps", "min_pts") if k not in settings]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        kinds = {"eps": float, "min_pts": int, "buckets": int, "max_partition_size": int}
        return cls(**{k: kinds[k](v) for k, v in settings.items() if k in kinds})


# The names of settings in job files, and what holds without a file.
JOB_KEYS = {
    "dbscan.epsilon": "eps",
    "dbscan.minpts": "min_pts",
    "dbscan.stage2.buckets": "buckets",
    "dbscan.stage3.size": "max_partition_size",
    "dbscan.csv.input": "input",
    "dbscan.csv.delim": "delimiter",
    "dbscan.csv.header": "header",
    "dbscan.csv.id": "with_id",
}
STAGE_KEY = re.compile(r"dbscan\.stage([1-9])\.output")
DEFAULTS = {
    "eps": "30000",
    "min_pts": "30",
    "buckets": "128",
    "max_partition_size": "3000",
    "input": "/dbscan/job1-in/10000data.csv",
    "delimiter": " ",
    "header": "false",
    "with_id": "true",
    **{f"stage{n}": f"/dbscan/job{n}-out" for n in range(1, 10)},
}


def parse_job(text: str) -> dict[str, str]:
    """Settings of a job file (``<configuration>`` of ``<property>`` with name and value).

    Unknown names are left out; of a name given twice the last value counts.
    """
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"not a job file: {e}") from e
    found: dict[str, str] = {}
    for entry in root.iter("property"):
        name, value = (entry.findtext("name") or "").strip(), entry.findtext("value")
        if value is None:
            continue
        if stage := STAGE_KEY.fullmatch(name):
            found[f"stage{stage[1]}"] = value.strip()
        elif name in JOB_KEYS:
            # A delimiter may be white space.
            found[JOB_KEYS[name]] = value if JOB_KEYS[name] == "delimiter" else value.strip()
    return found


def read_job(path: str, spark: SparkSession | None = None) -> dict[str, str]:
    """The settings of the job file at ``path``.

    A path with a scheme is read by Spark and must exist. A plain local path that doesn't
    exist gives the built-in settings, and a warning.
    """
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        if spark is None:
            raise ValueError(f"no session to read {path} with")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            raise FileNotFoundError(f"no such job file: {path}")
        return parse_job(spark.read.text(path, wholetext=True).first()[0])
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return parse_job(f.read())
    print(f"no job file at {path}: built-in settings are used", file=sys.stderr)
    return dict(DEFAULTS)


def truth(value: str) -> bool:
    if value.strip().lower() not in ("true", "false"):
        raise ValueError(f"neither true nor false: {value}")
    return value.strip().lower() == "true"


@dataclass(frozen=True)
class Job:
    """A run of stages: where points come from and where each stage's output goes."""

    params: ClusterParams
    input: str
    outputs: dict[int, str]
    delimiter: str = " "
    header: bool = False
    with_id: bool = True

    @classmethod
    def from_mapping(cls, settings: dict[str, str], output: str | None = None) -> Job:
        """From string settings; ``output`` is the folder of stages without one of their own.

        A missing input, or a stage without a place, is an error, and so are two stages (or
        the input and a stage) with the same path.
        """
        params = ClusterParams.from_mapping(settings)
        if not settings.get("input"):
            raise ValueError("missing settings: input")
        outputs = {}
        for n in range(1, 10):
            place = settings.get(f"stage{n}") or (f"{output.rstrip('/')}/stage{n}" if output else None)
            if place is None:
                raise ValueError(f"missing settings: output of stage {n}")
            outputs[n] = place.rstrip("/") or "/"
        paths = [settings["input"].rstrip("/"), *outputs.values()]
        if len(set(paths)) != len(paths):
            raise ValueError("input and stages must have paths of their own")
        kinds = {"header": truth, "with_id": truth}
        rest = {k: kinds[k](settings[k]) for k in kinds if k in settings}
        return cls(params, settings["input"], outputs, settings.get("delimiter", " "), **rest)
