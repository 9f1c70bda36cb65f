"""What the package needs of a session: a path for Python workers, a place for checkpoints."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Seconds between two collections of garbage after checkpoints, at least.
SWEEP_SECONDS = 2.0
_swept = [0.0]


def reachable(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the Python workers' path.

    It suffices where executors see that folder; elsewhere the package must be installed or
    shipped with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def is_local(master: str) -> bool:
    """Whether all executors are threads of this process."""
    return master == "local" or master.startswith("local[")


def _checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder to the session's ``spark.checkpoint.dir``.

    Only where that is unset, and only on a local master, a temporary folder is set instead;
    it goes when the process ends.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not is_local(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shoal-checkpoint-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    context.setCheckpointDir(where)


def sweep(spark: SparkSession) -> None:
    """Collects garbage, upon which Spark deletes shuffle files that nothing refers to any more,
    and checkpoints where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _swept[0] = time.monotonic()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    Garbage is collected now and then, so that files of what is no longer needed go.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        _checkpoints(spark)
    done = df.checkpoint()
    if time.monotonic() - _swept[0] >= SWEEP_SECONDS:
        sweep(spark)
    return done
