"""What a session needs so that Python workers find this package and hold little at a time."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows that Python workers take at once, where the session has Spark's default of ten thousand: rows may be long texts.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Puts the repository on the path of workers that start from now on, wherever the driver was started,
    and bounds their batches unless the session has a bound of its own.

    On a cluster whose machines do not share it, submit the package with --py-files instead.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    return spark


def checkpoints(spark: SparkSession) -> SparkSession:
    """Sees that checkpoints have a folder: that of spark.checkpoint.dir, or a temporary one in a local
    session, whose tasks all run here; on a cluster without the setting it raises."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidemark-"))
    return spark


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share; it goes when the driver ends."""
    path = f"{checkpoints(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
