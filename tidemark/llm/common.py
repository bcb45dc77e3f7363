"""Helpers that the corpus operators share: table access, scratch tables, fresh column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session, whose
    tasks all run here, gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = sc._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    ``put`` writes and rereads; ``drop`` deletes one that no later step reads. What is left
    goes when the driver ends, because results may still be read until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def again(self, df: DataFrame) -> DataFrame:
        """A second reading of a table that ``put`` wrote, for joins of a table with itself."""
        return self.spark.read.schema(df.schema).parquet(df._tidemark_path)

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._tidemark_path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # the session ended first; its files go with its shared folder
            pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, whatever columns a caller brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def held_out(doc_id) -> Column:
    """True for rows whose crc32 of the id as text leaves remainder 1 of 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
