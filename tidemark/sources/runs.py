"""Results kept by the hash of what made them: factor runs, regime runs, null distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import overwrite_partitions


def has_run(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether the partition of a run is there, by the file system alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/run_id={run_id}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def persist_run(df: DataFrame, root: str, run_id: str, force: bool = False) -> bool:
    """Writes a run's rows into its own partition; False where it is there already and not forced.

    A run that is written twice leaves one copy."""
    if not force and has_run(df.sparkSession, root, run_id):
        return False
    overwrite_partitions(df.withColumn("run_id", F.lit(run_id)), root, "run_id")
    return True


def load_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("run_id") == run_id).drop("run_id")


def cached(spark: SparkSession, root: str, run_id: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows kept under an identity, made and kept first where they are not there yet."""
    if not has_run(spark, root, run_id):
        persist_run(make(), root, run_id)
    return load_run(spark, root, run_id)


def long_betas(fit: DataFrame, factors: list[str], asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, factor, beta, alpha, r2, residual: one row per factor of each fit."""
    long = fit.select(ts, asset, "alpha", "r2", "residual", *[F.col(f"beta_{f}").alias(f) for f in factors])
    return long.unpivot([ts, asset, "alpha", "r2", "residual"], factors, "factor", "beta")


def fit_quality(betas: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, r2 and the number of factors of each stored fit."""
    return betas.groupBy(ts, asset).agg(F.avg("r2").alias("r2"), F.count("beta").alias("n_factors"))


def matches(stored: dict, asked: dict, keys: tuple[str, ...] = ("dataset_id", "freq", "window", "min_obs", "params")) -> bool:
    """Whether a stored run is the one that is asked for."""
    return all(stored.get(k) == asked.get(k) for k in keys)
