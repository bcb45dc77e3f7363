"""The driver's tables as ticks, bars and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import ohlc
from tidemark.operators.returns import log_return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").alias("price"), F.col("value").alias("size"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars; liquidity_usd is a proxy, the last JSON number of the hour."""
    return ohlc(ticks(spark, sf_dir), "1h", size="size", last=("k",)).withColumnRenamed("k", "liquidity_usd")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("log_return", log_return(F.col("close")))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with one asset per user, for cross-sections of many assets."""
    t = table(spark, sf_dir, "events").select(F.format_string("u%05d", "user_id").alias("asset"), "ts", F.col("value").alias("price"), F.col("value").alias("size"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return ohlc(t, "1D", size="size", last=("k",)).withColumnRenamed("k", "liquidity_usd").withColumn("log_return", log_return(F.col("close")))


def with_market(spark: SparkSession, sf_dir: str, factor: str = "click", second: str | None = None) -> DataFrame:
    """Hourly returns with those of one or two event types as factors."""
    from tidemark.operators.factors import factor_columns

    return factor_columns(returns(spark, sf_dir), {"factor": factor} | ({"factor2": second} if second else {}))
