"""Data quality: bad prices, order of time, look-ahead, overlap, table summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bad_row_rate(df: DataFrame, columns: list[str], table: str = "table") -> DataFrame:
    """table, column, bad, total, rate: values that are missing or not positive, in percent."""
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull() | (F.col(c) <= 0)).alias(c) for c in columns])
    long = row.unpivot(["total"], columns, "column", "bad")
    return long.select(F.lit(table).alias("table"), "column", "bad", "total", F.coalesce(F.round(F.try_divide(F.col("bad") * 100.0, "total"), 6), F.lit(0.0)).alias("rate"))


def non_positive(df: DataFrame, columns: list[str], table: str = "table") -> DataFrame:
    return bad_row_rate(df, columns, table).where("bad > 0").select("table", "column", "bad")


def time_order(df: DataFrame, sequence: str, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """asset, n_backwards: how often time steps back in the order of ``sequence``."""
    back = F.lag(ts).over(Window.partitionBy(asset).orderBy(sequence)) > F.col(ts)
    return df.withColumn("_b", back).groupBy(asset).agg(F.count_if("_b").alias("n_backwards"))


def looks_ahead(signal: DataFrame, forward: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: whether the signal goes on after the last time that has a forward return."""
    return signal.agg(F.max(ts).alias("_s")).crossJoin(forward.agg(F.max(ts).alias("_f"))).select((F.col("_s") > F.col("_f")).alias("looks_ahead"))


def overlap(returns: DataFrame, signals: DataFrame, horizons: list[int], ts: str = "ts") -> DataFrame:
    """horizon, n_common, ok: common times must outnumber the horizon by two."""
    common = returns.select(ts).distinct().join(signals.select(ts).distinct(), ts).agg(F.count(F.lit(1)).alias("n_common"))
    return common.select(F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"), "n_common").withColumn("ok", F.col("n_common") - F.col("horizon") >= 2)


def table_summary(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, n_rows, min_ts, max_ts of tables with their time columns."""
    out = None
    for name, (df, ts) in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).cast("string").alias("min_ts"), F.max(ts).cast("string").alias("max_ts")).select(F.lit(name).alias("table"), "n_rows", "min_ts", "max_ts")
        out = one if out is None else out.unionByName(one)
    return out


def quality_filter(df: DataFrame, min_liquidity: float, min_volume: float, min_bars: int, base: str | None = None, quote: str | None = None, liquidity: str = "liquidity_usd", volume: str = "vol_h24", asset: str = "asset") -> DataFrame:
    """Liquidity and volume from their bounds up, enough bars, no stable pairs."""
    from tidemark.functions.scalars import is_stable_pair
    from tidemark.operators.bars import min_bars_filter

    out = df.where((F.col(liquidity) >= min_liquidity) & (F.col(volume) >= min_volume))
    if base and quote:
        out = out.where(~is_stable_pair(F.col(base), F.col(quote)))
    return min_bars_filter(out, min_bars, asset)
