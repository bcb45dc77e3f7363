"""Market regime features, detector and conditional summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cross_section import ic_summary


def features(panel: DataFrame, vol: int = 24, drawdown: int = 72, trend: int = 24, least: int = 12, ret: str = "log_return", ts: str = "ts") -> DataFrame:
    """ts, realized_vol, drawdown, trend_strength of the mean return over assets, from rows up to each time.

    The level compounds the log returns as simple ones, as published results of this kind do."""
    m = panel.where(F.col(ret).isNotNull()).groupBy(ts).agg(F.avg(ret).alias("r"))
    w = lambda n: Window.orderBy(ts).rowsBetween(-(n - 1), 0)
    enough = lambda c, n: F.count(c).over(w(n)) >= least
    m = m.withColumn("_c", F.product(1 + F.col("r")).over(Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))
    high = F.max("_c").over(w(drawdown))
    return m.select(
        ts,
        F.when(enough("r", vol), F.stddev_samp("r").over(w(vol))).alias("realized_vol"),
        F.when(enough("_c", drawdown) & (high > 0), F.try_divide(high - F.col("_c"), high)).alias("drawdown"),
        F.when(enough("r", trend), F.sum("r").over(w(trend))).alias("trend_strength"),
    )


def fit_detector(train: DataFrame, value: str = "realized_vol") -> DataFrame:
    """One row: the two thresholds between low, medium and high volatility, as linear percentiles."""
    return train.agg(F.percentile(value, F.lit(0.3333)).alias("low"), F.percentile(value, F.lit(0.6667)).alias("high"))


def predict(test: DataFrame, model: DataFrame, band: float = 0.05, value: str = "realized_vol", ts: str = "ts") -> DataFrame:
    """Adds regime; a missing value carries the label before it; medium before any.

    The model is one row and is broadcast. ``near_threshold`` tells values within ``band`` of one.
    """
    x = F.col(value)
    t = test.crossJoin(F.broadcast(model))
    label = F.when(x < F.col("low"), "low_vol").when(x > F.col("high"), "high_vol").when(x.isNotNull(), "med_vol")
    t = t.withColumn("_l", label)
    carried = F.coalesce(F.last("_l", True).over(Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)), F.lit("med_vol"))
    near = F.coalesce((F.abs(x - F.col("low")) <= band * F.col("low")) | (F.abs(x - F.col("high")) <= band * F.col("high")), F.lit(False))
    return t.select(*test.columns, carried.alias("regime"), near.alias("near_threshold"))


def attach(frame: DataFrame, regimes: DataFrame, ts: str = "ts") -> DataFrame:
    """Exact left join on time, unknown where there is none; of a time's labels the least counts."""
    one = regimes.groupBy(ts).agg(F.min("regime").alias("regime"))
    return frame.join(one, ts, "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def ic_by_regime(ic: DataFrame, regimes: DataFrame, *by: str, ts: str = "ts", unknown: bool = False) -> DataFrame:
    """regime (and by...): mean, std, t and n; fewer than two give NULLs."""
    j = attach(ic, regimes, ts)
    j = j if unknown else j.where("regime <> 'unknown'")
    s = ic_summary(j, "regime", *by)
    ok = F.col("n_obs") >= 2
    return s.select("regime", *by, *[F.when(ok, F.col(c)).alias(c) for c in ("mean_ic", "std_ic", "t_stat")], "n_obs")


def ic_by_regime_and_horizon(ic: DataFrame, regimes: DataFrame, ts: str = "ts", unknown: bool = False) -> DataFrame:
    """regime, horizon, mean, std, t and n of coefficients by horizon (see ``cross_section.ic_by_horizon``)."""
    return ic_by_regime(ic, regimes, "horizon", ts=ts, unknown=unknown)


def decay_by_regime(ic: DataFrame, regimes: DataFrame, ts: str = "ts", unknown: bool = False) -> DataFrame:
    """The same with the horizon as ``horizon_bars``, in order of regime and horizon."""
    return ic_by_regime_and_horizon(ic, regimes, ts, unknown).withColumnRenamed("horizon", "horizon_bars").orderBy("regime", "horizon_bars")


def coverage(regimes: DataFrame) -> DataFrame:
    """One row: n, n_unknown, pct_available and the number of rows of each label, in order."""
    per = regimes.groupBy(F.coalesce("regime", F.lit("unknown")).alias("regime")).count()
    return per.agg(
        F.sum("count").alias("n"),
        F.coalesce(F.sum(F.when(F.col("regime") == "unknown", F.col("count"))), F.lit(0)).alias("n_unknown"),
        (1 - F.try_divide(F.coalesce(F.sum(F.when(F.col("regime") == "unknown", F.col("count"))), F.lit(0)), F.sum("count"))).alias("pct_available"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "count"))))).alias("distribution"),
    )


def from_percentile(panel: DataFrame, value: str = "vol", by: str = "asset") -> DataFrame:
    """Adds regime by the percentage rank of volatility within each asset: Low below .33, Mid to .66, High."""
    from tidemark.functions.windows import percent_rank_average

    r = percent_rank_average(F.col(value), by)
    return panel.withColumn("regime", F.when(r < 0.33, "Low").when(r <= 0.66, "Mid").when(r.isNotNull(), "High"))
