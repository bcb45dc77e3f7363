"""Interactive scans: top assets by momentum, breakout, reversion or residual return, with metrics and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import correlation, slope, so_far, trailing
from tidemark.operators.bars import last_bars
from tidemark.operators.cross_section import combine_linear, factor_frame
from tidemark.operators.factors import grouped_ols, residual_returns
from tidemark.operators.portfolio import capacity_and_slippage
from tidemark.operators.returns import lookback_return

MODES = ("momentum", "residual_momentum", "volatility_breakout", "mean_reversion", "multifactor")


def _last(bars: DataFrame, n: int, asset: str, ts: str) -> DataFrame:
    return bars.withColumn("_rn", F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(ts)))).where(F.col("_rn") <= n)


def momentum(bars: DataFrame, freq: str, top: int, n: int | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The last close over the first of the last n bars (n - 1 steps), largest first."""
    n = n or scalars.bars_for_hours(freq, 24)
    per = _last(bars, n, asset, ts).groupBy(asset).agg(F.count(F.lit(1)).alias("_n"), (F.try_divide(F.max_by("close", ts), F.min_by("close", ts)) - 1).alias("return_24h"), F.max_by("close", ts).alias("close"))
    return per.where("_n >= 2").drop("_n").orderBy(F.desc("return_24h"), asset).limit(top)


def _z(bars: DataFrame, n: int, asset: str, ts: str) -> DataFrame:
    """Per asset over its last n + 50 bars: z of the last return, slope of volatility, recent gains."""
    tail = _last(bars.where("log_return is not null"), n + 50, asset, ts)
    vol = F.stddev_samp("log_return").over(trailing(n, asset, ts))
    tail = tail.withColumn("_vol", vol).withColumn("_slope", F.col("_vol") - F.lag("_vol").over(Window.partitionBy(asset).orderBy(ts)))
    return tail.groupBy(asset).agg(F.count(F.lit(1)).alias("_n"), F.max_by("log_return", ts).alias("last_return"), F.avg("log_return").alias("_m"), F.stddev_samp("log_return").alias("_s"), F.max_by("_slope", ts).alias("vol_slope"), F.max_by("close", ts).alias("close"), F.count_if((F.col("_rn") <= 6) & (F.col("log_return") > 0)).alias("_gains")).where(F.col("_n") >= n).withColumn("return_zscore", F.when(F.col("_s") > 0, F.try_divide(F.col("last_return") - F.col("_m"), "_s")))


def volatility_breakout(bars: DataFrame, top: int, z: float = 2.0, n: int = 24, liquidity: str | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Returns of z deviations and more while volatility rises and liquidity holds 80% of its first value."""
    found = _z(bars, n, asset, ts).where((F.col("return_zscore") >= z) & (F.coalesce("vol_slope", F.lit(0.0)) > 0))
    if liquidity:
        liq = _last(bars.where(F.col(liquidity).isNotNull()), n + 50, asset, ts).groupBy(asset).agg(F.max_by(liquidity, ts).alias("_a"), F.min_by(liquidity, ts).alias("_b"))
        found = found.join(liq, asset, "left").where(F.coalesce(F.col("_a") >= 0.8 * F.col("_b"), F.lit(True)))
    return found.select(asset, "return_zscore", "last_return", "close").orderBy(F.desc("return_zscore"), asset).limit(top)


def mean_reversion(bars: DataFrame, top: int, z: float = -2.0, n: int = 24, least_gains: int = 1, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Falls of |z| deviations and more with some gain among the last bars, deepest first."""
    found = _z(bars, n, asset, ts).where((F.col("return_zscore") <= -abs(z)) & (F.col("_gains") >= least_gains))
    return found.select(asset, "return_zscore", "last_return", "close").orderBy("return_zscore", asset).limit(top)


def residuals(panel: DataFrame, factors: list[str], asset: str = "asset") -> DataFrame:
    return residual_returns(panel, grouped_ols(panel, factors, asset), factors, asset=asset)


def residual_momentum(panel: DataFrame, factors: list[str], freq: str, top: int, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Largest return of the last day that the factors do not explain."""
    r = residuals(panel, factors, asset)
    return lookback_return(r, scalars.bars_for_hours(freq, 24), "residual", asset, ts).where("lookback_return is not null").orderBy(F.desc("lookback_return"), asset).limit(top)


def multifactor(bars: DataFrame, weights: dict[str, float], top: int, liquidity: str, volume: str, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The combined factors at the last time, largest first."""
    signal = combine_linear(factor_frame(bars, liquidity=liquidity, volume=volume, asset=asset, ts=ts), weights, asset, ts)
    last = signal.agg(F.max(ts).alias(ts))
    return signal.join(F.broadcast(last), ts).where("signal is not null").orderBy(F.desc("signal"), asset).limit(top)


def trading_metrics(panel: DataFrame, freq: str, factor: str = "factor", short: int = 24, long: int = 72, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """One row per asset at its last bar: return and excess return of a day, volatility, Sharpe, drawdown,
    short and long beta and correlation, their state, and the regime of volatility."""
    year = scalars.periods_per_year(freq) ** 0.5
    n = scalars.bars_for_hours(freq, 24)
    r, f, whole = F.col("log_return"), F.col(factor), Window.partitionBy(asset)
    over = lambda k: trailing(k, asset, ts)
    p = panel.withColumns(
        {
            "_eq": F.exp(F.sum(r).over(so_far(asset, ts))),
            "_bs": slope(r, f, over(short)),
            "_bl": slope(r, f, over(long)),
            "_cs": correlation(r, f, over(short)),
            "_vs": F.stddev_samp(r).over(over(short)),
            "_vm": F.stddev_samp(r).over(over(2 * short)),
            "_b": slope(r, f, whole),
            "_rn": F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(ts))),
        }
    )
    p = p.withColumn("_dd", F.try_divide("_eq", F.max("_eq").over(so_far(asset, ts))) - 1)
    day = F.col("_rn") <= n
    m = p.groupBy(asset).agg(
        (F.exp(F.sum(F.when(day, r))) - 1).alias("return_24h"),
        (F.exp(F.sum(F.when(day, r - F.col("_b") * f))) - 1).alias("excess_24h"),
        (F.stddev_samp(r) * year).alias("annual_vol"),
        F.when(F.stddev_samp(r) > 0, F.try_divide(F.avg(r), F.stddev_samp(r)) * year).alias("annual_sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.max_by("_bs", ts).alias("beta_short"),
        F.max_by("_bl", ts).alias("beta_long"),
        F.max_by("_cs", ts).alias("corr_short"),
        F.max_by("_vs", ts).alias("vol_short"),
        F.max_by("_vm", ts).alias("vol_medium"),
        F.count(F.lit(1)).alias("n_bars"),
    )
    return m.withColumns({"beta_compression": F.col("beta_long") - F.col("beta_short"), "beta_state": scalars.beta_state(F.col("beta_short"), F.col("beta_long")), "vol_regime": scalars.vol_regime(F.col("vol_short"), F.col("vol_medium"))})


def run(panel: DataFrame, mode: str, freq: str, top: int, factor: str = "factor", liquidity: str | None = None, min_corr: float | None = None, min_beta: float | None = None, asset: str = "asset", ts: str = "ts", **options) -> DataFrame:
    """A scan with the metrics of what it found, its capacity and the reasons against each; an unknown
    mode raises. The scan's few rows are joined to the metrics of those assets alone."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    found = {
        "momentum": lambda: momentum(panel, freq, top, asset=asset, ts=ts, **options),
        "residual_momentum": lambda: residual_momentum(panel, [factor], freq, top, asset, ts),
        "volatility_breakout": lambda: volatility_breakout(panel, top, liquidity=liquidity, asset=asset, ts=ts, **options),
        "mean_reversion": lambda: mean_reversion(panel, top, asset=asset, ts=ts, **options),
        "multifactor": lambda: multifactor(panel, top=top, asset=asset, ts=ts, **options),
    }[mode]()
    chosen = panel.join(found.select(asset), asset, "left_semi")
    metrics = trading_metrics(chosen, freq, factor, asset=asset, ts=ts)
    out = found.join(metrics.drop(*[c for c in found.columns if c != asset]), asset, "left")
    if liquidity:
        out = capacity_and_slippage(out.join(last_bars(chosen, 1, asset, ts).select(asset, liquidity), asset, "left"), liquidity)
    checks = []
    if min_corr is not None:
        checks.append(F.when(~F.coalesce(F.col("corr_short") >= min_corr, F.lit(False)), F.lit("correlation too low")))
    if min_beta is not None:
        checks.append(F.when(~F.coalesce(F.col("beta_short") >= min_beta, F.lit(False)), F.lit("beta too low")))
    return out.withColumn("reasons", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def leaderboards(metrics: DataFrame, top: int = 10, asset: str = "asset") -> dict[str, DataFrame]:
    """The heads of the daily lists, each a top-k of one metrics table."""
    order = {"momentum": F.desc_nulls_last("return_24h"), "volatility": F.desc_nulls_last("annual_vol"), "residual": F.desc_nulls_last("excess_24h"), "drawdown": F.asc_nulls_last("max_drawdown")}
    return {name: metrics.orderBy(o, asset).limit(top) for name, o in order.items()}


def valuable_assets(panel: DataFrame, floor: float, liquidity: str = "liquidity_usd", z: str = "z", asset: str = "asset") -> DataFrame:
    """Assets by median liquidity times the rate of shocks (z below -2): enough at the tenth percentile,
    under a tenth missing, not above the 95th percentile of medians; the ten best."""
    x = F.col(liquidity)
    per = panel.groupBy(asset).agg(F.median(x).alias("median"), F.percentile(x, F.lit(0.1)).alias("p10"), F.avg((x.isNull() | (x <= 0)).cast("double")).alias("missing"), F.avg((F.col(z) < -2).cast("double")).alias("rate"))
    per = per.withColumn("_cap", F.percentile("median", F.lit(0.95)).over(Window.partitionBy()))
    good = per.where((F.col("p10") >= floor) & (F.col("missing") < 0.1) & (F.col("median") <= F.col("_cap")))
    return good.withColumn("score", F.col("rate") * F.col("median")).drop("_cap").orderBy(F.desc("score"), asset).limit(10)


def parameter_grid(df: DataFrame, grid: dict[str, list], most: int = 5) -> DataFrame:
    """Every row once for each combination of the values, which become columns; at most ``most`` values a name.

    A metric over all combinations is then one aggregation by the names, whatever their number."""
    for name, values in grid.items():
        if len(values) > most:
            raise ValueError(f"more than {most} values of {name}")
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def sensitivity(panel: DataFrame, grid: dict[str, list], **metrics: Column) -> DataFrame:
    """The metrics, aggregates that may use the grid's names, of every combination of its values."""
    return parameter_grid(panel, grid).groupBy(*grid).agg(*[m.alias(n) for n, m in metrics.items()])
