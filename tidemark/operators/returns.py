"""Returns, volatility, drawdown and momentum of long price panels: columns and per-asset features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import along, correlation, full, ln, slope, so_far, trailing
from tidemark.operators import gram, scan


def arithmetic_return(x: Column, asset: str = "asset", ts: str = "ts") -> Column:
    return F.try_divide(x, F.lag(x).over(along(asset, ts))) - 1


def log_return(x: Column, asset: str = "asset", ts: str = "ts") -> Column:
    """Difference of logarithms; NULL where either price is missing or not positive."""
    return ln(x) - ln(F.lag(x).over(along(asset, ts)))


def cumulative_return(r: Column, asset: str = "asset", ts: str = "ts") -> Column:
    """exp(running sum) - 1 of log returns; NULL where the return is."""
    return F.when(r.isNotNull(), F.exp(F.sum(r).over(so_far(asset, ts))) - 1)


def rolling_volatility(r: Column, n: int, asset: str = "asset", ts: str = "ts") -> Column:
    """Sample deviation of what there is of the last n rows."""
    return F.stddev_samp(r).over(trailing(n, asset, ts))


def annualized_volatility(r: Column, freq: str, n: int | None = None, asset: str = "asset", ts: str = "ts") -> Column:
    w = trailing(n, asset, ts) if n else Window.partitionBy(asset)
    return F.stddev_samp(r).over(w) * F.lit(scalars.periods_per_year(freq) ** 0.5)


def drawdown(cum: Column, asset: str = "asset", ts: str = "ts") -> Column:
    """Running maximum less the cumulative return: positive, in units of return."""
    return F.max(cum).over(so_far(asset, ts)) - cum


def drawdown_of_equity(equity: Column, asset: str = "asset", ts: str = "ts") -> Column:
    """Equity over its running maximum less 1: negative."""
    return F.try_divide(equity, F.max(equity).over(so_far(asset, ts))) - 1


def drawdown_of_log_returns(r: Column, asset: str = "asset", ts: str = "ts") -> Column:
    return drawdown_of_equity(F.exp(F.sum(r).over(so_far(asset, ts))), asset, ts)


def momentum(r: Column, n: int, asset: str = "asset", ts: str = "ts") -> Column:
    """exp(sum of the last n log returns) - 1; NULL until all n are there."""
    return F.exp(full(F.sum(r), r, n, trailing(n, asset, ts))) - 1


def change(x: Column, n: int, asset: str = "asset", ts: str = "ts") -> Column:
    return F.try_divide(x, F.lag(x, n).over(along(asset, ts))) - 1


def forward_return(panel: DataFrame, n: int, value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds ``fwd``: exp(sum of the next n observed log returns) - 1. Missing returns are left out first,
    so that n counts observations of the asset."""
    r = F.col(value)
    return panel.where(r.isNotNull()).withColumn("fwd", F.exp(full(F.sum(r), r, n, along(asset, ts).rowsBetween(1, n))) - 1)


def lookback_return(panel: DataFrame, n: int, value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """One row per asset: exp(sum of its last n non-null log returns) - 1, NULL where it has fewer."""
    seen = panel.where(F.col(value).isNotNull())
    last = seen.withColumn("rn", F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(ts)))).where(F.col("rn") <= n)
    return last.groupBy(asset).agg(F.when(F.count(value) == n, F.exp(F.sum(value)) - 1).alias("lookback_return"))


def max_drawdown(panel: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """One row per asset: the largest positive drawdown and the deepest drawdown of equity."""
    r = F.col(value)
    cum = panel.withColumn("cum", cumulative_return(r, asset, ts)).withColumn("eq", F.exp(F.sum(r).over(so_far(asset, ts))))
    dd = cum.withColumn("dd", drawdown(F.col("cum"), asset, ts)).withColumn("eqdd", drawdown_of_equity(F.col("eq"), asset, ts))
    return dd.groupBy(asset).agg(F.max("dd").alias("max_drawdown"), F.min("eqdd").alias("max_equity_drawdown"))


#: Days of a piece of a series in recursions over time.
PIECE_DAYS = 365


def exponential(panel: DataFrame, columns: dict[str, tuple[str, float]], asset: str = "asset", ts: str = "ts", days: int | None = PIECE_DAYS) -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha), seeded with the first value.

    Series are cut into pieces of ``days`` (see ``scan``); None leaves each in one.
    """
    return scan.exponential(panel, columns, asset, ts, scan.period(ts, days) if days else None)


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def trend_features(panel: DataFrame, price: str = "close", spans: tuple[int, int] = (20, 50), asset: str = "asset", ts: str = "ts", days: int | None = PIECE_DAYS) -> DataFrame:
    return exponential(panel, {f"ema{n}": (price, span_alpha(n)) for n in spans}, asset, ts, days)


def trend_and_rsi(panel: DataFrame, spans: tuple[int, ...] = (20, 50), price: str = "close", period: int = 14, asset: str = "asset", ts: str = "ts", days: int | None = PIECE_DAYS) -> DataFrame:
    """Adds the means of ``trend_features`` and ``rsi`` from one scan of the series.

    RSI is from exponentially weighted gains and losses of the period; NULL where losses are 0."""
    before = scan.lagged(panel, "_before", price, asset, ts, scan.period(ts, days) if days else None)
    d = F.col(price) - F.col("_before")
    moved = before.withColumn("gain", F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0))).withColumn("loss", F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0)))
    a = span_alpha(period)
    smooth = exponential(moved, {f"ema{n}": (price, span_alpha(n)) for n in spans} | {"avg_gain": ("gain", a), "avg_loss": ("loss", a)}, asset, ts, days)
    rs = F.when(F.col("avg_loss") > 0, F.try_divide("avg_gain", "avg_loss"))
    return smooth.withColumn("rsi", 100 - F.lit(100.0) / (1 + rs)).drop("_before", "gain", "loss", "avg_gain", "avg_loss")


def rsi(panel: DataFrame, price: str = "close", period: int = 14, asset: str = "asset", ts: str = "ts", days: int | None = PIECE_DAYS) -> DataFrame:
    """Adds ``rsi`` alone; see ``trend_and_rsi``."""
    return trend_and_rsi(panel, (), price, period, asset, ts, days)


def bar_metrics(panel: DataFrame, freq: str, window: int, price: str = "close", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds log_return, cum_return, roll_vol, ann_vol over one window specification."""
    r = F.col("log_return")
    out = panel.withColumn("log_return", log_return(F.col(price), asset, ts))
    return out.withColumns({"cum_return": cumulative_return(r, asset, ts), "roll_vol": rolling_volatility(r, window, asset, ts), "ann_vol": annualized_volatility(r, freq, window, asset, ts)})


def add_features(bars: DataFrame, freq: str, window: int, price: str = "close", liquidity: str | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """All per-asset features: returns, volatility, drawdown, momentum by horizon, trend and rsi."""
    out = bar_metrics(bars, freq, window, price, asset, ts)
    r = F.col("log_return")
    out = out.withColumn("drawdown", drawdown(F.col("cum_return"), asset, ts))
    out = out.withColumns({f"return_{k}": momentum(r, n, asset, ts) for k, n in scalars.period_return_bars(freq).items()})
    if liquidity:
        out = out.withColumn("liquidity_change", change(F.col(liquidity), scalars.bars_per_day(freq), asset, ts))
    return trend_and_rsi(out, price=price, asset=asset, ts=ts)


def with_factor(panel: DataFrame, factor: DataFrame, name: str = "factor", value: str = "log_return", ts: str = "ts") -> DataFrame:
    """The panel with the factor's return at each time; times that either side lacks go."""
    f = factor.select(ts, F.col(value).alias(name)).where(F.col(name).isNotNull())
    return panel.where(F.col(value).isNotNull()).join(f, ts)


def rolling_beta_corr(panel: DataFrame, factor: DataFrame, n: int, value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds beta and corr against the factor over the last n common rows of each asset."""
    both = with_factor(panel, factor, "factor", value, ts)
    x, y, w = F.col("factor"), F.col(value), trailing(n, asset, ts)
    enough = F.count(F.lit(1)).over(w) == n
    return both.withColumns({"beta": F.when(enough, slope(y, x, w)), "corr": F.when(enough, correlation(x, y, w))})


def excess_returns(panel: DataFrame, factor: DataFrame, betas: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds ``excess`` = r - beta * f and its cumulative return; ``betas`` has one row per asset."""
    out = with_factor(panel, factor, "factor", value, ts).join(betas.select(asset, "beta"), asset)
    out = out.withColumn("excess", F.col(value) - F.col("beta") * F.col("factor"))
    return out.withColumn("excess_cum", cumulative_return(F.col("excess"), asset, ts))


def ratio_series(left: DataFrame, right: DataFrame, value: str = "close", ts: str = "ts") -> DataFrame:
    """ts and ratio of two price series at common times; where it is not finite the row goes."""
    joined = left.select(ts, F.col(value).alias("l")).join(right.select(ts, F.col(value).alias("r")), ts)
    return joined.select(ts, F.try_divide("l", "r").alias("ratio")).where(F.col("ratio").isNotNull())


def dispersion(panel: DataFrame, value: str = "log_return", ts: str = "ts") -> DataFrame:
    """Cross-sectional sample deviation at each time; NULL where fewer than two assets have a value."""
    return panel.groupBy(ts).agg(F.stddev_samp(value).alias("dispersion"))


def dispersion_z(series: DataFrame, n: int, value: str = "dispersion", ts: str = "ts") -> DataFrame:
    """Adds ``z`` of the last n values. A series has one row per time, so one task orders it."""
    x, w = F.col(value), Window.orderBy(ts).rowsBetween(-(n - 1), 0)
    sd = full(F.stddev_samp(x), x, n, w)
    return series.withColumn("z", F.when(sd > 0, F.try_divide(x - F.avg(x).over(w), sd)))


def correlation_matrix(panel: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts", tiles: int = 4) -> DataFrame:
    """Pairs a <= b of assets with their pairwise-complete correlation and number of common rows; see ``gram``."""
    sums = gram.pair_sums(gram.centred(panel, value, asset), value, asset=asset, ts=ts, tiles=tiles)
    return sums.select("a", "b", gram.sample_correlation().alias("corr"), F.col("n").cast("long").alias("n"))


def lead_lag(signal: DataFrame, returns: DataFrame, lags: range | list[int] = range(-24, 25), least: int = 10, value: str = "value", ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Pooled correlation of the signal at t with the return lag rows later, for each lag."""
    both = signal.select(ts, asset, F.col(value).alias("s")).join(returns.select(ts, asset, F.col(ret).alias("r")), [ts, asset])
    lags = list(lags)
    w = along(asset, ts)
    shifted = both.withColumn("_all", F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("r", k) if k >= 0 else F.lag("r", -k)).over(w).alias("r")) for k in lags]))
    shifted = shifted.select("s", F.explode("_all").alias("x"))
    pairs = shifted.select("s", "x.lag", "x.r").where(F.col("s").isNotNull() & F.col("r").isNotNull())
    return pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("s"), F.col("r")).alias("corr")).select("lag", "n", F.when(F.col("n") >= least, F.col("corr")).alias("corr"))


def stability(pnl: DataFrame, n: int = 252, value: str = "pnl", ts: str = "ts") -> DataFrame:
    """One row: last rolling Sharpe, worst rolling sum, share of negative months, longest drawdown in rows."""
    x, w = F.col(value), Window.orderBy(ts).rowsBetween(-(n - 1), 0)
    whole = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    eq = pnl.withColumn("eq", F.sum(x).over(whole))
    marked = eq.withColumn("under", F.col("eq") < F.max("eq").over(whole))
    marked = marked.withColumn("run", F.sum((~F.col("under")).cast("int")).over(whole))
    marked = marked.withColumns({"roll_sharpe": F.when(F.count(x).over(w) == n, F.try_divide(F.avg(x).over(w), F.stddev_samp(x).over(w))), "roll_sum": full(F.sum(x), x, n, w)})
    runs = marked.where("under").groupBy("run").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest_drawdown"))
    months = pnl.groupBy(F.date_trunc("month", F.col(ts))).agg(F.sum(value).alias("m")).agg(F.avg((F.col("m") < 0).cast("double")).alias("negative_months"))
    last = marked.agg(F.max_by("roll_sharpe", ts).alias("last_sharpe"), F.min("roll_sum").alias("worst_sum"))
    return last.crossJoin(runs).crossJoin(months)


def regime_shift(bars: DataFrame, n: int = 24, value: str = "roll_vol", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Per asset: rising where the mean volatility of the last n rows is 1.2 times that of the n before."""
    ranked = bars.withColumn("rn", F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(ts)))).where(F.col("rn") <= 2 * n)
    per = ranked.groupBy(asset).agg(F.avg(F.when(F.col("rn") <= n, F.col(value))).alias("now"), F.avg(F.when(F.col("rn") > n, F.col(value))).alias("before"))
    r = F.try_divide("now", "before")
    return per.withColumn("shift", F.when(r.isNull(), "unknown").when(r >= 1.2, "rising").when(r <= 0.8, "falling").otherwise("stable"))
