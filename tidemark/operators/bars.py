"""Open-high-low-close bars from ticks or snapshots, coarser bars from finer ones, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import along, ln, so_far, trailing
from tidemark.operators.returns import cumulative_return, log_return, rolling_volatility


def bucket(ts: str, freq: str) -> Column:
    """The start of the interval that holds the time: left-closed, counted from UTC midnight."""
    return F.window(F.col(ts), scalars.interval(freq))["start"]


def ohlc(ticks: DataFrame, freq: str, price: str = "price", asset: str = "asset", ts: str = "ts", tie: str | None = None, size: str | None = None, last: tuple[str, ...] = ()) -> DataFrame:
    """Bars of positive prices; empty intervals have no bar.

    Open and close are the first and last by time, ties by ``tie``. ``last`` names columns of which a
    bar takes the last non-null value. One shuffle, with partial aggregation before it.
    """
    key = F.struct(ts, tie) if tie else F.col(ts)
    seen = ticks.where(F.col(price) > 0).withColumn("bar_ts", bucket(ts, freq))
    aggs = [F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count(F.lit(1)).alias("n_ticks")]
    aggs += [F.sum(size).alias("volume")] if size else []
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in last]
    return seen.groupBy(asset, "bar_ts").agg(*aggs).withColumnRenamed("bar_ts", ts)


def fill_both_ways(x: Column, asset: str = "asset", ts: str = "ts", causal: bool = False) -> Column:
    """The last value so far, else (unless ``causal``) the first one to come."""
    before = F.last(x, True).over(so_far(asset, ts))
    after = F.last(x, True).over(Window.partitionBy(asset).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0))  # see order.running
    return before if causal else F.coalesce(before, after)


def enriched(bars: DataFrame, window: int, fill: tuple[str, ...] = (), asset: str = "asset", ts: str = "ts", causal: bool = False) -> DataFrame:
    """Adds log_return, cum_return and roll_vol (of what there is); fills the ``fill`` columns."""
    r = F.col("log_return")
    out = bars.withColumn("log_return", log_return(F.col("close"), asset, ts))
    out = out.withColumns({"cum_return": cumulative_return(r, asset, ts), "roll_vol": rolling_volatility(r, window, asset, ts)})
    return out.withColumns({c: fill_both_ways(F.col(c), asset, ts, causal) for c in fill}) if fill else out


def materialize(snapshots: DataFrame, freq: str, window: int | None = None, price: str = "price", asset: str = "asset", ts: str = "ts", tie: str | None = None, liquidity: str | None = None, volume: str | None = None, causal: bool = False) -> DataFrame:
    """Bars with returns for every asset that has enough of them, in one job.

    An asset needs max(2, window + 1) bars; it goes if any price of a bar is not positive, if no
    volatility is known or if no liquidity is positive.
    """
    window = window or scalars.VOL_WINDOW.get(scalars.normalize_freq(freq), 48)
    extra = tuple(c for c in (liquidity, volume) if c)
    bars = enriched(ohlc(snapshots, freq, price, asset, ts, tie, last=extra), window, extra, asset, ts, causal)
    whole = Window.partitionBy(asset)
    bars = bars.withColumns({"n_bars": F.count(F.lit(1)).over(whole), "ok": F.max("roll_vol").over(whole).isNotNull() & (F.min("low").over(whole) > 0)})
    if liquidity:
        bars = bars.withColumn("ok", F.col("ok") & (F.max(liquidity).over(whole) > 0))
    return bars.where((F.col("n_bars") >= max(2, window + 1)) & F.col("ok")).drop("n_bars", "ok")


def coarser(bars: DataFrame, freq: str = "1D", last: tuple[str, ...] = (), window: int | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Rolls finer bars up: first open, highest high, lowest low, last close, last known ``last`` columns."""
    window = window or scalars.VOL_WINDOW.get(scalars.normalize_freq(freq), 48)
    key = F.col(ts)
    known = lambda c: F.when(F.col(c).isNotNull(), key)
    rolled = bars.withColumn("bar_ts", bucket(ts, freq)).groupBy(asset, "bar_ts").agg(
        F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", known("close")).alias("close"), *[F.max_by(c, known(c)).alias(c) for c in last]
    )
    return enriched(rolled.withColumnRenamed("bar_ts", ts), window, (), asset, ts)


def snapshots_as_bars(snapshots: DataFrame, freq: str, window: int, price: str = "price", asset: str = "asset", ts: str = "ts", tie: str | None = None, last: tuple[str, ...] = (), min_bars: int = 0) -> DataFrame:
    """Bars on the fly; here the volatility is NULL until the window is full."""
    r, w = F.col("log_return"), trailing(window, asset, ts)
    out = ohlc(snapshots, freq, price, asset, ts, tie, last=last).withColumn("log_return", log_return(F.col("close"), asset, ts))
    out = out.withColumns({"cum_return": cumulative_return(r, asset, ts), "roll_vol": F.when(F.count(r).over(w) == window, F.stddev_samp(r).over(w))})
    return min_bars_filter(out, min_bars, asset) if min_bars else out


def min_bars_filter(bars: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of the groups that have at least n rows; one shuffle, no join."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*(keys or ("asset",))))).where(F.col("_n") >= n).drop("_n")


def last_bars(bars: DataFrame, n: int, asset: str = "asset", ts: str = "ts") -> DataFrame:
    return bars.withColumn("_rn", F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(ts)))).where(F.col("_rn") <= n).drop("_rn")


def recomputed_returns(bars: DataFrame, close: str = "close", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """log_return from the row before; a missing or non-positive price breaks the chain on both sides."""
    return bars.withColumn("log_return", ln(F.col(close)) - ln(F.lag(close).over(along(asset, ts))))


def resampled_last(points: DataFrame, freq: str, value: str = "price", asset: str = "asset", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The last value of each interval that has one."""
    key = F.struct(ts, tie) if tie else F.col(ts)
    return points.groupBy(asset, bucket(ts, freq).alias("bar_ts")).agg(F.max_by(value, key).alias(value)).withColumnRenamed("bar_ts", ts)


def liquidity_drops(snapshots: DataFrame, threshold: float = 0.2, liquidity: str = "liquidity_usd", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Assets whose median liquidity of the last day is more than ``threshold`` below that of the days before.

    The last day is each asset's own."""
    day = snapshots.withColumn("_day", F.to_date(ts)).withColumn("_last", F.max(F.to_date(ts)).over(Window.partitionBy(asset)))
    per = day.groupBy(asset).agg(F.median(F.when(F.col("_day") == F.col("_last"), F.col(liquidity))).alias("last_median"), F.median(F.when(F.col("_day") < F.col("_last"), F.col(liquidity))).alias("before_median"))
    return per.withColumn("change", F.try_divide("last_median", "before_median") - 1).where(F.col("change") < -threshold)


def dense(panel: DataFrame, value: str, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The full grid of times and assets, with NULL where the panel has no row.

    Only operators whose rows count times of a shared index need it. Its size is times x assets. No two lists
    are crossed: each row spreads over the times up to its asset's next row, the first also back to the
    first time. Times are numbered by one task; they are few beside rows.
    """
    every = Window.partitionBy()
    times = panel.select(ts).where(F.col(ts).isNotNull()).distinct().withColumns({"_n": F.row_number().over(Window.orderBy(ts)), "_of": F.count(F.lit(1)).over(every)})
    w = Window.partitionBy(asset).orderBy("_n")
    own = panel.select(ts, asset, F.col(value).alias("_v")).join(times, ts)
    start = F.when(F.lag("_n").over(w).isNull(), F.lit(1)).otherwise(F.col("_n"))
    end = F.greatest(F.coalesce(F.lead("_n").over(w) - 1, F.col("_of").cast("int")), F.col("_n"))
    spread = own.withColumns({"_a": start, "_b": end}).select(asset, "_v", F.col("_n").alias("_own"), F.explode(F.sequence("_a", "_b")).alias("_n"))
    return spread.join(times.select("_n", ts), "_n").select(ts, asset, F.when(F.col("_n") == F.col("_own"), F.col("_v")).alias(value))
