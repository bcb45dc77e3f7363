"""Folds, walk-forward runs, strategies and performance measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import along, so_far, trailing
from tidemark.operators.bars import dense
from tidemark.operators.portfolio import FEE_BPS, SLIPPAGE_BPS
from tidemark.operators.returns import exponential, log_return, span_alpha


def numbered_times(panel: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct times with their position from 0. Times are few beside rows: one task orders them."""
    return panel.select(ts).where(F.col(ts).isNotNull()).distinct().withColumn("pos", F.row_number().over(Window.orderBy(ts)) - 1)


def walk_forward_folds(panel: DataFrame, train: int, test: int, step: int, expanding: bool = False, purge: int = 0, embargo: int = 0, ts: str = "ts") -> DataFrame:
    """fold_id, train_start, train_end, test_start, test_end over the panel's times.

    Purge and embargo both put times between training and test. No fold whose test would be short.
    """
    times = numbered_times(panel, ts)
    gap = purge + embargo
    n = times.agg((F.count(F.lit(1))).alias("n"))
    last = F.col("n") - (train + gap + test)
    ids = n.where(last >= 0).select(F.explode(F.sequence(F.lit(0), F.floor(last / step).cast("int"))).alias("fold_id"))
    k = F.col("fold_id") * step
    ends = ids.select("fold_id", F.lit(0).alias("p0") if expanding else k.alias("p0"), (k + train - 1).alias("p1"), (k + train + gap).alias("p2"), (k + train + gap + test - 1).alias("p3"))
    out = ends
    for p, name in (("p0", "train_start"), ("p1", "train_end"), ("p2", "test_start"), ("p3", "test_end")):
        out = out.join(times.select(F.col("pos").alias(p), F.col(ts).alias(name)), p)
    return out.select("fold_id", "train_start", "train_end", "test_start", "test_end")


def purged_folds(panel: DataFrame, min_train: int, horizon: int, embargo: int = 0, step: int = 1, ts: str = "ts") -> DataFrame:
    """Folds whose training begins with the first time and grows by ``step``; the test of ``horizon`` times
    begins ``embargo`` times after its end. No fold where the times do not suffice."""
    if min_train < 1 or horizon < 1:
        raise ValueError("training and test have one time at least")
    return walk_forward_folds(panel, min_train, horizon, max(1, step), expanding=True, embargo=embargo, ts=ts)


#: Seconds of a bucket by which rows meet folds.
BUCKET = 7 * 86_400


def _bucket(x: Column) -> Column:
    return F.floor(F.unix_seconds(x.cast("timestamp")) / BUCKET)


def by_fold(panel: DataFrame, folds: DataFrame, ts: str = "ts") -> DataFrame:
    """Each row once for each fold that has it in training or test, with ``part``; training goes first.

    Rows and the ranges of folds meet by buckets of time, an equality that Spark can hash or broadcast, and are
    compared exactly there. A range stands once in each of its buckets.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("_low"), F.col(f"{p}_end").alias("_high")) for p in ("train", "test")])).alias("_r")
    ranges = folds.select("*", parts).select("*", "_r.part", "_r._low", "_r._high").drop("_r").where("_low is not null and _high is not null and _low <= _high")
    spread = ranges.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_low")), _bucket(F.col("_high")))))
    t = F.col(ts)
    met = panel.withColumn("_k", _bucket(t)).join(spread, F.col("_k") == F.col("_b")).where((t >= F.col("_low")) & (t <= F.col("_high")))
    in_training = (t >= F.col("train_start")) & (t <= F.col("train_end"))
    return met.where((F.col("part") == "train") | ~F.coalesce(in_training, F.lit(False))).drop("_k", "_b", "_low", "_high")


def causality_violations(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Folds with a training row after the end of training or at or after the start of the test."""
    late = (F.col("part") == "train") & ((F.col(ts) > F.col("train_end")) | (F.col(ts) >= F.col("test_start")))
    return rows.groupBy("fold_id").agg(F.count_if(late).alias("n_late")).where("n_late > 0")


def run_walk_forward(panel: DataFrame, folds: DataFrame, fit, score, ts: str = "ts") -> DataFrame:
    """``fit(train)`` gives one row per fold, ``score(test joined with it)`` the result; training rows that
    reach into a test raise."""
    rows = by_fold(panel, folds, ts)
    bad = causality_violations(rows, ts).limit(1).collect()
    if bad:
        raise ValueError(f"fold {bad[0]['fold_id']} trains on rows that it should not know")
    return score(rows.where("part = 'test'").join(fit(rows.where("part = 'train'")), "fold_id"))


def sign_calibrated(signal: DataFrame, ic: DataFrame, folds: DataFrame, least_ic: float = 0.0, least_n: int = 10, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The signal times the sign of its mean coefficient in training, within each fold's test; unchanged
    where that is too small or rests on too few times. Overlapping tests multiply."""
    trained = by_fold(ic, folds, ts).where("part = 'train'").groupBy("fold_id").agg(F.avg("ic").alias("m"), F.count("ic").alias("n"))
    signs = folds.join(trained, "fold_id").select("test_start", "test_end", F.when((F.col("n") >= least_n) & (F.abs("m") >= least_ic) & (F.col("m") < 0), -1.0).otherwise(1.0).alias("s"))
    # what a time's tests say is one number, found among the times alone
    tests = signs.withColumns({"train_start": F.lit(None).cast(folds.schema["test_start"].dataType), "train_end": F.lit(None).cast(folds.schema["test_start"].dataType)})
    turns = by_fold(signal.select(ts).distinct(), tests, ts).groupBy(ts).agg(F.product("s").alias("s"))
    return signal.join(turns, ts, "left").select(ts, asset, (F.col("value") * F.coalesce("s", F.lit(1.0))).alias("value"))


def trend_strategy(bars: DataFrame, fast: int = 20, slow: int = 50, vol_window: int = 24, vol_max: float | None = None, position: float = 0.25, fee_bps: float = FEE_BPS, slippage_bps: float | None = SLIPPAGE_BPS, liquidity: str | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Long while the fast mean is above the slow one: position, gross, cost, net and equity of each asset.

    A position earns from the next bar; costs fall on its change. Assets need slow + 5 bars.
    """
    enough = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(asset))).where(F.col("_n") >= slow + 5).drop("_n")
    e = exponential(enough, {"fast": ("close", span_alpha(fast)), "slow": ("close", span_alpha(slow))}, asset, ts)
    e = e.withColumn("r", log_return(F.col("close"), asset, ts))
    long = F.col("fast") > F.col("slow")
    if vol_max is not None:
        long = long & F.coalesce(F.stddev_samp("r").over(trailing(vol_window, asset, ts)) < vol_max, F.lit(False))
    e = e.withColumn("position", F.when(long, F.lit(position)).otherwise(F.lit(0.0)))
    before = F.coalesce(F.lag("position").over(along(asset, ts)), F.lit(0.0))
    slip = F.lit(slippage_bps) if slippage_bps is not None else scalars.slippage_bps(F.col(liquidity) if liquidity else F.lit(None).cast("double"))
    e = e.withColumns({"gross": before * F.col("r"), "cost": F.abs(F.col("position") - before) * (F.lit(fee_bps) + slip) / 10_000})
    e = e.withColumn("net", F.coalesce(F.col("gross") - F.col("cost"), F.lit(0.0)))
    e = e.withColumn("trade", F.when(F.col("position") > before, "long").when(F.col("position") < before, "exit"))
    return e.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(so_far(asset, ts)))).drop("fast", "slow", "r")


def mean_equity(equity: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, equity: mean over assets on the grid of all times, each filled forwards, then backwards."""
    from tidemark.operators.bars import fill_both_ways

    full = dense(equity, "equity", asset, ts)
    return full.withColumn("equity", fill_both_ways(F.col("equity"), asset, ts)).groupBy(ts).agg(F.avg("equity").alias("equity"))


def breakout_strategy(bars: DataFrame, z_entry: float = 2.0, stop: float = 0.05, vol_window: int = 24, position: float = 0.25, fee_bps: float = FEE_BPS, slippage_bps: float = SLIPPAGE_BPS, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Long on a return of ``z_entry`` deviations until the price falls ``stop`` below its high since.

    Whether a bar is held depends on the path, so each asset's ordered bars go through Python once.
    """
    r = log_return(F.col("close"), asset, ts)
    w = trailing(vol_window, asset, ts)
    z = bars.withColumn("r", r).withColumn("z", F.when(F.count("r").over(w) == vol_window, F.try_divide(F.col("r") - F.avg("r").over(w), F.stddev_samp("r").over(w))))
    schema = z.select("*", *[F.lit(0.0).alias(c) for c in ("position", "net", "equity")]).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ts, kind="stable").reset_index(drop=True)
        close, zs, ret = (part[c].astype("float64").to_numpy() for c in ("close", "z", "r"))
        pos, high, held = np.zeros(len(part)), 0.0, False
        for i in range(len(part)):
            if held:
                high = max(high, close[i])
                held = close[i] > high * (1 - stop)
            elif zs[i] >= z_entry:
                held, high = True, close[i]
            pos[i] = position if held else 0.0
        before = np.concatenate([[0.0], pos[:-1]])
        part["position"] = pos
        part["net"] = np.nan_to_num(before * ret) - np.abs(pos - before) * (fee_bps + slippage_bps) / 10_000
        part["equity"] = np.cumprod(1 + part["net"])
        return part

    return z.groupBy(asset).applyInPandas(run, schema)


def performance(equity: DataFrame, freq: str, *by: str, value: str = "equity", ts: str = "ts") -> DataFrame:
    """Per series: total return, CAGR by calendar years, volatility, Sharpe, Sortino (deviation of losing
    returns), absolute drawdown of the compounded returns, win rate, mean win and loss, rows. A series that does not
    move has volatility 0 and no Sharpe."""
    year = scalars.periods_per_year(freq)
    w = Window.partitionBy(*by).orderBy(ts)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    r = F.try_divide(F.col(value), F.lag(value).over(w)) - 1
    e = equity.withColumn("_r", r).withColumn("_c", F.exp(F.sum(F.log1p("_r")).over(back))).withColumn("_c", F.when(F.col("_r").isNotNull(), F.col("_c")))
    e = e.withColumn("_d", F.max("_c").over(back) - F.col("_c"))
    x = F.col("_r")
    sd, down = F.stddev_samp(x), F.stddev_samp(F.when(x < 0, x))
    years = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / F.lit(365.25 * 86400 * 1e6)
    total = F.try_divide(F.max_by(value, ts), F.min_by(value, ts)) - 1
    return e.groupBy(*by).agg(
        total.alias("total_return"),
        F.when(years > 0, F.pow(1 + total, F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"),
        (sd * year**0.5).alias("vol_annual"),
        F.when(sd > 0, F.try_divide(F.avg(x), sd) * year**0.5).alias("sharpe"),
        F.when(down > 0, F.try_divide(F.avg(x), down) * year**0.5).alias("sortino"),
        F.max("_d").alias("max_drawdown"),
        F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(x > 0, x)).alias("avg_win"),
        F.avg(F.when(x < 0, x)).alias("avg_loss"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def sharpe(r: Column, periods: float) -> Column:
    sd = F.stddev_samp(r)
    return F.when(sd > 0, F.try_divide(F.avg(r), sd) * periods**0.5)


def sortino(r: Column, periods: float) -> Column:
    """Mean over the root of the mean squared loss."""
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    return F.when(down > 0, F.try_divide(F.avg(r), down) * periods**0.5)


def downside_deviation(r: Column, periods: float) -> Column:
    return F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))) * periods**0.5


def conditional_metrics(pnl: DataFrame, regimes: DataFrame, value: str = "pnl", ts: str = "ts") -> DataFrame:
    """Per regime: Sharpe per bar, CAGR proxy (252 periods), deepest drawdown of the regime's own
    compounded rows, hit rate, mean, n."""
    j = pnl.join(regimes.select(ts, "regime"), ts).where(F.col(value).isNotNull())
    back = Window.partitionBy("regime").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_c", F.exp(F.sum(F.log1p(value)).over(back))).withColumn("_d", F.try_divide("_c", F.max("_c").over(back)) - 1)
    x = F.col(value)
    sd = F.stddev_samp(x)
    return j.groupBy("regime").agg(F.when(sd > 0, F.try_divide(F.avg(x), sd)).alias("sharpe"), (F.pow(1 + F.avg(x), 252) - 1).alias("cagr_proxy"), F.min("_d").alias("max_drawdown"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg(x).alias("mean"), F.count(x).alias("n"))


def walk_forward_strategy(bars: DataFrame, folds: DataFrame, strategy, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Runs ``strategy(bars, asset)`` on each fold's test bars, equity beginning at 1, and stitches the
    folds: of a time that several tests have, the earliest fold's row stays."""
    rows = by_fold(bars, folds, ts).where("part = 'test'").withColumn("fold_asset", F.concat_ws("|", F.col("fold_id").cast("string"), F.col(asset)))
    run = strategy(rows, "fold_asset")
    first = Window.partitionBy(asset, ts).orderBy("fold_id")
    return run.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "fold_asset")


def cost_sensitivity(series: DataFrame, gross: str = "pnl", net: str = "net") -> DataFrame:
    g, n = (F.exp(F.sum(F.log1p(c))) - 1 for c in (gross, net))
    return series.agg(g.alias("gross_return"), n.alias("net_return"), (g - n).alias("drag"), F.when(F.abs(g) > 1e-12, F.try_divide(g - n, F.abs(g)) * 100).alias("drag_pct"))
