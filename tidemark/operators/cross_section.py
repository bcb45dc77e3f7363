"""Cross-sectional transforms, information coefficients, ranks and factor combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import across, along, average_rank, clip, correlation, full, ln, percent_rank_average, trailing
from tidemark.operators.bars import dense


def zscore(x: Column, *partition: str, limit: float | None = 5.0, least: int = 2) -> Column:
    """(x - mean) / sample deviation within the partition, clipped; NULL without spread or with fewer
    than ``least`` values."""
    w = Window.partitionBy(*partition)
    sd = F.stddev_samp(x).over(w)
    z = F.when((F.count(x).over(w) >= least) & (sd > 0), F.try_divide(x - F.avg(x).over(w), sd))
    return clip(z, -limit, limit) if limit else z


def winsorized(x: Column, *partition: str, p: float = 0.01) -> Column:
    """Clipped to the p and 1 - p quantiles (linear) of the partition; as it is below two values."""
    w = Window.partitionBy(*partition)
    return F.when(F.count(x).over(w) < 2, x).otherwise(clip(x, F.percentile(x, F.lit(p)).over(w), F.percentile(x, F.lit(1 - p)).over(w)))


def ranked(panel: DataFrame, value: str = "value", ts: str = "ts") -> DataFrame:
    """Adds ``rank_pct``: the average rank over the number of values at that time."""
    return panel.withColumn("rank_pct", percent_rank_average(F.col(value), ts))


def information_coefficient(signal: DataFrame, forward: DataFrame, method: str = "spearman", value: str = "value", fwd: str = "fwd", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, ic, n: correlation across assets of the signal with the forward return at each time.

    Ranks are taken among the assets that have both. Fewer than two, or a constant side, give NULL.
    """
    both = signal.select(ts, asset, F.col(value).alias("s")).join(forward.select(ts, asset, F.col(fwd).alias("f")), [ts, asset]).where("s is not null and f is not null")
    if method == "spearman":
        both = both.withColumns({"s": average_rank(F.col("s"), ts), "f": average_rank(F.col("f"), ts)})
    return both.groupBy(ts).agg(correlation(F.col("s"), F.col("f")).alias("ic"), F.count(F.lit(1)).alias("n"))


def ic_summary(ic: DataFrame, *by: str, value: str = "ic") -> DataFrame:
    """mean, std, t, hit rate, a 95% interval and n of the non-null coefficients."""
    x = F.col(value)
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    se = F.try_divide(sd, F.sqrt(n))
    return ic.groupBy(*by).agg(
        mean.alias("mean_ic"),
        sd.alias("std_ic"),
        F.when(sd > 0, F.try_divide(mean, se)).alias("t_stat"),
        F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("hit_rate"),
        (mean - 1.96 * se).alias("ci_low"),
        (mean + 1.96 * se).alias("ci_high"),
        n.alias("n_obs"),
    )


def ic_decay(signal: DataFrame, returns: DataFrame, horizons: list[int], method: str = "spearman", value: str = "value", ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The summary for each horizon. All forward returns come from one pass over the returns, which meet
    the signal once; horizons are then rows, and ranks are taken within time and horizon."""
    return ic_summary(ic_by_horizon(signal, returns, horizons, method, value, ret, asset, ts), "horizon")


def ic_by_horizon(signal: DataFrame, returns: DataFrame, horizons: list[int], method: str = "spearman", value: str = "value", ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, horizon, ic, n."""
    r = F.col(ret)
    ahead = [F.exp(full(F.sum(r), r, h, along(asset, ts).rowsBetween(1, h))) - 1 for h in horizons]
    seen = returns.where(r.isNotNull()).select(ts, asset, F.array(*ahead).alias("_f"))
    both = signal.where(F.col(value).isNotNull()).select(ts, asset, F.col(value).alias("s")).join(seen, [ts, asset])
    both = both.select(ts, "s", F.explode(F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("h"), F.col("_f").alias("f"))).alias("_e"))
    both = both.select(ts, "s", F.col("_e.h").alias("horizon"), F.col("_e.f").alias("f")).where("f is not null")
    if method == "spearman":
        both = both.withColumns({"s": average_rank(F.col("s"), ts, "horizon"), "f": average_rank(F.col("f"), ts, "horizon")})
    return both.groupBy(ts, "horizon").agg(correlation(F.col("s"), F.col("f")).alias("ic"), F.count(F.lit(1)).alias("n"))


def members(panel: DataFrame, k_top: int, k_bottom: int, value: str = "rank_pct", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds in_top and in_bottom; ties go by asset name."""
    x = F.col(value)
    seen = panel.where(x.isNotNull())
    return seen.withColumns({"in_top": F.row_number().over(across(ts).orderBy(x.desc(), asset)) <= k_top, "in_bottom": F.row_number().over(across(ts).orderBy(x.asc(), asset)) <= k_bottom})


def turnover_of_ranks(panel: DataFrame, k_top: int, k_bottom: int, value: str = "rank_pct", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, turnover: size of the symmetric differences of both buckets with those of the time before,
    over k_top + k_bottom; NULL at the first time. Each member compares itself with the neighbouring
    time, so a single shuffle by asset does it."""
    both = members(panel, k_top, k_bottom, value, asset, ts)
    times = both.select(ts).distinct().withColumn("n", F.row_number().over(Window.orderBy(ts)))
    held = both.where("in_top or in_bottom").select(ts, asset, "in_top", "in_bottom").join(times, ts)
    w = along(asset, "n")
    gone = lambda c: (F.lag("n").over(w) == F.col("n") - 1) & F.lag(c).over(w)
    stays = lambda c: (F.lead("n").over(w) == F.col("n") + 1) & F.lead(c).over(w)
    marked = held.withColumns({f"{s}_{c}": F.col(c) & ~F.coalesce(f(c), F.lit(False)) for s, f in (("new", gone), ("left", stays)) for c in ("in_top", "in_bottom")})
    moves = marked.select(F.col("n"), (F.col("new_in_top").cast("int") + F.col("new_in_bottom").cast("int")).alias("d")).unionByName(marked.select((F.col("n") + 1).alias("n"), (F.col("left_in_top").cast("int") + F.col("left_in_bottom").cast("int")).alias("d")))
    total = moves.groupBy("n").agg(F.sum("d").alias("d"))
    return times.join(total, "n", "left").select(ts, F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / F.lit(float(k_top + k_bottom))).alias("turnover"))


def factor_frame(bars: DataFrame, lookback: int = 24, p: float = 0.01, standardize: bool = True, liquidity: str = "liquidity_usd", volume: str = "vol_h24", ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, factor, value for size (log liquidity), liquidity (log volume) and momentum (rolling
    sum of what there is); winsorized and standardized at each time; times with fewer than three
    assets go."""
    raw = bars.select(ts, asset, ln(F.col(liquidity)).alias("size"), ln(F.col(volume)).alias("liquidity"), F.sum(ret).over(trailing(lookback, asset, ts)).alias("momentum"))
    raw = raw.withColumn("_n", F.count(F.lit(1)).over(across(ts))).where("_n >= 3").drop("_n")
    long = raw.unpivot([ts, asset], ["size", "liquidity", "momentum"], "factor", "value")
    long = long.withColumn("value", winsorized(F.col("value"), ts, "factor", p=p))
    return long.withColumn("value", zscore(F.col("value"), ts, "factor", limit=None, least=3)) if standardize else long


def combine_linear(frame: DataFrame, weights: dict[str, float], asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, signal: the weighted sum of the named factors; NULL if any of them is missing."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    used = frame.where(F.col("factor").isin(*weights))
    v = F.col("value")
    return used.groupBy(ts, asset).agg(F.when(F.count(v) == len(weights), F.sum(v * w[F.col("factor")])).alias("signal"))


def combine_rank_sum(frame: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, signal: the sum of the average ranks over the factors."""
    return frame.withColumn("r", average_rank(F.col("value"), ts, "factor")).groupBy(ts, asset).agg(F.sum("r").alias("signal"))


def at_least_assets(panel: DataFrame, n: int = 3, asset: str = "asset", ts: str = "ts") -> DataFrame:
    enough = panel.groupBy(ts).agg(F.count_distinct(asset).alias("_n")).where(F.col("_n") >= n).select(ts)
    return panel.join(enough, ts, "left_semi")


def to_wide(panel: DataFrame, value: str = "signal", asset: str = "asset", ts: str = "ts", assets: list[str] | None = None) -> DataFrame:
    """One column per asset, for display. Without a list Spark finds the distinct assets first."""
    return panel.groupBy(ts).pivot(asset, assets).agg(F.first(value))


def neutralized(panel: DataFrame, exposures: list[str], value: str = "value", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds ``neutral``: the residual of a regression of the signal on a constant and up to two exposures
    at each time, over assets that have all of them; NULL for the others. With fewer than three such
    assets the signal stays as it is for all."""
    y, xs = F.col(value), [F.col(e) for e in exposures]
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    w = across(ts)
    n = F.count(F.when(ok, 1)).over(w)
    mean = lambda c: F.avg(F.when(ok, c)).over(w)
    centred = panel.withColumns({"_ok": ok, "_n": n, "_y": y - mean(y), **{f"_x{i}": x - mean(x) for i, x in enumerate(xs)}})
    s = lambda a, b: F.sum(F.when(F.col("_ok"), F.col(a) * F.col(b))).over(w)
    if len(xs) == 1:
        sxx = s("_x0", "_x0")
        fit = F.coalesce(F.when(sxx > 1e-18, F.try_divide(s("_x0", "_y"), sxx)), F.lit(0.0)) * F.col("_x0")
    elif len(xs) == 2:
        a, b, c, d, e = s("_x0", "_x0"), s("_x0", "_x1"), s("_x1", "_x1"), s("_x0", "_y"), s("_x1", "_y")
        sums = centred.withColumns({"_a": a, "_b": b, "_c": c, "_d": d, "_e": e})
        det = F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b")
        sound = det > 1e-12 * F.col("_a") * F.col("_c")
        b0 = F.when(sound, F.try_divide(F.col("_d") * F.col("_c") - F.col("_e") * F.col("_b"), det)).otherwise(F.coalesce(F.try_divide("_d", "_a"), F.lit(0.0)))
        b1 = F.when(sound, F.try_divide(F.col("_e") * F.col("_a") - F.col("_d") * F.col("_b"), det)).otherwise(F.lit(0.0))
        centred, fit = sums, b0 * F.col("_x0") + b1 * F.col("_x1")
    else:
        raise ValueError("one or two exposures; regress on more one after another")
    out = centred.withColumn("neutral", F.when(F.col("_n") < 3, y).when(F.col("_ok"), F.col("_y") - fit))
    return out.drop("_ok", "_n", "_y", "_x0", "_x1", "_a", "_b", "_c", "_d", "_e")


def orthogonalized(panel: DataFrame, order: list[str], asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Signals as columns, each less its regression at that time on those before it (``<name>_orth``).

    A signal is regressed on the already orthogonal ones, one after another, so each step is a
    one-exposure regression in window expressions over the same partitioning."""
    out = panel.withColumn(f"{order[0]}_orth", F.col(order[0]))
    for i, name in enumerate(order[1:], 1):
        out = out.withColumn("_left", F.col(name))
        for before in order[:i]:
            out = neutralized(out, [f"{before}_orth"], "_left", asset, ts).drop("_left").withColumnRenamed("neutral", "_left")
        out = out.withColumnRenamed("_left", f"{name}_orth")
    return out


def cross_correlations(panel: DataFrame, signals: list[str]) -> DataFrame:
    """a, b, corr: pooled correlation of each pair of signal columns."""
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    row = panel.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr").select(F.substring_index("pair", "|", 1).alias("a"), F.substring_index("pair", "|", -1).alias("b"), "corr")


def exposure_panel(panel: DataFrame, beta: Column | None = None, short: int = 24, ret: str = "log_return", liquidity: str | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Adds rolling_vol, turnover_proxy (mean absolute return), beta and log_liquidity."""
    r, w = F.col(ret), trailing(short, asset, ts)
    cols = {"rolling_vol": full(F.stddev_samp(r), r, short, w), "turnover_proxy": full(F.avg(F.abs(r)), r, short, w)}
    if beta is not None:
        cols["beta"] = beta
    if liquidity:
        cols["log_liquidity"] = ln(F.col(liquidity))
    return panel.withColumns(cols)


def grid(panel: DataFrame, value: str, asset: str = "asset", ts: str = "ts") -> DataFrame:
    return dense(panel, value, asset, ts)


def ic_stability(ic: DataFrame, n: int, value: str = "ic", ts: str = "ts") -> DataFrame:
    """One row: mean and deviation of the last n coefficients and their ratio within ten."""
    x, w = F.col(value), Window.orderBy(ts).rowsBetween(-(n - 1), 0)
    rolled = ic.where(x.isNotNull()).select(ts, full(F.avg(x), x, n, w).alias("m"), full(F.stddev_samp(x), x, n, w).alias("s"))
    last = rolled.agg(F.max_by("m", ts).alias("rolling_mean"), F.max_by("s", ts).alias("rolling_std"))
    return last.withColumn("ratio", clip(F.when(F.col("rolling_std") > 0, F.try_divide("rolling_mean", "rolling_std")), -10, 10))


def sweep_statistic(results: DataFrame, metric: str = "mean_ic", signal: str = "signal", horizon: str = "horizon") -> DataFrame:
    """hypothesis ("signal|horizon") and the mean of its metric, largest first."""
    key = F.concat_ws("|", F.col(signal), F.col(horizon).cast("string")).alias("hypothesis")
    return results.groupBy(key).agg(F.avg(metric).alias("stat")).orderBy(F.desc_nulls_last("stat"), "hypothesis")


def means_by(frame: DataFrame, by: str = "regime") -> DataFrame:
    """Rows and the mean of every numeric column of each group."""
    numeric = [c for c, t in frame.dtypes if c != by and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return frame.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in numeric])
