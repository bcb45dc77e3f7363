"""Statistical inference on series: HAC, breaks, multiple testing, bootstrap and null experiments.

A univariate series has one row per time and is ordered by one task; many series go by a key and are
ordered apart. Resampling draws index tables by hashes of seed and keys and joins them to
the series, so that simulations are a dimension of the data and not a loop of jobs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf, periods_per_year
from tidemark.functions.windows import average_rank, correlation, unbiased_excess_kurtosis, unbiased_skewness
from tidemark.operators import order
from tidemark.session import workspace


def _partition(by: tuple[str, ...]):
    return Window.partitionBy(*by)


def default_lags(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9)), at most n / 3."""
    return F.greatest(F.lit(0), F.least(F.floor(n / 3), F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))))).cast("int")


def long_run_variance(series: DataFrame, *by: str, value: str = "value", ts: str = "ts", lags: int | None = None) -> DataFrame:
    """by..., n, mean, n_lags, omega: Newey-West with Bartlett weights; autocovariances are means over
    the pairs there are; not below 0."""
    s = series.where(F.col(value).isNotNull())
    w = _partition(by)
    s = s.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy(ts)), "_z": F.col(value) - F.avg(value).over(w)})
    s = s.withColumn("_l", F.lit(lags) if lags is not None else default_lags(F.col("_n")))
    a = s.select(*by, "_n", "_l", F.col("_i"), "_z", F.explode(F.sequence(F.lit(0), F.least("_l", F.col("_n") - 1))).alias("_tau"))
    b = s.select(*by, F.col("_i").alias("_j"), F.col("_z").alias("_y"))
    on = [a["_i"] - a["_tau"] == b["_j"], *[a[c].eqNullSafe(b[c]) for c in by]]
    pairs = a.join(b, on).select(*[a[c] for c in by], "_n", "_l", "_tau", (F.col("_z") * F.col("_y")).alias("_p"))
    gamma = pairs.groupBy(*by, "_n", "_l", "_tau").agg(F.avg("_p").alias("_g"))
    weight = F.when(F.col("_tau") == 0, 1.0).otherwise(2 * (1 - F.col("_tau") / (F.col("_l") + 1.0)))
    omega = gamma.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(weight * F.col("_g"))).alias("omega"), F.max("_l").alias("n_lags"))
    stats = series.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return stats.join(omega, list(by)) if by else stats.crossJoin(omega)


def hac_mean(series: DataFrame, *by: str, value: str = "value", ts: str = "ts", lags: int | None = None, min_obs: int = 30, compat: bool = False) -> DataFrame:
    """Adds t_hac and p_hac for the mean: mean * sqrt(n / omega); NULL below ``min_obs``.

    ``compat`` leaves out the root of n, as a known implementation does."""
    v = long_run_variance(series, *by, value=value, ts=ts, lags=lags)
    t = F.try_divide(F.col("mean") * (F.lit(1.0) if compat else F.sqrt("n")), F.sqrt("omega"))
    v = v.withColumn("t_hac", F.when((F.col("n") >= min_obs) & (F.col("omega") > 0), t))
    return v.withColumn("p_hac", 2 * (1 - normal_cdf(F.abs("t_hac"))))


def cusum(series: DataFrame, *by: str, value: str = "value", ts: str = "ts", min_obs: int = 20, lags: int | None = None) -> DataFrame:
    """by..., stat, p_value, break_suspected, break_ts: the largest absolute running sum of deviations over
    sqrt(omega n), with p = 2 exp(-2 stat^2)."""
    omega = long_run_variance(series, *by, value=value, ts=ts, lags=lags).select(*by, "n", "omega")
    s = series.where(F.col(value).isNotNull())
    w = _partition(by)
    run = s.withColumn("_z", F.col(value) - F.avg(value).over(w)).withColumn("_c", F.abs(F.sum("_z").over(w.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))))
    best = run.groupBy(*by).agg(F.max("_c").alias("_m"), F.max_by(ts, F.struct(F.col("_c"), -F.unix_micros(F.col(ts).cast("timestamp")))).alias("_at"))
    j = best.join(omega, list(by)) if by else best.crossJoin(omega)
    stat = F.when((F.col("n") >= min_obs) & (F.col("omega") > 0), F.try_divide("_m", F.sqrt(F.col("omega") * F.col("n"))))
    j = j.withColumn("stat", stat).withColumn("p_value", F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("stat") * F.col("stat"))))
    hit = F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    return j.select(*by, "stat", "p_value", hit.alias("break_suspected"), F.when(hit, F.col("_at")).alias("break_ts"))


def sup_chow(series: DataFrame, *by: str, value: str = "value", ts: str = "ts", min_obs: int = 100, trim: int = 10) -> DataFrame:
    """by..., stat, p_value, break_suspected, break_index: the largest F over break points that leave ``trim``
    rows on either side. Prefix sums give each split's squared residuals, so one pass does."""
    s = series.where(F.col(value).isNotNull())
    w = _partition(by)
    s = s.withColumn("_z", F.col(value) - F.avg(value).over(w))
    back = w.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"_i": F.row_number().over(w.orderBy(ts)), "_n": F.count(F.lit(1)).over(w), "_s": F.sum("_z").over(back), "_all": F.sum(F.col("_z") * F.col("_z")).over(w)})
    # deviations from the mean sum to zero, so the second part's sum is minus the first's
    gain = F.col("_s") * F.col("_s") * (F.lit(1.0) / F.col("_i") + F.try_divide(F.lit(1.0), F.col("_n") - F.col("_i")))
    split = F.col("_all") - gain
    f = F.when(split >= 1e-12, F.try_divide(gain, split) * (F.col("_n") - 2))
    ok = (F.col("_i") >= trim) & (F.col("_i") <= F.col("_n") - trim) & (F.col("_all") >= 1e-12) & (F.col("_n") >= min_obs)
    best = s.withColumn("_f", F.when(ok, f)).groupBy(*by).agg(F.max("_f").alias("stat"), F.max_by("_i", F.when(F.col("_f").isNotNull(), F.struct(F.col("_f"), -F.col("_i")))).alias("break_index"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("stat") / 15.0))
    return best.select(*by, "stat", p.alias("p_value"), F.coalesce(p < 0.05, F.lit(False)).alias("break_suspected"), "break_index")


def break_diagnostics(series: DataFrame, by: str = "series", value: str = "value", ts: str = "ts", cusum_min: int = 20, scan_min: int = 100) -> DataFrame:
    """Both tests for each series."""
    a = cusum(series, by, value=value, ts=ts, min_obs=cusum_min).select(by, F.lit("cusum").alias("test"), "stat", "p_value", "break_suspected")
    b = sup_chow(series, by, value=value, ts=ts, min_obs=scan_min).select(by, F.lit("sup_chow").alias("test"), "stat", "p_value", "break_suspected")
    return a.unionByName(b)


def adjusted(p_values: DataFrame, method: str = "bh", q: float = 0.05, p: str = "p", key: str = "id", compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_adj and rejected by Benjamini-Hochberg or -Yekutieli, within ``by``.

    Standard: the running minimum from the largest p down. ``compat``: the running maximum from the
    smallest up. Without ``by`` the order runs over all hypotheses, however many (see ``order``, which acts at once);
    within ``by`` each group is ranked in one task.
    """
    ok = p_values.where(F.col(p).isNotNull())
    ranks, count = F.col("_r"), F.col("_n")
    # 1 + 1/2 + ... + 1/n, for large n by its expansion
    exact = F.aggregate(F.sequence(F.lit(1), F.least(count, F.lit(10_000)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    n = count.cast("double")
    harmonic = F.when(count <= 10_000, exact).otherwise(F.log(n) + F.lit(0.5772156649015329) + 1 / (2 * n) - 1 / (12 * n * n))
    raw = F.least(F.lit(1.0), F.col(p) * count * (harmonic if method == "by" else F.lit(1.0)) / ranks)
    if not by:
        out = order.running(ok, [F.asc(p), F.asc(key)], {"p_adj": (raw, "max" if compat else "min")})
        return out.withColumn("rejected", F.col("p_adj") <= q).drop("_r", "_n")
    whole = _partition(by)
    ranked = ok.withColumns({"_r": F.row_number().over(whole.orderBy(p, key)), "_n": F.count(F.lit(1)).over(whole)}).withColumn("_raw", raw)
    if compat:
        adj = F.max("_raw").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    else:
        adj = F.min("_raw").over(whole.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_adj", adj).withColumn("rejected", F.col("p_adj") <= q).drop("_r", "_n", "_raw")


def deflated_sharpe(pnl: DataFrame, n_trials: int, *by: str, value: str = "pnl") -> DataFrame:
    """by..., raw_sr, var_sr, e_max_sr, deflated_sr, skew, excess_kurtosis, n; NULL below ten rows."""
    x = F.col(value)
    base = pnl.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), unbiased_skewness(x).alias("skew"), unbiased_excess_kurtosis(x).alias("excess_kurtosis"))
    sr = F.when((F.col("n") >= 10) & (F.col("_s") >= 1e-12), F.try_divide("_m", "_s"))
    d = base.withColumn("raw_sr", sr)
    var = (1 + 0.5 * F.col("raw_sr") ** 2 - F.col("skew") * F.col("raw_sr") + F.col("excess_kurtosis") / 4 * F.col("raw_sr") ** 2) / F.col("n")
    d = d.withColumn("var_sr", F.when(F.col("raw_sr").isNotNull(), F.greatest(var, F.lit(1e-12))))
    d = d.withColumn("e_max_sr", F.sqrt("var_sr") * math.sqrt(2 * math.log(max(n_trials, 1))))
    return d.withColumn("deflated_sr", F.try_divide(F.col("raw_sr") - F.col("e_max_sr"), F.sqrt("var_sr"))).drop("_m", "_s")


def pbo(returns: DataFrame, blocks: int, value: str = "value", strategy: str = "strategy", ts: str = "ts", compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each ``by``): the probability of backtest overfitting over all symmetric splits of ``blocks`` (even, at
    most 16) blocks of time, and the number of splits.

    A strategy that wins in training and ranks low in test has a negative logit. ``compat`` counts ranks
    from the best, which turns the sign. Every split sums block sums, so returns are read once.
    """
    if blocks % 2 or blocks > 16:
        raise ValueError("an even number of blocks, 16 at most")
    spark = returns.sparkSession
    w = _partition(by)
    times = returns.select(*by, ts).distinct().withColumns({"_i": F.row_number().over(w.orderBy(ts)) - 1, "_size": F.floor(F.count(F.lit(1)).over(w) / blocks)})
    placed = times.withColumn("block", F.floor(F.try_divide("_i", "_size")).cast("int")).where(F.col("block") < blocks)
    sums = returns.join(placed.select(*by, ts, "block"), [*by, ts]).groupBy(*by, strategy, "block").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    splits = list(itertools.combinations(range(blocks), blocks // 2))
    rows = [(i, b, b in chosen) for i, chosen in enumerate(map(set, splits)) for b in range(blocks)]
    table = spark.createDataFrame(rows, "split int, block int, train boolean")
    per = sums.join(table, "block").groupBy(*by, "split", strategy).agg(
        F.try_divide(F.sum(F.when(F.col("train"), F.col("s"))), F.sum(F.when(F.col("train"), F.col("c")))).alias("train_mean"),
        F.try_divide(F.sum(F.when(~F.col("train"), F.col("s"))), F.sum(F.when(~F.col("train"), F.col("c")))).alias("test_mean"),
    )
    best = Window.partitionBy(*by, "split").orderBy(F.desc("train_mean"), strategy)
    order = F.col("test_mean").desc() if compat else F.col("test_mean").asc()
    ranked = per.withColumns({"_w": F.row_number().over(best), "_r": F.row_number().over(Window.partitionBy(*by, "split").orderBy(order, strategy)) - 1, "_j": F.count(F.lit(1)).over(Window.partitionBy(*by, "split"))})
    share = (F.col("_r") + 0.5) / F.col("_j")
    logit = F.log(share / (1 - share))
    return ranked.where("_w = 1").groupBy(*by).agg(F.avg((logit < 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"))


def pbo_proxy(results: DataFrame, train: str = "train_sharpe", test: str = "test_sharpe") -> DataFrame:
    """Share of folds whose test result is below the median of all."""
    w = Window.partitionBy()
    marked = results.where(F.col(test).isNotNull()).withColumn("_m", F.median(test).over(w))
    return marked.agg(F.avg((F.col(test) < F.col("_m")).cast("double")).alias("pbo_proxy"), F.count(F.lit(1)).alias("n_folds"))


# --- resampling ---------------------------------------------------------------------------------


def hashed_uniform(*keys: Column | str | int) -> Column:
    """A number between 0 and 1 that depends on the keys alone, so that any task, any engine and any rerun
    draws it again: the first 52 bits of a hash of the keys joined by bars."""
    text = F.concat_ws("|", *[(F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def hashed_normal(*keys: Column | str | int) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(hashed_uniform(*keys, 1))) * F.cos(2 * math.pi * hashed_uniform(*keys, 2))


def resample_table(spark: SparkSession, n: int, n_sim: int, seed: int, method: str = "stationary", block: float = 10.0) -> DataFrame:
    """sim, at, pos: for each simulation the position that stands at each place.

    Stationary: a block begins at the first place and elsewhere with probability 1 / ``block``, at a drawn
    position, and wraps around. Fixed: blocks of ``block`` rows that do not wrap. A simulation is a row until
    its blocks are spread, so no row moves between tasks."""
    sims = spark.range(n_sim).select(F.col("id").alias("sim"))
    if method == "stationary":
        places = F.sequence(F.lit(0), F.lit(n - 1))
        begins = F.filter(places, lambda at: (at == 0) | (hashed_uniform(seed, "sim", at, 3) < 1.0 / max(block, 1.0)))
        spread = sims.select("sim", begins.alias("_b")).select("sim", "_b", F.posexplode("_b").alias("_i", "_at"))
        ends = F.coalesce(F.get("_b", F.col("_i") + 1), F.lit(n))
        start = F.floor(hashed_uniform(seed, "sim", "_at", 4) * n)
        rows = spread.select("sim", "_at", start.alias("_s"), F.explode(F.sequence(F.lit(0), ends - F.col("_at") - 1)).alias("_k"))
        return rows.select("sim", (F.col("_at") + F.col("_k")).cast("long").alias("at"), F.pmod(F.col("_s") + F.col("_k"), F.lit(n)).cast("long").alias("pos"))
    size = max(1, min(int(block), n))
    rows = sims.select("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"))
    start = F.floor(hashed_uniform(seed, "sim", F.floor(F.col("at") / size), 4) * (n - size + 1))
    return rows.select("sim", F.col("at").cast("long").alias("at"), (start + F.col("at") % size).cast("long").alias("pos"))


def _numbered(series: DataFrame, value: str, ts: str) -> DataFrame:
    return series.where(F.col(value).isNotNull()).select(ts, F.col(value).alias("x"), (F.row_number().over(Window.orderBy(ts)) - 1).alias("pos"))


def bootstrap_pnl(series: DataFrame, n_sim: int = 1000, seed: int = 42, method: str = "block_fixed", block: float = 10.0, value: str = "pnl", ts: str = "ts") -> DataFrame:
    """sim, total_return, sharpe of each resampled series; the first row of a sample is its base,
    and a loss of everything is -1."""
    rows = _numbered(series, value, ts)
    n = rows.count()
    table = resample_table(series.sparkSession, max(n, 1), n_sim if n else 0, seed, "stationary" if method == "stationary" else "fixed", block)
    joined = table.join(rows, "pos")
    sd = F.stddev_samp("x")
    return joined.groupBy("sim").agg(F.when(F.min(F.when(F.col("at") > 0, F.col("x"))) <= -1, -1.0).otherwise(F.exp(F.sum(F.when(F.col("at") > 0, F.log1p("x")))) - 1).alias("total_return"), F.when(sd > 0, F.try_divide(F.avg("x"), sd)).alias("sharpe"))


def sharpe_interval(series: DataFrame, freq: str, n_sim: int = 1000, seed: int = 42, method: str = "block_fixed", block: float | None = None, pct: float = 95.0, value: str = "pnl", ts: str = "ts") -> DataFrame:
    """low, high, sharpe (annual), t: percentiles of the bootstrap; blocks of max(20, sqrt n) by default."""
    stats = series.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    n = stats.first()["n"]
    sims = bootstrap_pnl(series, n_sim, seed, method, block or max(20.0, n**0.5), value, ts)
    k = periods_per_year(freq) ** 0.5
    lo = (100 - pct) / 200
    ci = sims.agg((F.percentile("sharpe", F.lit(lo)) * k).alias("low"), (F.percentile("sharpe", F.lit(1 - lo)) * k).alias("high"))
    own = stats.select((F.when(F.col("s") > 0, F.try_divide("m", "s")) * k).alias("sharpe"), "n")
    return own.crossJoin(ci).withColumn("t", F.col("sharpe") * F.sqrt("n"))


def null_statistics(series: DataFrame, n_sim: int, seed: int, mean_block: float = 10.0, recenter: bool = False, by: str = "hypothesis", value: str = "value", ts: str = "ts") -> DataFrame:
    """sim, hypothesis, null_stat: means of series resampled by the same positions for all hypotheses."""
    times = series.select(ts).distinct().withColumn("pos", F.row_number().over(Window.orderBy(ts)) - 1)
    n = times.count()
    table = resample_table(series.sparkSession, max(n, 1), n_sim if n else 0, seed, "stationary", mean_block)
    s = series.where(F.col(value).isNotNull())
    x = F.col(value) - F.avg(value).over(Window.partitionBy(by)) if recenter else F.col(value)
    # how often each time is drawn says all that a mean needs
    drawn = table.groupBy("sim", "pos").count().join(times, "pos")
    rows = s.select(ts, by, x.alias("_x"))
    return rows.join(drawn, ts).groupBy("sim", by).agg(F.try_divide(F.sum(F.col("_x") * F.col("count")), F.sum("count")).alias("null_stat"))


def search_warning(signals: Column, portfolios: Column) -> Column:
    """What a report should say of the size of a search."""
    most = F.greatest(signals, portfolios)
    said = F.concat(F.lit("Tested: "), signals.cast("string"), F.lit(" signals, "), portfolios.cast("string"), F.lit(" portfolios."))
    some = F.when(most > 5, F.lit("Deflate the Sharpe ratio, test out of sample, trust no single best result."))
    many = F.when(most > 20, F.lit("Adjust p-values for the number of tests, or report medians over variants."))
    return F.concat_ws(" ", said, some, many)


def reality_check(observed: DataFrame, nulls: DataFrame, by: str = "hypothesis", stat: str = "stat") -> DataFrame:
    """p_value = (1 + number of simulations whose largest statistic reaches the observed largest) / (B + 1)."""
    top = observed.agg(F.max(stat).alias("_top"))
    per = nulls.groupBy("sim").agg(F.max("null_stat").alias("_null"))
    return per.crossJoin(F.broadcast(top)).agg(((1 + F.sum((F.col("_null") >= F.col("_top")).cast("int"))) / (F.count(F.lit(1)) + 1.0)).alias("p_value"), F.count(F.lit(1)).alias("n_sim"))


def romano_wolf(observed: DataFrame, nulls: DataFrame, by: str = "hypothesis", stat: str = "stat") -> DataFrame:
    """hypothesis, stat, p_adj by stepping down: each is held against the largest null of those not above it."""
    ranked = order.numbered(observed, F.desc(stat), F.asc(by), name="_k")
    rest = Window.partitionBy("sim").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    held = nulls.join(ranked, by).withColumn("_max", F.max("null_stat").over(rest))
    p = held.groupBy(by, stat, "_k").agg(((1 + F.sum((F.col("_max") >= F.col(stat)).cast("int"))) / (F.count(F.lit(1)) + 1.0)).alias("_p"))
    return order.running(p, [F.asc("_k")], {"p_adj": (F.col("_p"), "max")}).select(by, stat, "p_adj")


def _moves(times: DataFrame, n_sim: int, seed: int, block: int) -> DataFrame:
    """sim, _from, _to: the times (ts), with blocks of them in an order of each simulation's own."""
    times = times.distinct().withColumn("_i", F.row_number().over(Window.orderBy("ts")) - 1)
    each = times.withColumns({"sim": F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1))), "_b": F.floor(F.col("_i") / block)})
    key = F.md5(F.concat_ws("|", (F.lit(seed) + F.col("sim")).cast("string"), F.col("_b").cast("string")))
    new = each.withColumn("_new", F.row_number().over(Window.partitionBy("sim").orderBy(key, "_b", "_i")) - 1)
    return new.select(F.col("ts").alias("_from"), "sim", "_new").join(times.select(F.col("_i").alias("_new"), F.col("ts").alias("_to")), "_new").drop("_new")


def null_signals(signal: DataFrame, kind: str, seed: int, block: int = 10, value: str = "value", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The signal under a null: "ranks" (random ranks at each time), "permute" (values permuted across
    assets at each time) or "blocks" (blocks of time permuted)."""
    rnd = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ts).cast("string"), F.col(asset).cast("string")))
    at = Window.partitionBy(ts)
    if kind == "ranks":
        return signal.where(F.col(value).isNotNull()).select(ts, asset, (F.row_number().over(at.orderBy(rnd, asset)) / F.count(F.lit(1)).over(at)).alias(value))
    if kind == "permute":
        s = signal.where(F.col(value).isNotNull()).withColumns({"_a": F.row_number().over(at.orderBy(asset)), "_b": F.row_number().over(at.orderBy(rnd, asset))})
        left, right = s.select(ts, asset, "_a"), s.select(F.col(ts).alias("_ts"), F.col("_b"), F.col(value))
        return left.join(right, (left[ts] == right["_ts"]) & (left["_a"] == right["_b"])).select(ts, asset, value)
    if kind == "blocks":
        moves = _moves(signal.select(F.col(ts).alias("ts")), 1, seed, block)
        return signal.join(moves, F.col(ts) == F.col("_from")).select(F.col("_to").alias(ts), asset, value)
    raise ValueError(f"unknown null: {kind}")


def null_suite(signal: DataFrame, forward: DataFrame, n_sim: int = 20, seed: int = 42, block: int = 10, value: str = "value", fwd: str = "fwd", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """kind, observed_ic, p_value: share of simulations whose mean coefficient reaches the observed one (up to
    rounding, since blocks can be drawn in their old order).

    Signal and returns meet once, in a table in the shared folder. Random ranks and permuted values come from one order
    of the assets at each time and simulation: among the assets with a return the places in it are the ranks, and an
    asset gets the value whose place is its own number. So ranks of returns are taken once for all simulations, and what
    follows the order stays in its partition. The coefficient of blocks depends on the two times alone, so each pair of
    times is computed once, however many simulations draw it."""
    from tidemark.operators.cross_section import ic_summary

    spark, path = signal.sparkSession, workspace(signal.sparkSession, "nulls")
    own = signal.select(F.col(ts).alias("ts"), F.col(asset).alias("asset"), F.col(value).cast("double").alias("v"), F.lit(True).alias("own"))
    both = own.join(forward.select(F.col(ts).alias("ts"), F.col(asset).alias("asset"), F.col(fwd).alias("f")).where("f is not null"), ["ts", "asset"], "full")
    both.write.parquet(path)
    both = spark.read.schema(both.schema).parquet(path)

    met = F.when(F.col("f").isNotNull(), F.col("v"))
    number = F.row_number().over(Window.partitionBy("ts").orderBy("asset"))
    ranked = both.where("v is not null").select("ts", "asset", "v", number.alias("a"), average_rank(F.col("f"), "ts").alias("f"), average_rank(met, "ts").alias("s"))
    observed = ic_summary(ranked.where("f is not null").groupBy("ts").agg(correlation(F.col("s"), F.col("f")).alias("ic"))).select(F.col("mean_ic").alias("observed_ic"))

    key = F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.struct("ts", "sim").cast("string"), F.col("asset").cast("string"))))
    tagged = ranked.crossJoin(F.broadcast(spark.range(n_sim).withColumnRenamed("id", "sim"))).select("ts", "sim", "a", "v", "f", key.alias("key")).repartition("ts", "sim")
    drawn = Window.partitionBy("ts", "sim").orderBy("key", "a")
    has = F.col("f").isNotNull()
    placed = tagged.withColumns({"b": F.row_number().over(drawn), "r": F.when(has, F.sum(has.cast("int")).over(drawn.rowsBetween(Window.unboundedPreceding, 0)))})
    none = F.lit(None)
    sides = F.array(
        F.struct(F.col("b").alias("at"), "v", none.cast("double").alias("f"), none.cast("long").alias("r")),
        F.struct(F.col("a").alias("at"), none.cast("double").alias("v"), "f", F.col("r").cast("long").alias("r")),
    )
    dealt = placed.select("ts", "sim", F.inline(sides)).groupBy("ts", "sim", "at").agg(*[F.max(c).alias(c) for c in ("v", "f", "r")]).where("f is not null")
    dealt = dealt.withColumn("s", average_rank(F.col("v"), "ts", "sim"))
    ic = dealt.groupBy("ts", "sim").agg(correlation(F.col("r"), F.col("f")).alias("ranks"), correlation(F.col("s"), F.col("f")).alias("permute"))
    means = ic.groupBy("sim").agg(F.avg("ranks").alias("ranks"), F.avg("permute").alias("permute"))
    means = means.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in ("ranks", "permute")])))

    moves = _moves(both.where("own").select("ts"), n_sim, seed, block)
    moved = both.where("v is not null").select(F.col("ts").alias("_from"), "asset", "v").join(moves.select("_from", "_to").distinct(), "_from")
    pairs = moved.join(both.where("f is not null").select(F.col("ts").alias("_to"), "asset", "f"), ["_to", "asset"])
    pairs = pairs.select("_from", "_to", average_rank(F.col("v"), "_from", "_to").alias("s"), average_rank(F.col("f"), "_from", "_to").alias("f"))
    ic = pairs.groupBy("_from", "_to").agg(correlation(F.col("s"), F.col("f")).alias("ic"))
    means = means.unionByName(moves.join(ic, ["_from", "_to"]).groupBy("sim").agg(F.avg("ic").alias("m")).select(F.lit("blocks").alias("kind"), "m"))
    reached = F.avg((F.col("m") >= F.col("observed_ic") - 1e-12).cast("double")).alias("p_value")
    return means.crossJoin(F.broadcast(observed)).groupBy("kind", "observed_ic").agg(reached, F.count(F.lit(1)).alias("n_sim"))


# --- generators and calibration -----------------------------------------------------------------


def generate(spark: SparkSession, kind: str, n: int, k: int, seed: int, phi: float = 0.5, rho: float = 0.3, shift_at: int | None = None, delta: float = 0.0) -> DataFrame:
    """series, t, value for k series of n rows: iid, ar1, correlated, mean_shift or walk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j in b["id"]:
                e = np.random.default_rng([seed, int(j)]).standard_normal(n)
                if kind == "ar1":
                    for i in range(1, n):
                        e[i] += phi * e[i - 1]
                elif kind == "correlated":
                    e = math.sqrt(rho) * np.random.default_rng([seed, 2**31]).standard_normal(n) + math.sqrt(1 - rho) * e
                elif kind == "mean_shift":
                    e[(n // 2 if shift_at is None else shift_at) :] += delta
                elif kind == "walk":
                    e = np.cumsum(e)
                yield pd.DataFrame({"series": j, "t": np.arange(n), "value": e})

    return spark.range(k).mapInPandas(run, "series long, t long, value double")


def type_one_error(tests: DataFrame, alpha: float = 0.05, p: str = "p_value") -> DataFrame:
    return tests.where(F.col(p).isNotNull()).agg(F.avg((F.col(p) < alpha).cast("double")).alias("rejection_rate"), F.count(F.lit(1)).alias("n_trials"), F.lit(alpha).alias("nominal"))


def false_discovery(trials: DataFrame, discoveries: str = "n_discoveries", true: str = "n_true") -> DataFrame:
    fp = F.col(discoveries) - F.col(true)
    return trials.agg(F.avg(F.coalesce(F.try_divide(fp, F.col(discoveries)), F.lit(0.0))).alias("fdr"))
