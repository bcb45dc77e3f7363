"""Weights, constraints, costs and portfolio returns on long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import across, along, average_rank, clip
from tidemark.operators.bars import dense
from tidemark.operators.returns import exponential

FEE_BPS, SLIPPAGE_BPS = 30.0, 10.0


def adaptive_k(n: Column, k_top: int, k_bottom: int) -> tuple[Column, Column]:
    """Each leg at most a quarter of the assets, one at least."""
    most = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
    return F.least(F.lit(k_top), most), F.least(F.lit(k_bottom), most)


def long_short(panel: DataFrame, k_top: int, k_bottom: int, gross: float = 1.0, rank: str = "rank_pct", by: str | None = None, adaptive: bool = False, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, weight: the top k long and the bottom k short, each leg half of ``gross``.

    Equal weights, or by the absolute value of ``by`` (equal where all of a leg's are zero). Times with
    fewer than k_top + k_bottom ranked assets have no weights; ties go by asset name. The other assets
    of a time have weight 0.
    """
    x = F.col(rank)
    seen = panel.where(x.isNotNull()).withColumn("_n", F.count(F.lit(1)).over(across(ts)))
    kt, kb = adaptive_k(F.col("_n"), k_top, k_bottom) if adaptive else (F.lit(k_top), F.lit(k_bottom))
    seen = seen.withColumns({"_kt": kt, "_kb": kb}).where(F.col("_n") >= F.col("_kt") + F.col("_kb"))
    seen = seen.withColumns({"_up": F.row_number().over(across(ts).orderBy(x.desc(), asset)), "_down": F.row_number().over(across(ts).orderBy(x.asc(), asset))})
    leg = F.when(F.col("_up") <= F.col("_kt"), 1).when(F.col("_down") <= F.col("_kb"), -1).otherwise(0)
    seen = seen.withColumn("_leg", leg).withColumn("_size", F.abs(F.col(by)) if by else F.lit(1.0))
    w = Window.partitionBy(ts, "_leg")
    share = F.coalesce(F.when(F.sum("_size").over(w) > 0, F.try_divide(F.coalesce("_size", F.lit(0.0)), F.sum("_size").over(w))), F.try_divide(F.lit(1.0), F.count(F.lit(1)).over(w)))
    return seen.select(ts, asset, (F.col("_leg") * share * (gross / 2)).alias("weight"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, pnl: sum of weight times return over assets and times that both have; missing counts as 0."""
    both = weights.select(ts, asset, "weight").join(returns.select(ts, asset, F.col(ret).alias("r")), [ts, asset])
    return both.groupBy(ts).agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("r", F.lit(0.0))).alias("pnl"))


def _numbered(weights: DataFrame, asset: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Weights with the position of their time, and the times with theirs; times are few beside rows."""
    times = weights.select(ts).distinct().withColumn("_n", F.row_number().over(Window.orderBy(ts)))
    return weights.select(ts, asset, F.coalesce("weight", F.lit(0.0)).alias("weight")).join(times, ts), times


def lagged(weights: DataFrame, bars: int = 1, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Weights as executed: those of ``bars`` times before. An asset without a row has no weight; the
    assets of the first times have weight 0 then. Each row moves to a later time; no grid is made."""
    rows, times = _numbered(weights, asset, ts)
    at = lambda n, w: F.struct(n.alias("_n"), w.alias("weight"))
    both = F.array_compact(F.array(at(F.col("_n") + bars, F.col("weight")), F.when(F.col("_n") <= bars, at(F.col("_n"), F.lit(0.0)))))
    return rows.select(asset, F.inline(both)).join(times, "_n").select(ts, asset, "weight")


def held(weights: DataFrame, every: int, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The weights of the last rebalancing time, of which there is one in ``every`` times; no grid is made."""
    rows, times = _numbered(weights, asset, ts)
    kept = rows.where((F.col("_n") - 1) % every == 0)
    spread = kept.select(asset, "weight", F.explode(F.sequence(F.col("_n"), F.col("_n") + every - 1)).alias("_n"))
    return spread.join(times, "_n").select(ts, asset, "weight")


def _moves(rows: DataFrame, asset: str) -> DataFrame:
    """_n, _d: what changes at each numbered time; a row compares itself with the asset's row of the time before and,
    where the time after has none, closes there."""
    w = along(asset, "_n")
    before = F.when(F.lag("_n").over(w) == F.col("_n") - 1, F.lag("weight").over(w))
    goes_on = F.coalesce(F.lead("_n").over(w) == F.col("_n") + 1, F.lit(False))
    marked = rows.withColumns({"_d": F.abs(F.col("weight") - F.coalesce(before, F.lit(0.0))), "_goes_on": goes_on})
    at = lambda n, d: F.struct(n.alias("_n"), d.alias("_d"))
    both = F.array_compact(F.array(at(F.col("_n"), F.col("_d")), F.when(~F.col("_goes_on"), at(F.col("_n") + 1, F.abs("weight")))))
    return marked.select(F.inline(both)).groupBy("_n").agg(F.sum("_d").alias("_d"))


def turnover(weights: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, turnover: the sum of absolute changes of weight, an asset without a row having none; 0 at the
    first time. One exchange by asset and one by time."""
    rows, times = _numbered(weights, asset, ts)
    return times.join(_moves(rows, asset), "_n", "left").select(ts, F.when(F.col("_n") == 1, 0.0).otherwise(F.coalesce("_d", F.lit(0.0))).alias("turnover"))


def traded(weights: DataFrame, returns: DataFrame, bars: int = 1, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, pnl, turnover of weights that are executed ``bars`` times later: ``portfolio_returns`` and ``turnover`` of
    ``lagged`` weights, with the times numbered once for all of them."""
    rows, times = _numbered(weights, asset, ts)
    at = lambda n, w: F.struct(n.alias("_n"), w.alias("weight"))
    both = F.array_compact(F.array(at(F.col("_n") + bars, F.col("weight")), F.when(F.col("_n") <= bars, at(F.col("_n"), F.lit(0.0)))))
    late = rows.select(asset, F.inline(both))  # what would be executed after the last time falls out with the times
    earned = late.join(times, "_n").join(returns.select(ts, asset, F.col(ret).alias("r")), [ts, asset]).groupBy("_n", ts).agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("pnl"))
    change = F.when(F.col("_n") == 1, 0.0).otherwise(F.coalesce("_d", F.lit(0.0)))
    return earned.join(_moves(late, asset), "_n", "left").select(ts, "pnl", change.alias("turnover"))


def smoothed(weights: DataFrame, alpha: float, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Exponentially smoothed weights at every time from the first, an asset without a row having none."""
    full = dense(weights, "weight", asset, ts).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return exponential(full, {"smooth": ("weight", alpha)}, asset, ts).select(ts, asset, F.col("smooth").alias("weight"))


def constrained(weight: Column, most: float) -> Column:
    return clip(weight, -most, most)


def beta_neutral(panel: DataFrame, weight: str = "weight", beta: str = "beta", target: float = 0.0, ts: str = "ts") -> DataFrame:
    """Weights less their share of the portfolio beta: w - (sum(w b) - target) / sum(b^2) * b, at each time."""
    w, b = F.col(weight), F.coalesce(F.col(beta), F.lit(0.0))
    over = across(ts)
    gap = F.sum(w * b).over(over) - F.lit(target)
    size = F.sum(b * b).over(over)
    return panel.withColumn(weight, F.when(size > 1e-18, w - F.try_divide(gap, size) * b).otherwise(w))


def vol_target(panel: DataFrame, target: float = 0.15, freq: str = "1h", ret: str = "log_return", asset: str = "asset") -> DataFrame:
    """asset, weight: inverse volatility, scaled to the target as if assets were uncorrelated in sum,
    each at most 1, together at most 1."""
    per = panel.groupBy(asset).agg((F.stddev_samp(ret) * scalars.periods_per_year(freq) ** 0.5).alias("vol")).where("vol > 1e-12")
    whole = Window.partitionBy()
    inv = per.withColumn("_w", F.lit(1.0) / F.col("vol"))
    share = inv.withColumn("_w", F.col("_w") / F.sum("_w").over(whole))
    scaled = share.withColumn("_w", F.least(F.lit(1.0), F.col("_w") * target / F.sum(F.col("_w") * F.col("vol")).over(whole)))
    total = F.sum("_w").over(whole)
    return scaled.select(asset, F.when(total > 1, F.col("_w") / total).otherwise(F.col("_w")).alias("weight"))


def risk_parity(cov: DataFrame) -> DataFrame:
    """asset, weight: inverse deviations of the diagonal, normalised; equal where none is positive."""
    diag = cov.where("a = b").select(F.col("a").alias("asset"), F.when(F.col("cov") > 0, F.lit(1.0) / F.sqrt("cov")).otherwise(F.lit(0.0)).alias("_i"))
    total, n = F.sum("_i").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    return diag.select("asset", F.when(total > 0, F.try_divide(F.col("_i"), total)).otherwise(F.lit(1.0) / n).alias("weight"))


def optimize_long_short(panel: DataFrame, expected: str = "expected", variance: str = "variance", beta: str | None = None, slippage: tuple[str, float] | None = None, liquidity: tuple[str, float] | None = None, max_weight: float | None = None, capacity: str | None = None, dollar_neutral: bool = True, gross: float | None = None, ts: str = "ts") -> DataFrame:
    """Adds ``weight`` by rank, exclusions, beta neutrality, inverse volatility, caps, dollar neutrality
    and gross leverage, in that order, at each time.

    The dollar-neutral step shares the sum among the assets that have a weight but takes it from all.
    """
    over = across(ts)
    out = panel.withColumn("_er", F.coalesce(F.col(expected), F.lit(0.0)))
    out = out.withColumn("weight", (average_rank(F.col("_er"), ts) / F.count(F.lit(1)).over(over) - 0.5) * 2)
    if slippage:
        out = out.withColumn("weight", F.when(F.coalesce(F.col(slippage[0]), F.lit(float("inf"))) > slippage[1], 0.0).otherwise(F.col("weight")))
    if liquidity:
        out = out.withColumn("weight", F.when(F.coalesce(F.col(liquidity[0]), F.lit(0.0)) < liquidity[1], 0.0).otherwise(F.col("weight")))
    if beta:
        out = beta_neutral(out, "weight", beta, 0.0, ts)
    vol = F.sqrt(F.greatest(F.coalesce(F.col(variance), F.lit(0.0)), F.lit(1e-10)))
    out = out.withColumn("weight", F.when(vol > 1e-12, F.col("weight") / vol).otherwise(F.lit(0.0)))
    if max_weight:
        out = out.withColumn("weight", constrained(F.col("weight"), max_weight))
    if capacity:
        cap = F.coalesce(F.col(capacity), F.lit(0.0))
        limit = F.try_divide(cap, F.sum(F.abs(cap)).over(over)) * 2
        out = out.withColumn("weight", F.when(F.sum(F.abs(cap)).over(over) > 0, clip(F.col("weight"), -limit, limit)).otherwise(F.col("weight")))
    if dollar_neutral:
        total = F.sum("weight").over(over)
        count = F.greatest(F.sum((F.col("weight") != 0).cast("int")).over(over), F.lit(1))
        out = out.withColumn("weight", F.when(F.abs(total) > 1e-12, F.col("weight") - total / count).otherwise(F.col("weight")))
    if gross:
        size = F.sum(F.abs(F.col("weight"))).over(over)
        out = out.withColumn("weight", F.when(size > 1e-12, F.col("weight") * F.try_divide(F.lit(gross), size)).otherwise(F.col("weight")))
    if max_weight:
        out = out.withColumn("weight", constrained(F.col("weight"), max_weight))
    return out.drop("_er")


def diagnostics(weights: DataFrame, beta: str | None = None, ts: str = "ts") -> DataFrame:
    """Per time: gross, net, number of positions, largest weight, Herfindahl index, beta."""
    w = F.col("weight")
    gross = F.sum(F.abs(w))
    cols = [gross.alias("gross"), F.sum(w).alias("net"), F.sum((w != 0).cast("int")).alias("n_assets"), F.max(F.abs(w)).alias("max_weight"), F.try_divide(F.sum(w * w), gross * gross).alias("herfindahl")]
    if beta:
        cols.append(F.sum(w * F.coalesce(F.col(beta), F.lit(0.0))).alias("achieved_beta"))
    return weights.groupBy(ts).agg(*cols)


def rank_weights(panel: DataFrame, gross: float = 1.0, net: float = 0.0, signal: str = "value", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Long from the median rank up, short below, equal within a leg, scaled to gross, shifted to net."""
    seen = panel.where(F.col(signal).isNotNull()).withColumn("_r", average_rank(F.col(signal), ts))
    side = seen.withColumn("_s", F.when(F.col("_r") >= F.median("_r").over(across(ts)), 1.0).otherwise(-1.0))
    leg = side.withColumn("_w", F.col("_s") / F.count(F.lit(1)).over(Window.partitionBy(ts, "_s")))
    over = across(ts)
    scaled = leg.withColumn("_w", F.col("_w") * F.try_divide(F.lit(gross), F.sum(F.abs("_w")).over(over)))
    return scaled.select(ts, asset, (F.col("_w") + (F.lit(net) - F.sum("_w").over(over)) / F.count(F.lit(1)).over(over)).alias("weight"))


def net_of_costs(series: DataFrame, fee_bps: float = FEE_BPS, slippage_bps: float | str = SLIPPAGE_BPS, gross: str = "pnl", turn: str = "turnover") -> DataFrame:
    """Adds cost and net; slippage is a number or a column of basis points."""
    slip = F.col(slippage_bps) if isinstance(slippage_bps, str) else F.lit(float(slippage_bps))
    cost = F.coalesce(F.col(turn), F.lit(0.0)) * (F.lit(float(fee_bps)) + slip) / 10_000
    return series.withColumn("cost", cost).withColumn("net", F.col(gross) - F.col("cost"))


def capacity_curve(series: DataFrame, multipliers: tuple[float, ...] = (1.0, 2.0, 5.0), freq: str = "1h", fee_bps: float = FEE_BPS, slippage_bps: float = SLIPPAGE_BPS, participation: bool = True, per_pct: float = 5.0, most_pct: float = 10.0, k: float = 5.0, alpha: float = 0.5, spread_bps: float = 0.0, gross: str = "pnl", turn: str = "turnover") -> DataFrame:
    """One row per multiplier of size: Sharpe, mean, volatility, turnover and costs as they grow with it."""
    year = scalars.periods_per_year(freq)
    mean = series.agg(F.avg(turn).alias("_avg"))
    sized = series.crossJoin(F.broadcast(mean)).withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    m = F.col("multiplier")
    impact = scalars.impact_bps(F.least(F.lit(most_pct), m * F.col("_avg") * 100), per_pct, most_pct) if participation else F.lit(k) * F.pow(m, F.lit(alpha))
    cost = F.lit(fee_bps + slippage_bps + spread_bps) + impact
    net = sized.withColumns({"_net": F.col(gross) - F.col(turn) * m * cost / 10_000, "_impact": impact})
    sd = F.stddev_samp("_net")
    return net.groupBy("multiplier").agg(
        F.when(sd > 0, F.try_divide(F.avg("_net"), sd) * year**0.5).alias("sharpe_annual"),
        (F.avg("_net") * year).alias("mean_ret_annual"),
        (sd * year**0.5).alias("vol_annual"),
        (F.avg(turn) * F.col("multiplier")).alias("avg_turnover"),
        (F.max("_impact") + fee_bps + slippage_bps + spread_bps).alias("est_cost_bps"),
        F.max("_impact").alias("impact_bps"),
    )


def rises_with_size(curve: DataFrame) -> DataFrame:
    """One row: whether Sharpe rises anywhere as size grows."""
    d = curve.withColumn("_up", F.col("sharpe_annual") > F.lag("sharpe_annual").over(Window.orderBy("multiplier")))
    return d.agg(F.coalesce(F.max("_up"), F.lit(False)).alias("non_monotone"))


def capacity_and_slippage(rows: DataFrame, liquidity: str = "liquidity_usd", max_pct: float = 0.01, position: float = 10_000.0, at_full: float = 10.0, tradable_bps: float = 50.0) -> DataFrame:
    """Adds capacity (a share of liquidity), slippage for a reference position (500 at most) and tradable."""
    cap = F.coalesce(F.col(liquidity), F.lit(0.0)) * max_pct
    slip = F.when(cap > 0, F.least(F.lit(500.0), F.try_divide(F.lit(at_full * position), cap))).otherwise(F.lit(500.0))
    return rows.withColumns({"capacity_usd": cap, "est_slippage_bps": slip, "tradable": slip <= tradable_bps})


def order_intent(weights: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, targets: a map of asset to weight for each time; its size is the number of assets held."""
    held_ = weights.where("weight != 0")
    return held_.groupBy(ts).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(asset, "weight")))).alias("targets"))
