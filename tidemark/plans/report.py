"""A research report of signals: coefficients, portfolios, significance and capacity, as long tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backtest, cross_section, inference, portfolio
from tidemark.operators.returns import forward_return


@dataclass
class Report:
    """Each part is lazy; what nobody reads is not computed."""

    ic: DataFrame
    decay: DataFrame
    weights: DataFrame
    pnl: DataFrame
    performance: DataFrame
    capacity: DataFrame
    significance: DataFrame
    deflated: DataFrame


def signal_report(signal: DataFrame, returns: DataFrame, freq: str, horizons: tuple[int, ...] = (1, 6, 24), k: int = 1, rebalance: int = 1, n_trials: int = 1, fee_bps: float = portfolio.FEE_BPS, slippage_bps: float = portfolio.SLIPPAGE_BPS, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> Report:
    """Ranks, weights lagged by one bar and held between rebalancings, returns less costs, and the tests.

    A weight earns from the bar after the one that it knows; the same bar's return is never used.
    """
    fwd = forward_return(returns, horizons[0], ret, asset, ts)
    ic = cross_section.information_coefficient(signal, fwd, asset=asset, ts=ts)
    decay = cross_section.ic_decay(signal, returns, list(horizons), ret=ret, asset=asset, ts=ts)
    ranks = cross_section.ranked(signal, ts=ts)
    chosen = portfolio.long_short(ranks, k, k, adaptive=True, asset=asset, ts=ts)
    w = portfolio.lagged(chosen, 1, asset, ts)
    if rebalance > 1:
        w = portfolio.held(w, rebalance, asset, ts)
        pnl = portfolio.portfolio_returns(w, returns, ret, asset, ts).join(portfolio.turnover(w, asset, ts), ts)
    else:
        pnl = portfolio.traded(chosen, returns, 1, ret, asset, ts)
    net = portfolio.net_of_costs(pnl, fee_bps, slippage_bps)
    equity = net.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(_all_before(ts))))
    return Report(
        ic=ic,
        decay=decay,
        weights=w,
        pnl=net,
        performance=backtest.performance(equity, freq, ts=ts),
        capacity=portfolio.capacity_curve(pnl, freq=freq, fee_bps=fee_bps, slippage_bps=slippage_bps),
        significance=inference.hac_mean(net, value="net", ts=ts),
        deflated=inference.deflated_sharpe(net, n_trials, value="net"),
    )


def _all_before(ts: str):
    from pyspark.sql import Window

    return Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)


def validation_bundle(reports: dict[str, Report]) -> DataFrame:
    """One row per signal with its coefficient summary, significance and costs: what a gate reads."""
    out = None
    for name, r in reports.items():
        one = cross_section.ic_summary(r.ic).crossJoin(r.significance.select("t_hac", "p_hac")).crossJoin(r.pnl.agg(F.avg("turnover").alias("turnover"), F.avg("net").alias("mean_net"))).withColumn("signal", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return inference.adjusted(out, p="p_hac", key="signal")
