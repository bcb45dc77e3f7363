"""Cross-sectional signal builders over long panels; each gives ts, asset, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import bars_for_hours
from tidemark.functions.windows import full, slope, trailing
from tidemark.operators.bars import dense
from tidemark.operators.cross_section import neutralized, winsorized, zscore
from tidemark.operators.returns import dispersion, dispersion_z, momentum


def _without(panel: DataFrame, value: Column, factors: list[str], asset: str, ts: str) -> DataFrame:
    return panel.select(ts, asset, F.when(~F.col(asset).isin(*factors), value).alias("value") if factors else value.alias("value"))


def momentum_24h(panel: DataFrame, freq: str, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """exp of the sum of the last day's observed log returns, less 1."""
    seen = panel.where(F.col(ret).isNotNull())
    return seen.select(ts, asset, momentum(F.col(ret), bars_for_hours(freq, 24), asset, ts).alias("value"))


def clean_momentum(panel: DataFrame, freq: str, exposures: list[str], factors: list[str] = (), ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The day's momentum, neutral to beta and volatility (columns of the panel); factor assets have none."""
    m = panel.withColumn("value", momentum(F.col(ret), bars_for_hours(freq, 24), asset, ts))
    out = neutralized(m, exposures, "value", asset, ts)
    return _without(out, F.col("neutral"), list(factors), asset, ts)


def low_vol_tilt(panel: DataFrame, freq: str, factors: list[str] = (), ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Minus the deviation of the last day's returns."""
    n, r = bars_for_hours(freq, 24), F.col(ret)
    return _without(panel, -full(F.stddev_samp(r), r, n, trailing(n, asset, ts)), list(factors), asset, ts)


def sign_of(series: DataFrame, value: str = "z", ts: str = "ts", causal: bool = False) -> DataFrame:
    """ts, sign: of the last known value, before the first one of the first to come (unless ``causal``); 0 is +1."""
    before = F.last(value, True).over(Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(value, True).over(Window.orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0))  # see order.running
    z = before if causal else F.coalesce(before, after)
    return series.select(ts, F.when(z >= 0, 1.0).when(z < 0, -1.0).alias("sign"))


def low_vol_by_dispersion(panel: DataFrame, freq: str, window: int = 24, ret: str = "log_return", asset: str = "asset", ts: str = "ts", causal: bool = False) -> DataFrame:
    tilt = low_vol_tilt(panel, freq, (), ret, asset, ts)
    return conditioned(tilt, dispersion_z(dispersion(panel, ret, ts), window, ts=ts), "z", asset, ts, causal)


def conditioned(signal: DataFrame, z: DataFrame, column: str = "z", asset: str = "asset", ts: str = "ts", causal: bool = False) -> DataFrame:
    """The signal times the sign of the dispersion z-score at its time."""
    return signal.join(sign_of(z, column, ts, causal), ts).select(ts, asset, (F.col("value") * F.col("sign")).alias("value"))


def short_reversal(panel: DataFrame, freq: str, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Minus the sum over a quarter of a day (two rows at least)."""
    n, r = max(2, bars_for_hours(freq, 24) // 4), F.col(ret)
    return panel.select(ts, asset, (-full(F.sum(r), r, n, trailing(n, asset, ts))).alias("value"))


def volume_surprise(panel: DataFrame, freq: str, volume: str = "volume", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Minus the z-score across assets of log volume over its mean of the day before (this row left out)."""
    n = bars_for_hours(freq, 24)
    v = F.log(F.col(volume) + 1)
    d = panel.withColumn("_v", v).withColumn("_d", F.col("_v") - full(F.avg("_v"), F.col("_v"), n, trailing(n, asset, ts, lag=1)))
    return d.select(ts, asset, (-zscore(F.col("_d"), ts)).alias("value"))


def composite(panel: DataFrame, freq: str, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Mean of the z-scores of reversal and low volatility; NULL if either is."""
    a = short_reversal(panel, freq, ret, asset, ts).withColumnRenamed("value", "a")
    b = low_vol_tilt(panel, freq, (), ret, asset, ts).withColumnRenamed("value", "b")
    both = a.join(b, [ts, asset])
    return both.select(ts, asset, ((zscore(F.col("a"), ts) + zscore(F.col("b"), ts)) / 2).alias("value"))


def beta_compression(panel: DataFrame, factor: str = "factor", short: int = 24, long: int = 72, ret: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Short rolling beta less the long one (a column of the panel holds the factor's return)."""
    y, x = F.col(ret), F.col(factor)

    def b(n: int) -> Column:
        w = trailing(n, asset, ts)
        return F.when(F.count(F.when(x.isNotNull(), y)).over(w) == n, slope(y, x, w))

    return panel.select(ts, asset, (b(short) - b(long)).alias("value"))


def liquidity_shock(panel: DataFrame, n: int, p: float = 0.01, limit: float = 5.0, liquidity: str = "liquidity_usd", roll_vol: str | None = None, asset: str = "asset", ts: str = "ts", on_grid: bool = True) -> DataFrame:
    """Minus the winsorized, clipped z-score of the change of log liquidity over n times of the grid."""
    base = dense(panel, liquidity, asset, ts) if on_grid else panel.select(ts, asset, liquidity)
    if roll_vol:
        base = base.join(panel.select(ts, asset, roll_vol), [ts, asset], "left")
    level = F.log(F.greatest(F.col(liquidity), F.lit(1.0)))
    d = base.withColumn("_l", F.when(F.col(liquidity).isNotNull(), level))
    d = d.withColumn("_d", F.col("_l") - F.lag("_l", n).over(Window.partitionBy(asset).orderBy(ts)))
    if roll_vol:
        d = d.withColumn("_d", F.when(F.col(roll_vol) > 0, F.try_divide("_d", roll_vol)))
    d = d.withColumn("_w", winsorized(F.col("_d"), ts, p=p))
    return d.select(ts, asset, (-zscore(F.col("_w"), ts, limit=limit)).alias("value"))


#: The grid of the liquidity-shock family: times back, winsorizing share, clip.
SHOCK_GRID = [(n, p, c) for n in (6, 12, 24, 48) for p in (0.01, 0.05) for c in (3.0, 5.0)]


def liquidity_shock_variants(panel: DataFrame, liquidity: str = "liquidity_usd", roll_vol: str | None = None, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """All sixteen variants, with ``variant`` naming each; one grid serves them all."""
    base = dense(panel, liquidity, asset, ts)
    if roll_vol:
        base = base.join(panel.select(ts, asset, roll_vol), [ts, asset], "left")
    out = None
    for n, p, c in SHOCK_GRID:
        one = liquidity_shock(base, n, p, c, liquidity, roll_vol, asset, ts, on_grid=False).withColumn("variant", F.lit(f"N{n}_w{p}_c{c:g}"))
        out = one if out is None else out.unionByName(one)
    return out


def detect(metrics: DataFrame, compress: float = 0.15, high: float = 1.0, low: float = -1.0, residual: float = 0.01, label: str = "asset", ts: str = "ts") -> DataFrame:
    """Events of metrics rows (beta_short, beta_long, dispersion_z, residual_return): one row each with
    signal, value and threshold."""
    event = lambda ok, name, v, t: F.when(ok, F.struct(F.lit(name).alias("signal"), v.cast("double").alias("value"), t.cast("double").alias("threshold")))
    b, l, z, r = (F.col(c) for c in ("beta_short", "beta_long", "dispersion_z", "residual_return"))
    events = F.array(
        event(b < l - compress, "beta_compression_trigger", b, l - compress),
        event(z > high, "dispersion_extreme", z, F.lit(high)),
        event(z < low, "dispersion_extreme", z, F.lit(low)),
        event(r > residual, "residual_momentum", r, F.lit(residual)),
    )
    return metrics.select(ts, label, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(ts, label, "e.*")
