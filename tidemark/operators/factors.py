"""Factor models by window sums: no loop over time or assets.

A regression of one or two factors needs only counts, sums and products of its rows, which window
and group aggregates give. Sums are of values centred within each asset, so that series far from
zero lose no digits. Rows where any of the values is missing count as missing altogether.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import correlation, slope, trailing
from tidemark.operators import gram
from tidemark.operators.cross_section import neutralized
from tidemark.operators.returns import momentum


def factor_columns(panel: DataFrame, factors: dict[str, str], value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The panel with one column per factor, each the return of the named asset at that time.

    One aggregation by time gathers all factors; times that lack one go."""
    rows = panel.where(F.col(asset).isin(*factors.values())).groupBy(ts).agg(*[F.max(F.when(F.col(asset) == a, F.col(value))).alias(f) for f, a in factors.items()])
    complete = rows.where(" and ".join(f"{f} is not null" for f in factors))
    return panel.join(complete, ts)


def solve(sums: dict[str, Column], k: int) -> dict[str, Column]:
    """beta_0.., alpha and r2 from the sums n, y, yy, x<i>, x<i>y, x<i>x<j> of one or two factors.

    A singular system of two falls back on the first factor alone, one without any spread on the mean.
    """
    n = sums["n"].cast("double")
    mean = lambda c: F.try_divide(c, n)
    cross = lambda ab, a, b: ab - F.try_divide(a * b, n)
    syy = cross(sums["yy"], sums["y"], sums["y"])
    sxx = cross(sums["x0x0"], sums["x0"], sums["x0"])
    sxy = cross(sums["x0y"], sums["x0"], sums["y"])
    alone = F.coalesce(F.when(sxx > 1e-18, F.try_divide(sxy, sxx)), F.lit(0.0))
    if k == 1:
        betas, explained = [alone], alone * sxy
    else:
        szz = cross(sums["x1x1"], sums["x1"], sums["x1"])
        szy = cross(sums["x1y"], sums["x1"], sums["y"])
        sxz = cross(sums["x0x1"], sums["x0"], sums["x1"])
        det = sxx * szz - sxz * sxz
        sound = det > 1e-12 * sxx * szz
        b0 = F.when(sound, F.try_divide(sxy * szz - szy * sxz, det)).otherwise(alone)
        b1 = F.when(sound, F.try_divide(szy * sxx - sxy * sxz, det)).otherwise(F.lit(0.0))
        betas, explained = [b0, b1], b0 * sxy + b1 * szy
    alpha = mean(sums["y"])
    for i, b in enumerate(betas):
        alpha = alpha - b * mean(sums[f"x{i}"])
    return {**{f"beta_{i}": b for i, b in enumerate(betas)}, "alpha": alpha, "r2": F.when(syy > 1e-18, F.try_divide(explained, syy))}


def _terms(y: Column, xs: list[Column]) -> dict[str, Column]:
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    v = lambda c: F.when(ok, c)
    out = {"n": v(F.lit(1)), "y": v(y), "yy": v(y * y)}
    for i, x in enumerate(xs):
        out |= {f"x{i}": v(x), f"x{i}y": v(x * y)}
        out |= {f"x{i}x{j}": v(x * xs[j]) for j in range(i, len(xs))}
    return out


def _rolled(panel: DataFrame, y: str, factors: list[str], w: WindowSpec, least: int, asset: str) -> DataFrame:
    whole = Window.partitionBy(asset)
    names = [y, *factors]
    centred = panel.withColumns({f"_c_{c}": F.coalesce(F.avg(c).over(whole), F.lit(0.0)) for c in names})
    terms = _terms(F.col(y) - F.col(f"_c_{y}"), [F.col(f) - F.col(f"_c_{f}") for f in factors])
    summed = centred.withColumns({f"_s_{k}": F.sum(t).over(w) for k, t in terms.items()})
    fit = solve({k: F.col(f"_s_{k}") for k in terms}, len(factors))
    enough = F.coalesce(F.col("_s_n"), F.lit(0)) >= least
    out = summed.withColumns({f"_f_{k}": F.when(enough, c) for k, c in fit.items()}).withColumn("n_obs", F.coalesce(F.col("_s_n"), F.lit(0)))
    # back from centred values
    alpha = F.col("_f_alpha") + F.col(f"_c_{y}")
    value = F.lit(0.0)
    for i, f in enumerate(factors):
        alpha = alpha - F.col(f"_f_beta_{i}") * F.col(f"_c_{f}")
        value = value + F.col(f"_f_beta_{i}") * F.col(f)
    out = out.withColumns({**{f"beta_{f}": F.col(f"_f_beta_{i}") for i, f in enumerate(factors)}, "alpha": alpha, "r2": F.col("_f_r2")})
    return out.withColumn("residual", F.col(y) - (F.col("alpha") + value)).drop(*[c for c in out.columns if c.startswith(("_c_", "_s_", "_f_"))])


def rolling_ols(panel: DataFrame, factors: list[str], window: int = 72, min_obs: int = 24, y: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Fit over the last ``window`` rows including the current one; residual within the sample."""
    return _rolled(panel, y, factors, trailing(window, asset, ts), min_obs, asset)


def causal_ols(panel: DataFrame, factors: list[str], window: int = 72, min_obs: int = 24, lag: int = 1, y: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Fit over the ``window`` rows that end ``lag`` (at least 1) rows ago; residual at the current row.

    Adds beta_<factor>, alpha, r2, n_obs and residual. No row's result depends on itself or on later rows.
    """
    if lag < 1:
        raise ValueError("a causal fit ends at least one row before the row it is used for")
    return _rolled(panel, y, factors, trailing(window, asset, ts, lag), min_obs, asset)


def grouped_ols(panel: DataFrame, factors: list[str], *by: str, y: str = "log_return", least: int = 3) -> DataFrame:
    """One fit per group: beta_<factor>, alpha, r2, n_obs."""
    terms = _terms(F.col(y), [F.col(f) for f in factors])
    sums = panel.groupBy(*by).agg(*[F.sum(t).alias(k) for k, t in terms.items()])
    fit = solve({k: F.col(k) for k in terms}, len(factors))
    enough = F.coalesce(F.col("n"), F.lit(0)) >= least
    named = {f"beta_{i}": f"beta_{f}" for i, f in enumerate(factors)}
    return sums.select(*by, F.coalesce(F.col("n"), F.lit(0)).alias("n_obs"), *[F.when(enough, c).alias(named.get(k, k)) for k, c in fit.items()])


def beta(panel: DataFrame, factor: str = "factor", y: str = "log_return", asset: str = "asset") -> DataFrame:
    """One row per asset: full-sample beta and correlation."""
    return panel.groupBy(asset).agg(slope(F.col(y), F.col(factor)).alias("beta"), correlation(F.col(y), F.col(factor)).alias("corr"))


def residual_returns(panel: DataFrame, fits: DataFrame, factors: list[str], y: str = "log_return", asset: str = "asset") -> DataFrame:
    """Adds ``residual`` = r - (alpha + betas . factors) with one fit per asset."""
    out = panel.join(fits, asset)
    value = F.col("alpha")
    for f in factors:
        value = value + F.col(f"beta_{f}") * F.col(f)
    return out.withColumn("residual", F.col(y) - value)


def walk_forward_ols(panel: DataFrame, folds: DataFrame, factors: list[str], window: int = 72, min_obs: int = 24, y: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """One fit per fold and asset over the last ``window`` training rows; then means over assets per fold.

    A fold's training ends before its test begins, so one fit serves all its test times."""
    from tidemark.operators.backtest import by_fold

    inside = by_fold(panel, folds, ts).where("part = 'train'")
    last = inside.withColumn("_rn", F.row_number().over(Window.partitionBy("fold_id", asset).orderBy(F.desc(ts)))).where(F.col("_rn") <= window)
    fits = grouped_ols(last, factors, "fold_id", asset, y=y, least=min_obs)
    return fits.groupBy("fold_id").agg(*[F.avg(f"beta_{f}").alias(f"mean_beta_{f}") for f in factors], F.avg("r2").alias("mean_r2"), F.count("r2").alias("n_assets"))


def residual_momentum(panel: DataFrame, factors: dict[str, str], window: int = 72, min_obs: int = 24, lag: int = 1, n: int = 24, y: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, asset, value: exp-sum of the last n causal residuals; the factor assets themselves have none."""
    fit = causal_ols(factor_columns(panel, factors, y, asset, ts), list(factors), window, min_obs, lag, y, asset, ts)
    own = F.when(~F.col(asset).isin(*factors.values()), F.col("residual"))
    return fit.withColumn("residual", own).select(ts, asset, momentum(F.col("residual"), n, asset, ts).alias("value"))


def residual_volatility(panel: DataFrame, n: int, freq: str, asset: str = "asset", ts: str = "ts") -> DataFrame:
    from tidemark.functions.scalars import periods_per_year

    r, w = F.col("residual"), trailing(n, asset, ts)
    rolled = panel.where(r.isNotNull()).withColumn("_v", F.when(F.count(r).over(w) == n, F.stddev_samp(r).over(w)))
    last = rolled.groupBy(asset).agg(F.max_by("_v", ts).alias("_v"))
    return last.select(asset, F.when(F.col("_v") > 0, F.col("_v") * periods_per_year(freq) ** 0.5).alias("residual_vol"))


def ewma_covariance(panel: DataFrame, halflife: float = 24.0, value: str = "log_return", asset: str = "asset", ts: str = "ts", tiles: int = 4) -> DataFrame:
    """a, b, cov: weights halve every ``halflife`` times back; deviations from plain means; times where
    an asset has no return give nothing."""
    v = gram.centred(panel, value, asset)
    times = v.select(ts).distinct().withColumn("_age", F.row_number().over(Window.orderBy(F.desc(ts))) - 1)
    times = times.withColumn("_w", F.pow(F.lit(0.5), F.col("_age") / halflife))
    total = times.agg(F.sum("_w").alias("_total"))
    sums = gram.pair_sums(v.join(times, ts), value, "_w", asset, ts, tiles)
    return gram.mirrored(sums.crossJoin(F.broadcast(total)).withColumn("cov", F.col("sxy") / F.col("_total")), "cov")


def sample_covariance(panel: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts", tiles: int = 4) -> DataFrame:
    """a, b, cov over the times that both have."""
    sums = gram.pair_sums(gram.centred(panel, value, asset), value, asset=asset, ts=ts, tiles=tiles)
    return gram.mirrored(sums.withColumn("cov", gram.sample_moment()), "cov")


def shrunk(cov: DataFrame, s: float = 0.2) -> DataFrame:
    """(1 - s) * C + s * diagonal of C."""
    return cov.withColumn("cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(F.col("cov") * (1 - s)))


def effective_trials(cov: DataFrame) -> DataFrame:
    """(sum of eigenvalues)^2 over the sum of their squares, as trace^2 over the squared Frobenius norm."""
    diag = F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")))
    return cov.agg(F.try_divide(diag * diag, F.sum(F.col("cov") * F.col("cov"))).alias("n_eff"))


def ledoit_wolf_intensity(panel: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts", tiles: int = 4) -> tuple[DataFrame, DataFrame]:
    """Centred products of all pairs over all times (a, b, s), and one row: p, n, mu, delta, beta, intensity.

    A missing return counts as the asset's mean. The intensity needs sums alone: squares of the entries, and by
    time the squared length of the cross-section, whose square is the sum of all products of squares.
    """
    v = gram.centred(panel, value, asset)
    sums = gram.pair_sums(v, value, asset=asset, ts=ts, tiles=tiles)
    by_time = v.groupBy(ts).agg(F.sum(F.col(value) * F.col(value)).alias("_q")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_q") * F.col("_q")).alias("_q4"))
    s = gram.mirrored(sums.withColumn("s", F.col("sxy")), "s")
    own = F.col("a") == F.col("b")
    entries = s.agg(F.count_if(own).alias("p"), F.sum(F.when(own, F.col("s"))).alias("_trace"), F.sum(F.col("s") * F.col("s")).alias("_s2"))
    n, p = F.col("n"), F.col("p")
    one = entries.crossJoin(by_time).withColumn("mu", F.try_divide(F.col("_trace"), n * p)).withColumn("_f", F.try_divide(F.col("_s2"), n * n))
    one = one.withColumn("delta", F.try_divide(F.col("_f") - p * F.col("mu") * F.col("mu"), p))
    one = one.withColumn("beta", F.least(F.try_divide(F.try_divide(F.col("_q4"), n) - F.col("_f"), n * p), F.col("delta")))
    return s, one.select("p", "n", "mu", "delta", "beta", F.when(F.col("delta") > 0, F.try_divide("beta", "delta")).otherwise(F.lit(0.0)).alias("intensity"))


def ledoit_wolf(panel: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts", tiles: int = 4) -> DataFrame:
    """a, b, cov: the covariance shrunk to a multiple of the identity at the asymptotically best weight, which leaves
    it positive definite."""
    s, one = ledoit_wolf_intensity(panel, value, asset, ts, tiles)
    w = F.col("intensity")
    cov = (1 - w) * F.col("s") / F.col("n") + F.when(F.col("a") == F.col("b"), w * F.col("mu")).otherwise(F.lit(0.0))
    return s.crossJoin(F.broadcast(one)).select("a", "b", cov.alias("cov"))


def positive(cov: DataFrame, *by: str, least: float = 1e-10, most: int = 4000) -> DataFrame:
    """a, b, cov: the nearest symmetric matrix without an eigenvalue below ``least``, for each of ``by``.

    An eigenvalue needs the whole matrix: one task holds one matrix of ``most`` assets at most and refuses more.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(part["a"]) | set(part["b"]))
        if len(names) > most:
            raise ValueError(f"more than {most} assets")
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        m[part["a"].map(at), part["b"].map(at)] = part["cov"].fillna(0.0)
        w, v = np.linalg.eigh((m + m.T) / 2)
        m = (v * np.maximum(w, least)) @ v.T if (w < least).any() else (m + m.T) / 2
        out = pd.DataFrame({"a": np.repeat(names, len(names)), "b": np.tile(names, len(names)), "cov": m.ravel()})
        for c in by:
            out[c] = part[c].iloc[0]
        return out[[*by, "a", "b", "cov"]]

    return cov.select(*by, "a", "b", "cov").groupBy(*by).applyInPandas(run, cov.select(*by, "a", "b", F.col("cov").cast("double").alias("cov")).schema)


def estimate_covariance(panel: DataFrame, method: str = "ewma", value: str = "log_return", asset: str = "asset", ts: str = "ts", tiles: int = 4) -> DataFrame:
    """a, b, cov by ewma (half-life 24), lw, shrink (0.2) or sample, not yet made ``positive``."""
    if method == "ewma":
        return ewma_covariance(panel, 24.0, value, asset, ts, tiles)
    if method == "lw":
        return ledoit_wolf(panel, value, asset, ts, tiles)
    cov = sample_covariance(panel, value, asset, ts, tiles)
    if method == "shrink":
        return shrunk(cov, 0.2)
    if method == "sample":
        return cov
    raise ValueError(f"unknown method: {method}")


def value_vs_beta(panel: DataFrame, factors: dict[str, str], exposures: list[str], asset: str = "asset", ts: str = "ts", **fit: int) -> DataFrame:
    """Minus residual momentum, neutral to up to two exposure columns of the panel."""
    m = residual_momentum(panel, factors, asset=asset, ts=ts, **fit).withColumn("value", -F.col("value"))
    return neutralized(m.join(panel.select(ts, asset, *exposures), [ts, asset]), exposures, "value", asset, ts).select(ts, asset, F.col("neutral").alias("value"))


def half_life_alpha(halflife: float) -> float:
    return 1 - math.exp(-math.log(2) / halflife)
