"""Sums over pairs of assets as products of tiles, for covariances and correlations of many assets.

Assets fall into tiles by hash. A group holds the times of one period for two tiles, as two matrices with a row
for each time, and hands on one row for each pair of their assets; Spark adds the periods up. What is shuffled
grows with rows times tiles, and with pairs times periods, never with pairs times times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import period

SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def centred(panel: DataFrame, value: str = "log_return", asset: str = "asset") -> DataFrame:
    """Rows with a value, less the asset's mean of it."""
    seen = panel.where(F.col(value).isNotNull())
    mean = seen.groupBy(F.col(asset).alias("_asset")).agg(F.avg(value).alias("_mean"))
    return seen.join(mean, F.col(asset) == F.col("_asset")).withColumn(value, F.col(value) - F.col("_mean")).drop("_asset", "_mean")


def pair_sums(panel: DataFrame, value: str = "log_return", weight: str | None = None, asset: str = "asset", ts: str = "ts", tiles: int = 4, days: int = 365) -> DataFrame:
    """a, b, n, sx, sy, sxy, sxx, syy over the times that both of a <= b have, products times ``weight``.

    Null values have no row; a time has one row of an asset at most. ``tiles`` should leave about a thousand assets
    in each: a group holds two tiles of assets over ``days``.
    """
    tile = F.pmod(F.xxhash64(asset), F.lit(tiles)).cast("int")
    rows = panel.where(F.col(value).isNotNull() & F.col(asset).isNotNull()).select(F.col(ts).alias("t"), F.col(asset).alias("asset"), F.col(value).cast("double").alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), tile.alias("tile"), period(ts, days).alias("p"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = rows.withColumn("o", other).select("t", "asset", "x", "w", "p", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), (F.col("tile") > F.col("o")).alias("second"))
    kind = dict(rows.dtypes)["asset"]

    def matrix(part: pd.DataFrame, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, names = pd.factorize(part["asset"], sort=True)
        x, m = np.zeros((times, len(names))), np.zeros((times, len(names)))
        x[part["row"], at], m[part["row"], at] = part["x"], 1.0
        return np.asarray(names, dtype=object), x, m

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group["row"], _ = pd.factorize(group["t"])
        times = int(group["row"].max()) + 1
        w = np.zeros(times)
        w[group["row"]] = group["w"]
        second = group["second"].to_numpy()
        a, x, mx = matrix(group[~second], times)
        b, y, my = (a, x, mx) if group["i"].iloc[0] == group["j"].iloc[0] else matrix(group[second], times)
        sums = (mx.T @ my, x.T @ my, mx.T @ y, (x * w[:, None]).T @ y, (x * x).T @ my, mx.T @ (y * y))
        left, right = np.nonzero(sums[0] > 0)
        out = pd.DataFrame({"a": a[left], "b": b[right]} | {c: s[left, right] for c, s in zip(SUMS, sums, strict=True)})
        if b is a:
            return out[left <= right]
        back = out["a"] > out["b"]  # the smaller name stands first
        swapped = out[back].rename(columns={"a": "b", "b": "a", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"})
        return pd.concat([out[~back], swapped[out.columns]])

    parts = dealt.groupBy("p", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, " + ", ".join(f"{c} double" for c in SUMS))
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])


#: Assets of a tile and of a block within it, where pairs are summed up in the task.
TILE, SIDE = 6_000, 500


def correlation_means(panel: DataFrame, value: str = "log_return", asset: str = "asset", ts: str = "ts", least: int = 5, tiles: int | None = None) -> DataFrame:
    """a, n_pairs, n_times, mean_corr: for each asset the pairs a <= b with common times, their common times together and
    their mean correlation, over pairs of ``least`` common times and more.

    All pairs are computed, from all times, but none leaves its task: a group holds the series of two tiles of assets,
    goes over them in blocks and hands on one row for each asset. What is shuffled grows with rows times tiles; a task holds two
    tiles' rows and the matrices of one block. Tiles are ``TILE`` assets, or smaller where series are long; acts at once to count.
    """
    seen = centred(panel.where(F.col(asset).isNotNull()), value, asset)
    series = seen.groupBy(F.col(asset).alias("asset")).agg(F.collect_list(F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("x"))).alias("_s"))
    if tiles is None:
        assets, rows = series.agg(F.count(F.lit(1)), F.sum(F.size("_s"))).first()
        tiles = max(4, -(-assets // TILE), -(-(rows or 0) // 5_000_000))
    dealt = series.select("asset", F.col("_s.t").alias("t"), F.col("_s.x").alias("x"), F.pmod(F.xxhash64("asset"), F.lit(tiles)).cast("int").alias("tile"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("asset", "t", "x", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), (F.col("tile") > F.col("o")).alias("second"))
    kind = dict(dealt.dtypes)["asset"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("asset")
        times = np.unique(np.concatenate(group["t"].to_list()))
        own = group["i"].iloc[0] == group["j"].iloc[0]
        sides = [group] if own else [group[~group["second"]], group[group["second"]]]
        names = [g["asset"].to_numpy() for g in sides]
        totals = [np.zeros((4, len(n))) for n in names]

        def matrix(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            x, m = np.zeros((len(g), len(times))), np.zeros((len(g), len(times)))
            at, row = np.searchsorted(times, np.concatenate(g["t"].to_list())), np.repeat(np.arange(len(g)), g["t"].map(len))
            x[row, at], m[row, at] = np.concatenate(g["x"].to_list()), 1.0
            return x, m

        for p in range(0, len(sides[0]), SIDE):
            x, mx = matrix(sides[0].iloc[p : p + SIDE])
            for q in range(p if own else 0, len(sides[-1]), SIDE):
                y, my = matrix(sides[-1].iloc[q : q + SIDE])
                n, sx, sy, sxx, syy = mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T
                with np.errstate(divide="ignore", invalid="ignore"):
                    c = (x @ y.T - sx * sy / n) / (n - 1)
                    spread = np.sqrt(np.maximum((sxx - sx * sx / n) / (n - 1), 0.0)) * np.sqrt(np.maximum((syy - sy * sy / n) / (n - 1), 0.0))
                    corr = c / spread
                ok = (n >= max(least, 2)) & (spread > 1e-15)
                corr[~ok] = 0.0
                first = names[0][p : p + SIDE]
                before = np.searchsorted(names[-1][q : q + SIDE], first, side="left")[:, None] <= np.arange(len(y))[None, :]
                for k, v in enumerate((n > 0, n, corr, ok)):
                    totals[0][k, p : p + len(x)] += np.where(before, v, 0.0).sum(axis=1)
                    if not own:  # the smaller name stands first
                        totals[1][k, q : q + len(y)] += np.where(before, 0.0, v).sum(axis=0)
        return pd.concat([pd.DataFrame({"a": n, "n_pairs": t[0], "n_times": t[1], "total": t[2], "n_corr": t[3]}) for n, t in zip(names, totals, strict=True)])

    parts = dealt.groupBy("i", "j").applyInPandas(run, f"a {kind}, n_pairs double, n_times double, total double, n_corr double")
    out = parts.groupBy("a").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "n_times", "total", "n_corr")]).where("n_pairs > 0")
    return out.select("a", F.col("n_pairs").cast("long").alias("n_pairs"), F.col("n_times").cast("long").alias("n_times"), F.try_divide("total", "n_corr").alias("mean_corr"))


def mirrored(pairs: DataFrame, *values: str) -> DataFrame:
    """Each pair a <= b, and each pair of different assets the other way round too."""
    here = F.struct(F.col("a").alias("a"), F.col("b").alias("b"), *values)
    there = F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *values))
    return pairs.select(F.inline(F.array_compact(F.array(here, there))))


def sample_moment(x: str = "sx", y: str = "sy", xy: str = "sxy") -> Column:
    """Covariance from sums, NULL below two rows."""
    return F.when(F.col("n") > 1, F.try_divide(F.col(xy) - F.col(x) * F.col(y) / F.col("n"), F.col("n") - 1))


def sample_correlation() -> Column:
    spread = F.sqrt(F.greatest(sample_moment("sx", "sx", "sxx"), F.lit(0.0))) * F.sqrt(F.greatest(sample_moment("sy", "sy", "syy"), F.lit(0.0)))
    return F.when(spread > 1e-15, F.try_divide(sample_moment(), spread))
