"""Quadratic programs of many times at once: mean against variance under net, gross and single limits.

Each time is one row with the arrays of its assets; a batch of such rows is solved together by numpy in
the tasks, every step for all of its problems. Nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (problems x assets) that are solved together.
CELLS = 2_000_000


def _level(low: np.ndarray, high: np.ndarray, total, want: np.ndarray, rounds: int = 80) -> np.ndarray:
    """For each problem the level at which a falling function ``total`` has the wanted value, by bisection."""
    for _ in range(rounds):
        middle = (low + high) / 2
        above = total(middle) > want
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def project(v: np.ndarray, there: np.ndarray, net: float, gross: float, most: float, long_only: bool) -> np.ndarray:
    """Nearest points with sum ``net``, absolute sum of ``gross`` at most and entries of ``most`` at most.

    Where the gross limit binds, longs and shorts are two problems of their own: their sums are known.
    """
    low = 0.0 if long_only else -most
    edge = np.abs(np.where(there, v, 0.0)).max(axis=1, initial=0.0) + most + 1
    held = lambda w: np.where(there, w, 0.0)
    free = lambda shift: held(np.clip(v - shift[:, None], low, most))
    every = np.full(len(v), net)
    w = free(_level(-edge, edge, lambda s: free(s).sum(1), every))
    binds = np.abs(w).sum(1) > gross
    if binds.any() and not long_only:
        u, on, end = v[binds], there[binds], edge[binds]
        up = lambda a: np.where(on, np.clip(u - a[:, None], 0.0, most), 0.0)
        down = lambda b: np.where(on, np.clip(-u - b[:, None], 0.0, most), 0.0)
        long = up(_level(-end, end, lambda a: up(a).sum(1), np.full(len(u), (gross + net) / 2)))
        short = down(_level(-end, end, lambda b: down(b).sum(1), np.full(len(u), (gross - net) / 2)))
        w[binds] = long - short
    return w


def dual_start(s: np.ndarray, h: np.ndarray, exposures: np.ndarray, there: np.ndarray, net: float, gross: float, most: float, long_only: bool, aversion: float, rounds: int = 200) -> np.ndarray:
    """Weights by Newton's method on the dual, which has a variable for the net limit, one for the gross limit and one for each
    factor, however many assets there are. For given duals every asset has its own answer: s - mu - E nu, less lambda
    towards zero, over h, within its limits.
    """
    p, k = len(s), exposures.shape[2]
    theta, low = np.zeros((p, k + 2)), 0.0 if long_only else -most
    curve = np.diag([0.0, 0.0, *[1.0 / aversion] * k])

    def at(theta: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = s[rows] - theta[:, :1] - np.einsum("pnk,pk->pn", exposures[rows], theta[:, 2:])
        u = np.sign(v) * np.maximum(np.abs(v) - theta[:, 1:2], 0.0) / h[rows]
        w = np.where(there[rows], np.clip(u, low, most), 0.0)
        value = (0.5 * h[rows] * w * w - v * w + theta[:, 1:2] * np.abs(w)).sum(1) - theta[:, 1] * gross - theta[:, 0] * net - (theta[:, 2:] ** 2).sum(1) / (2 * aversion)
        return w, there[rows] & (u != 0) & (u > low) & (u < most), value

    left, reach = np.arange(p), np.abs(np.where(there, s, 0.0)).max(axis=1, initial=0.0) + 1
    for _ in range(rounds):
        t = theta[left]
        w, inside, value = at(t, left)
        c = np.concatenate([np.ones((*w.shape, 1)), np.sign(w)[:, :, None], exposures[left]], axis=2)
        slope = np.einsum("pnk,pn->pk", c, w) - np.concatenate([np.full((len(left), 1), net), np.full((len(left), 1), gross), t[:, 2:] / aversion], axis=1)
        bend = np.einsum("pnk,pnl->pkl", c * (inside / h[left])[:, :, None], c) + curve
        held = (t[:, 1] <= 0) & (slope[:, 1] <= 0) | long_only
        slope[held, 1], bend[held, 1, :], bend[held, :, 1] = 0.0, 0.0, 0.0
        bend += np.eye(k + 2) * (1e-12 * np.maximum(np.trace(bend, axis1=1, axis2=2), 1e-6))[:, None, None]
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        # where no asset lies between its limits the dual has a kink and no curvature: no further than the largest expectation
        step *= np.minimum(1.0, reach[left] / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
        moved, open_ = t.copy(), np.ones(len(left), bool)
        for half in range(60):
            new = t[open_] + step[open_] * 0.5**half
            new[:, 1] = np.maximum(new[:, 1], 0.0)
            better = at(new, left[open_])[2] >= value[open_] + 1e-4 * (slope[open_] * (new - t[open_])).sum(1)
            rows = np.flatnonzero(open_)[better]
            moved[rows], open_[rows] = new[better], False
            if not open_.any():
                break
        theta[left] = moved
        left = left[~open_ & (np.abs(moved - t).max(axis=1) > 1e-15) & (np.abs(slope).max(axis=1) > 1e-13)]
        if not len(left):
            break
    return at(theta, np.arange(p))[0]


def solve(s: np.ndarray, variance: np.ndarray, exposures: np.ndarray, there: np.ndarray, *, net: float = 0.0, gross: float = 1.0, most: float = 0.1, long_only: bool = False, aversion: float = 1.0, ridge: float = 1e-6, tolerance: float = 1e-9, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and distances from optimality of problems x assets.

    Minimises aversion/2 w'(diag(variance) + EE')w - s'w + ridge/2 |w|^2 by Newton's method on the dual, from
    whose weights accelerated projected gradients with restarts go on until nothing moves. The distance is the largest |w - P(w - gradient)|: zero exactly where the conditions of Karush, Kuhn
    and Tucker hold.
    """
    slope = lambda w: aversion * (variance * w + np.einsum("pnk,pk->pn", exposures, np.einsum("pnk,pn->pk", exposures, w))) + ridge * w - s
    inner = np.einsum("pnk,pnl->pkl", exposures, exposures)
    top = np.linalg.eigvalsh(inner)[:, -1] if inner.shape[1] else np.zeros(len(s))
    step = (1.0 / (aversion * (variance.max(axis=1, initial=0.0) + top) + ridge))[:, None]
    limits = (there, net, gross, most, long_only)
    h = aversion * variance + ridge
    start = dual_start(s, np.where(there, h, 1.0), exposures, there, net, gross, most, long_only, aversion) if aversion > 0 and (h[there] > 0).all() else np.zeros_like(s)
    w = project(np.where(np.isfinite(start), start, 0.0), *limits)
    y, t = w, np.ones((len(s), 1))
    for _ in range(rounds):
        new = project(y - step * slope(y), *limits)
        turn = ((y - new) * (new - w)).sum(1, keepdims=True) > 0  # momentum points uphill
        t_new = np.where(turn, 1.0, (1 + np.sqrt(1 + 4 * t * t)) / 2)
        y = np.where(turn, new, new + (t - 1) / t_new * (new - w))
        moved = np.abs(new - w).max(initial=0.0)
        w, t = new, t_new
        if moved < tolerance * 0.01:
            break
    return w, np.abs(w - project(w - slope(w), *limits)).max(axis=1, initial=0.0)


def quadratic_weights(panel: DataFrame, expected: str = "expected", variance: str = "variance", exposures: tuple[str, ...] = (), *, asset: str = "asset", ts: str = "ts", net: float = 0.0, gross: float = 1.0, most: float = 0.1, long_only: bool = False, aversion: float = 1.0, ridge: float = 1e-6) -> DataFrame:
    """ts, asset, weight, kkt: the best weights of each time and how far they are from optimal.

    Risk is own variances plus products of the exposure columns, whose factors have variance 1. A missing
    expectation, variance or exposure is 0. Times whose assets cannot meet the limits (too few for ``net``) have
    NULL weights. One time's assets are one row; a task solves some times together.
    """
    cells = F.struct(F.col(asset).alias("asset"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((expected, "s"), (variance, "v"), *((e, f"e{i}") for i, e in enumerate(exposures)))])
    problems = panel.groupBy(F.col(ts).alias("ts")).agg(F.array_sort(F.collect_list(cells)).alias("cells"))
    names = [f"e{i}" for i in range(len(exposures))]
    flat = problems.select("ts", *[F.col("cells")[c].alias(c) for c in ("asset", "s", "v", *names)])
    kind = dict(panel.dtypes)[asset]

    def some(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["s"].map(len).to_numpy()
        n = int(sizes.max())
        there = np.arange(n)[None, :] < sizes[:, None]

        def filled(c: str) -> np.ndarray:
            out = np.zeros((len(group), n))
            out[there] = np.concatenate(group[c].to_list())
            return out

        e = np.stack([filled(c) for c in names], axis=2) if names else np.zeros((len(group), n, 0))
        w, kkt = solve(filled("s"), filled("v"), e, there, net=net, gross=gross, most=most, long_only=long_only, aversion=aversion, ridge=ridge)
        met = (abs(net) <= np.minimum(gross, sizes * most) + 1e-12) & (net >= 0 if long_only else True)
        w[~met], kkt[~met] = np.nan, np.nan
        return pd.DataFrame({"ts": np.repeat(group["ts"].to_numpy(), sizes), "asset": np.concatenate(group["asset"].to_list()), "weight": w[there], "kkt": np.repeat(kkt, sizes)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.iloc[np.argsort(b["s"].map(len).to_numpy(), kind="stable")]
            at = 0
            while at < len(b):
                size = len(b["s"].iloc[at])
                k = at + 1
                while k < len(b) and (k + 1 - at) * len(b["s"].iloc[k]) <= max(CELLS, size):
                    k += 1
                yield some(b.iloc[at:k])
                at = k

    solved = flat.mapInPandas(run, f"ts {dict(problems.dtypes)['ts']}, asset {kind}, weight double, kkt double")
    return solved.select(F.col("ts").alias(ts), F.col("asset").alias(asset), F.nanvl("weight", F.lit(None).cast("double")).alias("weight"), F.nanvl("kkt", F.lit(None).cast("double")).alias("kkt"))
