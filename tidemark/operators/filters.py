"""Random-walk regressions filtered in pieces: a scan of conditional Gaussians.

The filter over a stretch of rows is itself one conditional Gaussian map of the state before it, and such
maps chain. Each piece of a series is reduced to its map, the maps of an asset are chained to the state before
each piece, and the pieces then run on their own. Forgetting instead of noise is the same in information form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan


@dataclass
class Piece:
    """State x given the state u before: x ~ N(a u + b, c), and what the rows say of u: information j and eta.

    With forgetting only ``scale`` (what is left of earlier information), eta and j are used."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    eta: np.ndarray
    j: np.ndarray
    scale: float = 1.0

    @classmethod
    def empty(cls, k: int) -> Piece:
        return cls(np.eye(k), np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))

    def then(self, x: np.ndarray, y: float, q: float, r: float) -> Piece:
        """One more row: the state moves by noise q, then y = x'state + noise r is seen."""
        k = len(x)
        s = q * (x @ x) + r
        gain = q * x / s
        a, b, c = np.eye(k) - np.outer(gain, x), gain * y, q * (np.eye(k) - np.outer(gain, x))
        eta, j = x * y / s, np.outer(x, x) / s
        left = np.linalg.inv(np.eye(k) + self.c @ j)
        pulled = np.linalg.inv(np.eye(k) + j @ self.c)
        return Piece(a @ left @ self.a, a @ left @ (self.b + self.c @ eta) + b, a @ left @ self.c @ a.T + c, self.a.T @ pulled @ (eta - j @ self.b) + self.eta, self.a.T @ pulled @ j @ self.a + self.j)

    def forgets(self, x: np.ndarray, y: float, r: float, forget: float) -> Piece:
        return Piece(self.a, self.b, self.c, forget * self.eta + x * y / r, forget * self.j + np.outer(x, x) / r, self.scale * forget)

    def after(self, m: np.ndarray, p: np.ndarray, forgetting: bool) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance after the piece."""
        if forgetting:
            before = np.linalg.inv(p)
            now = np.linalg.inv(self.scale * before + self.j)
            return now @ (self.scale * before @ m + self.eta), (now + now.T) / 2
        left = np.linalg.inv(np.eye(len(m)) + p @ self.j)
        c = self.a @ left @ p @ self.a.T + self.c
        return self.a @ left @ (m + p @ self.eta) + self.b, (c + c.T) / 2


def kalman_betas(panel: DataFrame, factors: list[str], lag: int = 1, q: float = 1e-5, r: float = 1e-3, p0: float = 1.0, forget: float | None = None, min_obs: int = 24, y: str = "log_return", asset: str = "asset", ts: str = "ts", days: int | None = 365) -> DataFrame:
    """Recursive least squares of each asset: betas and alpha as known ``lag`` rows before each row.

    Rows without the return or a factor teach nothing. Series are cut into pieces of ``days`` (None: one piece);
    a task holds one piece at a time.
    """
    k, names = len(factors) + 1, [*[f"beta_{f}" for f in factors], "alpha"]
    piece = scan.period(ts, days) if days else F.lit(0).cast("long")
    kept = panel.withColumn("_piece", piece)
    narrow = kept.select(F.col(asset).alias("asset"), "_piece", F.col(ts).alias("ts"), F.col(y).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(factors)])
    asset_type = dict(narrow.dtypes)["asset"]

    def rows(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack([part[[f"f{i}" for i in range(k - 1)]].astype("float64").to_numpy(), np.ones(len(part))])
        obs = part["y"].astype("float64").to_numpy()
        return x, obs, np.isfinite(obs) & np.isfinite(x).all(axis=1)

    def mapped(part: pd.DataFrame) -> pd.DataFrame:
        x, obs, good = rows(part.sort_values("ts", kind="stable"))
        p = Piece.empty(k)
        for i in np.flatnonzero(good):
            p = p.forgets(x[i], obs[i], r, forget) if forget else p.then(x[i], obs[i], q, r)
        flat = np.concatenate([np.ravel(v) for v in (p.a, p.b, p.c, p.eta, p.j)] + [[p.scale]])
        return pd.DataFrame({"asset": [part["asset"].iloc[0]], "_piece": [part["_piece"].iloc[0]], "map": [flat.tolist()], "seen": [int(good.sum())]})

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        m, p, seen, out = np.zeros(k), np.eye(k) * p0, 0, []
        for row in part.sort_values("_piece").itertuples():
            out.append((row.asset, row._2, [*m.tolist(), *p.ravel().tolist()], seen))
            parts = np.split(np.asarray(row.map), np.cumsum([k * k, k, k * k, k, k * k]))
            a = Piece(parts[0].reshape(k, k), parts[1], parts[2].reshape(k, k), parts[3], parts[4].reshape(k, k), float(parts[5][0]))
            m, p = a.after(m, p, bool(forget))
            seen += row.seen
        return pd.DataFrame(out, columns=["_a", "_q", "_state", "_seen"])

    state = f"_a {asset_type}, _q long, _state array<double>, _seen long"
    if days:
        maps = narrow.groupBy("asset", "_piece").applyInPandas(mapped, f"asset {asset_type}, _piece long, map array<double>, seen long")
        starts = maps.groupBy("asset").applyInPandas(chained, state)
        begun = kept.join(starts, F.col(asset).eqNullSafe(F.col("_a")) & F.col("_piece").eqNullSafe(F.col("_q"))).drop("_a", "_q")
    else:
        zero = [*([0.0] * k), *(np.eye(k) * p0).ravel().tolist()]
        begun = kept.withColumns({"_state": F.array(*[F.lit(float(v)) for v in zero]), "_seen": F.lit(0).cast("long")})
    schema = begun.drop("_state", "_seen").select("*", F.lit(None).cast("array<double>").alias("_known")).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ts, kind="stable").reset_index(drop=True)
        x, obs, good = rows(part.rename(columns={y: "y"} | {f: f"f{i}" for i, f in enumerate(factors)}))
        first, seen = np.asarray(part["_state"].iloc[0], dtype=float), int(part["_seen"].iloc[0])
        m, cov = first[:k].copy(), first[k:].reshape(k, k).copy()
        known = []
        for i in range(len(part)):
            if good[i]:
                cov = cov / forget if forget else cov + q * np.eye(k)
                gain = cov @ x[i] / (x[i] @ cov @ x[i] + r)
                m = m + gain * (obs[i] - x[i] @ m)
                cov = cov - np.outer(gain, x[i] @ cov)
                seen += 1
            known.append(m.tolist() if seen >= min_obs else None)
        part["_known"] = known
        return part.drop(columns=["_state", "_seen"])

    out = begun.groupBy(asset, "_piece").applyInPandas(run, schema)
    for _ in range(lag):  # of the row before, of the row before that
        out = scan.lagged(out.drop("_piece"), "_before", "_known", asset, ts, piece if days else None).drop("_known").withColumnRenamed("_before", "_known").withColumn("_piece", piece)
    for i, n in enumerate(names):
        out = out.withColumn(n, F.get("_known", F.lit(i)))
    fitted = F.col("alpha")
    for f in factors:
        fitted = fitted + F.col(f"beta_{f}") * F.col(f)
    return out.withColumn("residual", F.col(y) - fitted).select(*panel.columns, *names, "residual")
