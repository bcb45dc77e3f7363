"""Whitening of integer vectors by an exact scatter matrix.

Vectors become whole numbers. Their sums and cross-products, taken after a shift, are added up in
unlimited precision: exactly in a block, as Python integers in a task, as limbs in Spark's sums. The
centred matrix n X'X - SS' is then formed in integers; only it becomes floating point and goes to eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: Added to every whole number by the contract of the query; also the shift that the sums take off again.
OFFSET = 1_000_000
#: Bits of a limb: limbs of 2**31 partial sums still fit a long.
LIMB = 31
ROWS = 4096


def usable(v: Column) -> Column:
    """True for vectors without null and without non-finite entries."""
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def whole_numbers(v: Column, scale: int = 64, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of every entry as long, held at the bounds of a long."""
    least, most = F.lit(-(2**63)), F.lit(2**63 - 1 - offset)
    return F.transform(v, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), least), most) + F.lit(offset))


def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of a matrix of whole numbers, as Python integers."""
    most = int(np.abs(x.astype(float)).max(initial=0)) + 1
    if most * most * max(1, len(x)) < 2**53:  # every partial sum is a whole number that a double holds
        f = x.astype(float)
        return f.sum(0).astype(np.int64).astype(object), (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.sum(0), o.T @ o


def limbs(value: int) -> list[int]:
    """Signed limbs, lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & (2**LIMB - 1)))
        value >>= LIMB
    return out


@dataclass
class Scatter:
    """n, the sums S and the cross-products of n vectors, all exact; vectors were taken off ``shift`` before."""

    n: int
    sums: np.ndarray
    cross: np.ndarray
    shift: int

    def centred(self) -> np.ndarray:
        """n X'X - SS' in Python integers; the same for any shift."""
        return self.n * self.cross - np.outer(self.sums, self.sums)

    def components(self, k: int, least: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues of the covariance, unit eigenvectors (as columns) and shares of the trace, by falling
        eigenvalue, k at most; those under ``least`` of the first have no variance and are left out."""
        v = np.array([[int(c) / (self.n * self.n) for c in row] for row in self.centred()], dtype=float).reshape(len(self.sums), len(self.sums))
        e, u = np.linalg.eigh(v) if v.size else (np.zeros(0), v)
        e, u = e[::-1], u[:, ::-1]
        good = (e > least * max(e[0], 0.0)) & (e > 0) if len(e) else np.zeros(0, bool)
        trace = np.trace(v)
        return e[good][:k], u[:, good][:, :k], e[good][:k] / trace if trace else e[good][:k]


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension in an Arrow column of lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)[None, :]].reshape(len(rows), int(d))


def scatter(vectors: DataFrame, *, shift: int = OFFSET) -> dict[int, Scatter]:
    """Exact scatter of the column ``x`` (array of long) for every dimension that occurs.

    A task hands on one row for each cell and limb; Spark adds those up, so the driver gets a number of
    rows that depends on the dimension alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for _, m in _matrix(b.column(0)):
                for at in range(0, len(m), ROWS):
                    part = m[at : at + ROWS]
                    # a long may leave its range below the shift: then Python integers from here on
                    safe = part.size == 0 or int(part.min()) > -(2**63) + abs(shift) + 1
                    s, c = products(part - shift if safe else part.astype(object) - shift)
                    d = held.setdefault(part.shape[1], [0, 0, 0])
                    d[0], d[1], d[2] = d[0] + len(part), d[1] + s, d[2] + c
        out: list[tuple[int, int, int, int, int]] = []
        for d, (n, s, c) in held.items():
            cells = [(-1, -1, n)] + [(-1, j, s[j]) for j in range(d)] + [(i, j, c[i, j]) for i in range(d) for j in range(i, d)]
            out += [(d, i, j, k, x) for i, j, value in cells for k, x in enumerate(limbs(int(value)))]
        names = ("d", "i", "j", "k", "x")
        yield pa.RecordBatch.from_arrays([pa.array([r[a] for r in out], pa.int64()) for a in range(5)], list(names))

    cells = vectors.select("x").mapInArrow(run, "d long, i long, j long, k long, x long").groupBy("d", "i", "j", "k").agg(F.sum("x").alias("x")).collect()
    found: dict[int, Scatter] = {}
    for r in cells:
        s = found.setdefault(r["d"], Scatter(0, np.zeros(r["d"], object), np.zeros((r["d"], r["d"]), object), shift))
        value = r["x"] << (LIMB * r["k"])
        if r["i"] >= 0:
            s.cross[r["i"], r["j"]] += value
            if r["i"] != r["j"]:
                s.cross[r["j"], r["i"]] += value
        elif r["j"] >= 0:
            s.sums[r["j"]] += value
        else:
            s.n += value
    return found


def _deviations(m: np.ndarray, s: Scatter) -> np.ndarray:
    """n x - S of each row, exact: as long where that is proven to hold it, else as Python integers."""
    reach = max((abs(int(m.min()) - s.shift), abs(int(m.max()) - s.shift)), default=0) if m.size else 0
    most = s.n * reach + max((abs(int(c)) for c in s.sums), default=0)
    if most < 2**31 and most * most * max(1, m.shape[1]) < 2**63:
        return s.n * (m - s.shift) - s.sums.astype(np.int64)
    return s.n * (m.astype(object) - s.shift) - s.sums


def _squares(dev: np.ndarray) -> list[int]:
    return [int(x) for x in (dev * dev).sum(1)] if dev.shape[1] else [0] * len(dev)


def identity_errors(vectors: DataFrame, models: dict) -> dict[int, float]:
    """For each dimension, the largest entry of the whitened vectors' covariance that differs from the identity's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, m in _matrix(b.column(0)):
                d = m.shape[1]
                if d in models and models[d][1].shape[1]:
                    s, w, _ = models[d]
                    y = (_deviations(m, s) / s.n).astype(float) @ w
                    held[d] = held.get(d, 0) + y.T @ y
        rows = [(d, i, j, float(c[i, j])) for d, c in held.items() for i in range(len(c)) for j in range(len(c))]
        yield pa.RecordBatch.from_arrays([pa.array([r[a] for r in rows], pa.float64() if a == 3 else pa.int64()) for a in range(4)], ["d", "i", "j", "x"])

    cells = vectors.select("x").mapInArrow(run, "d long, i long, j long, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect()
    out: dict[int, float] = {}
    for r in cells:
        error = abs(r["x"] / models[r["d"]][0].n - (r["i"] == r["j"]))
        out[r["d"]] = max(out.get(r["d"], 0.0), error)
    return out


SCHEMA = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, k: int = 16) -> DataFrame:
    """One row per usable vector and component: whitened coordinate, deviation, share of the variance.

    Null vectors and those that hold null or non-finite entries give no rows. Rows with repeated or
    null ids are rows of their own, but each distinct vector counts once in the fit. Vectors of
    different dimensions are fitted apart. Components without variance (a single distinct vector has
    no other) are left out, so that such vectors and empty ones give no rows. ``deviation`` is null where a long cannot hold
    it; ``deviation_digits`` always has it. Entries whose whole number leaves the range of a long
    are held at its bounds. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v"))).select("vec_id", whole_numbers(F.col("v"), scale).alias("x"))
    fit = scratch.put(rows.select("x").distinct(), "distinct-vectors")
    models = {}
    for d, s in scatter(fit).items():
        e, u, share = s.components(k)
        models[d] = (s, u / np.sqrt(e), share)
    errors = identity_errors(fit, models)
    scratch.drop(fit)

    kind = rows.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in _matrix(b.column(1)):
                s, w, share = models[m.shape[1]]
                c = w.shape[1]
                if not c:
                    continue
                dev = _deviations(m, s)
                squares = _squares(dev)
                y = (dev / s.n).astype(float) @ w
                every = np.repeat(np.arange(len(at)), c)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at[every])),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(every), s.n, dtype=np.int64)),
                        pa.array([q if q < 2**63 else None for q in squares], pa.int64()).take(pa.array(every)),
                        pa.array(y.reshape(-1)),
                        pa.array(np.tile(share, len(at))),
                        pa.array(np.full(len(every), errors[m.shape[1]])),
                        pa.array([str(q) for q in squares]).take(pa.array(every)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                )

    return rows.mapInArrow(run, SCHEMA.format(id=kind.simpleString()))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened coordinates of every usable embedding; odd rows as ``whiten`` says."""
    return whiten(table(spark, sf_dir, "embeddings"))
