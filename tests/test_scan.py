"""Recursions over time, cut in pieces, against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, portfolio, returns, scan


@pytest.fixture(scope="module")
def series(spark):
    """One asset with nine tenths of all rows, some without value at starts, ends and for whole pieces."""
    rng = np.random.default_rng(8)
    rows, start = [], dt.datetime(2024, 1, 1)
    for asset, n in (("hot", 900), ("small", 60), ("one", 1), ("none", 40)):
        for i in range(n):
            x = None if asset == "none" or rng.random() < 0.2 or (asset == "hot" and (i < 30 or 360 <= i < 560 or i > 890)) else float(rng.normal(100, 10))
            rows.append((asset, start + dt.timedelta(hours=i), x, f"tag{i}"))
    return spark.createDataFrame(rows, "asset string, ts timestamp, close double, tag string").cache()


@pytest.mark.parametrize("days", [None, 1, 7, 8, 365])
def test_pieces_give_the_plain_recursion(series, days):
    alphas = {"a": 0.3, "b": 2 / 21, "c": 1.0}
    got = returns.exponential(series.repartition(7), {n: ("close", a) for n, a in alphas.items()}, days=days)
    assert got.columns == [*series.columns, "a", "b", "c"]
    got = got.toPandas().sort_values(["asset", "ts"])
    assert len(got) == series.count() and set(got.tag) == {r["tag"] for r in series.select("tag").distinct().collect()}
    for _, g in got.groupby("asset"):
        for n, a in alphas.items():
            want = g.close.astype(float).ewm(alpha=a, adjust=False, ignore_na=False).mean() if a < 1 else g.close.astype(float).ffill()
            assert np.allclose(g[n].astype(float), want, rtol=1e-12, equal_nan=True)


def test_a_series_in_one_piece_is_exact(spark):
    """The same numbers as s + alpha * (x - s), bit by bit, over several blocks."""
    x = np.random.default_rng(1).normal(size=300).tolist()
    p = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "asset string, ts int, x double")
    got = [r["y"] for r in scan.exponential(p, {"y": ("x", 0.3)}).orderBy("ts").collect()]
    s, want = x[0], []
    for v in x:
        s = s + 0.3 * (v - s)
        want.append(s)
    assert got == want


def test_hot_series_is_dealt_to_tasks(series):
    plan = returns.trend_and_rsi(series, (20,), days=7)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "FlatMapGroups" not in plan
    pieces = series.groupBy("asset", scan.period("ts", 7)).count().where("asset = 'hot'")
    assert pieces.count() >= 5


@pytest.mark.parametrize("days", [None, 3])
def test_values_before_reach_over_pieces(series, days):
    got = scan.lagged(series, "before", "close", cut=scan.period("ts", days) if days else None)
    w = series.withColumn("want", F.lag("close").over(__import__("pyspark").sql.Window.partitionBy("asset").orderBy("ts")))
    both = got.join(w.select("asset", "ts", "want"), ["asset", "ts"])
    assert both.count() == series.count() and both.where("not (before <=> want)").count() == 0


def test_rsi_in_pieces(series):
    full = series.where("close is not null")
    a, b = (returns.trend_and_rsi(full, (20, 50), days=d).toPandas().sort_values(["asset", "ts"]).reset_index(drop=True) for d in (None, 5))
    for c in ("ema20", "ema50", "rsi"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, equal_nan=True)


def test_grid_without_a_cross_join(spark):
    rows = [("a", 2, 1.0), ("a", 5, None), ("b", 1, 3.0), ("b", 1, 4.0), ("c", 7, 5.0)]
    p = spark.createDataFrame(rows, "asset string, ts int, x double")
    d = bars.dense(p, "x")
    assert "Cartesian" not in d._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, d.collect()), key=str)
    grid = pd.MultiIndex.from_product([[1, 2, 5, 7], ["a", "b", "c"]])
    want = []
    for t, a in grid:
        own = [x for b, u, x in rows if (a, t) == (b, u)] or [None]
        want += [(t, a, x) for x in own]
    assert got == sorted(want, key=str)
    assert bars.dense(p.limit(0), "x").count() == 0


def test_smoothed_weights_decay_to_the_end(spark):
    w = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 2, -1.0), ("b", 4, -1.0)], "asset string, ts int, weight double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {(r["asset"], r["ts"].second): r["weight"] for r in portfolio.smoothed(w, 0.5).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("a", 4): 0.5, ("b", 1): 0.0, ("b", 2): -0.5, ("b", 4): -0.75}
