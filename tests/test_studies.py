"""Quadratic programs, pair sums and what rests on them, against dense matrices."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors, gram, optimize


def test_projection_is_nearest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, gross, most = 6, float(rng.uniform(0.2, 1.5)), float(rng.uniform(0.1, 0.5))
        net = float(rng.uniform(-0.1, 0.1))
        v = rng.normal(size=(1, n))
        w = optimize.project(v, np.ones((1, n), bool), net, gross, most, False)[0]
        assert abs(w.sum() - net) < 1e-9 and np.abs(w).sum() <= gross + 1e-9 and np.abs(w).max() <= most + 1e-12
        for _ in range(300):  # no feasible point is nearer: (v - w)'(u - w) <= 0
            u = optimize.project(rng.normal(size=(1, n)), np.ones((1, n), bool), net, gross, most, False)[0]
            assert (v[0] - w) @ (u - w) < 1e-7


def test_problems_are_solved_together_as_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(t, f"a{i}", float(rng.normal(0, 0.1)), float(rng.uniform(0.01, 0.2)), float(rng.normal(0, 0.2)), float(rng.normal(0, 0.2))) for t in range(7) for i in range(int(rng.integers(3, 15)))]
    rows += [(9, "lone", 0.3, 0.1, None, None), (8, "x", None, None, 0.1, 0.1), (8, "y", 0.5, 0.1, 0.1, 0.1)]
    p = spark.createDataFrame(rows, "ts int, asset string, expected double, variance double, e1 double, e2 double")
    out = optimize.quadratic_weights(p, exposures=("e1", "e2"), net=0.1, gross=0.9, most=0.3, aversion=2.0).toPandas()
    assert len(out) == len(rows) and out.kkt.max() < 1e-6
    frame = pd.DataFrame(rows, columns=["ts", "asset", "s", "v", "e1", "e2"]).fillna(0.0)
    for t, g in frame.groupby("ts"):
        w = out[out.ts == t].set_index("asset").weight.loc[g.asset].to_numpy()
        assert abs(w.sum() - 0.1) < 1e-7 and np.abs(w).sum() < 0.9 + 1e-7 and np.abs(w).max() < 0.3 + 1e-9
        e = g[["e1", "e2"]].to_numpy()
        value = lambda x: x @ (np.diag(g.v) + e @ e.T) @ x + 0.5e-6 * x @ x - g.s.to_numpy() @ x  # noqa: B023, E731
        for _ in range(200):
            u = optimize.project(w[None] + rng.normal(0, 0.05, (1, len(w))), np.ones((1, len(w)), bool), 0.1, 0.9, 0.3, False)[0]
            assert value(w) <= value(u) + 1e-9
    none = optimize.quadratic_weights(p, net=0.8, gross=0.9, most=0.1)
    assert {r["ts"] for r in none.where("weight is null").collect()} == {t for t, g in frame.groupby("ts") if len(g) * 0.1 < 0.8 - 1e-12}
    assert optimize.quadratic_weights(p, net=0.2, long_only=True).where("weight < 0").count() == 0
    assert optimize.quadratic_weights(p.limit(0)).count() == 0


@pytest.fixture(scope="module")
def returns_(spark):
    rng = np.random.default_rng(6)
    rows = [(t * 86_400 * 40, f"a{i:02d}", float(rng.normal(5, 1)) if rng.random() < 0.8 else None) for t in range(40) for i in range(12)]
    df = spark.createDataFrame(rows, "sec long, asset string, log_return double").withColumn("ts", F.timestamp_seconds("sec"))
    return df.cache(), pd.DataFrame(rows, columns=["t", "a", "x"]).pivot(index="t", columns="a", values="x")


@pytest.mark.parametrize("tiles,days", [(1, 10_000), (5, 365), (3, 1)])
def test_tiles_give_the_pairwise_covariance(returns_, tiles, days):
    df, wide = returns_
    want, corr = wide.cov(), wide.corr()
    sums = gram.pair_sums(gram.centred(df), tiles=tiles, days=days)
    got = {(r["a"], r["b"]): r for r in sums.select("a", "b", "n", gram.sample_moment().alias("cov"), gram.sample_correlation().alias("corr")).collect()}
    assert set(got) == {p for p in itertools.combinations_with_replacement(wide.columns, 2)}
    for (a, b), r in got.items():
        assert r["cov"] == pytest.approx(want.loc[a, b], rel=1e-10) and r["corr"] == pytest.approx(corr.loc[a, b], rel=1e-9) and r["n"] == (wide[a].notna() & wide[b].notna()).sum()
    assert gram.pair_sums(df.limit(0)).count() == 0


def test_no_pair_of_assets_at_a_time_is_shuffled(returns_):
    df, _ = returns_
    plan = factors.sample_covariance(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Cartesian" not in plan


def test_ledoit_wolf_against_the_dense_form(returns_):
    df, wide = returns_
    x = (wide - wide.mean()).fillna(0.0).to_numpy()
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((((x**2).T @ (x**2)).sum() / n - (s**2).sum()) / (n * p), delta)
    want = beta / delta * mu * np.eye(p) + (1 - beta / delta) * s
    got = factors.ledoit_wolf(df, tiles=3).toPandas().pivot(index="a", columns="b", values="cov").to_numpy()
    assert np.allclose(got, want, rtol=1e-10)


def test_positive_clips_eigenvalues(spark):
    m = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    rows = [(k, a, b, float(m[i, j])) for k in ("g", "h") for i, a in enumerate("xyz") for j, b in enumerate("xyz")]
    got = factors.positive(spark.createDataFrame(rows, "k string, a string, b string, cov double"), "k").toPandas()
    w, v = np.linalg.eigh(m)
    for _, g in got.groupby("k"):
        assert np.allclose(g.pivot(index="a", columns="b", values="cov"), (v * np.maximum(w, 1e-10)) @ v.T)
    with pytest.raises(Exception, match="more than 2 assets"):
        factors.positive(spark.createDataFrame(rows, "k string, a string, b string, cov double"), "k", most=2).count()


# --- order over all rows ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def p_values(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), float(p), float(rng.normal())) for i, p in enumerate(np.round(rng.beta(0.4, 1.0, 3000), 3))]
    return spark.createDataFrame(rows, "id int, p double, z double").repartition(9).cache(), sorted(rows, key=lambda r: (r[1], r[0]))


def test_positions_over_all_rows(spark, p_values):
    from tidemark.operators import order

    df, rows = p_values
    got = {r["id"]: r["rank"] for r in order.numbered(df, "p", "id").collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(rows)}
    assert order.numbered(df.limit(0), "p").count() == 0
    plan = order.numbered(df, "p", "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # dealt once, before


@pytest.mark.parametrize("method,compat", [("bh", False), ("bh", True), ("by", False)])
def test_adjusted_p_values_over_all_rows(p_values, method, compat):
    from tidemark.operators import inference

    df, rows = p_values
    n = len(rows)
    c = sum(1 / i for i in range(1, n + 1)) if method == "by" else 1.0
    raw = [min(1.0, r[1] * n * c / (i + 1)) for i, r in enumerate(rows)]
    want = list(itertools.accumulate(raw, max)) if compat else list(itertools.accumulate(raw[::-1], min))[::-1]
    got = {r["id"]: r["p_adj"] for r in inference.adjusted(df, method, compat=compat).collect()}
    assert all(got[r[0]] == pytest.approx(w, rel=1e-12) for r, w in zip(rows, want, strict=True))
    assert inference.adjusted(df, method).columns == ["id", "p", "z", "p_adj", "rejected"]


# --- filters ------------------------------------------------------------------------------------


@pytest.mark.parametrize("forget,lag", [(None, 1), (0.98, 1), (None, 3)])
def test_filter_in_pieces_equals_the_filter(spark, forget, lag):
    from tidemark.operators import filters

    rng = np.random.default_rng(2)
    rows = []
    for name, n in (("hot", 240), ("b", 50), ("short", 5)):
        beta = np.cumsum(rng.normal(0, 0.05, n)) + 1
        for i in range(n):
            f, g = rng.normal(0, 0.05, 2)
            r = beta[i] * f + 0.3 * g + rng.normal(0, 0.02)
            rows.append((name, i * 21_600, None if rng.random() < 0.1 else float(r), None if rng.random() < 0.05 else float(f), float(g), "x"))
    df = spark.createDataFrame(rows, "asset string, sec long, log_return double, f double, g double, tag string").withColumn("ts", F.timestamp_seconds("sec"))
    options = {"lag": lag, "forget": forget, "min_obs": 10}
    whole, cut = (filters.kalman_betas(df, ["f", "g"], days=d, **options).toPandas().sort_values(["asset", "ts"]).reset_index(drop=True) for d in (None, 12))
    assert len(cut) == len(rows) and list(cut.columns) == [*df.columns, "beta_f", "beta_g", "alpha", "residual"]
    for c in ("beta_f", "beta_g", "alpha", "residual"):
        assert np.allclose(whole[c].astype(float), cut[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
    hot = whole[whole.asset == "hot"]
    m, p, seen, want = np.zeros(3), np.eye(3), 0, []
    for r in hot.itertuples():
        x = np.array([r.f, r.g, 1.0], dtype=float)
        if np.isfinite(x).all() and np.isfinite(float(r.log_return if r.log_return is not None else np.nan)):
            p = p / forget if forget else p + 1e-5 * np.eye(3)
            k = p @ x / (x @ p @ x + 1e-3)
            m, p, seen = m + k * (r.log_return - x @ m), p - np.outer(k, x @ p), seen + 1
        want.append(m.copy() if seen >= 10 else np.full(3, np.nan))
    want = np.vstack([np.full((lag, 3), np.nan), want[: len(want) - lag]])
    assert np.allclose(hot[["beta_f", "beta_g", "alpha"]].astype(float), want, rtol=1e-9, atol=1e-9, equal_nan=True)


# --- lineage, cells, folds, documents -----------------------------------------------------------


def test_lineage_of_great_depth_in_few_rounds(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from tidemark.operators import governance

    rounds = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a: (rounds.append(1), real(self, *a))[1])
    chain = spark.range(300).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("child_artifact_id"), F.concat(F.lit("a"), (F.col("id") + 1).cast("string")).alias("parent_artifact_id"))
    extra = spark.createDataFrame([("a0", "a100"), ("x", "y"), ("y", "x"), ("x", "x"), (None, "a1")], "child_artifact_id string, parent_artifact_id string")
    got = governance.ancestors(spark, chain.unionByName(extra))
    depth = {(r["artifact_id"], r["ancestor_id"]): r["depth"] for r in got.collect()}
    want = {(f"a{i}", f"a{j}"): (j - 99 if i == 0 and j >= 100 else j - i) for i in range(300) for j in range(i + 1, 301)} | {("x", "y"): 1, ("y", "x"): 1, ("x", "x"): 1, ("y", "y"): 2}
    assert got.count() == len(depth) and depth == want and len(rounds) <= 11


def test_cells_are_told_apart(spark):
    from decimal import Decimal

    from tidemark.operators import governance

    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e300, 5e-324, 2.0**-1022, 3.0, 2.0**52, 2.0**53 - 1, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    text = [r[0] for r in df.select(governance.encoded_cell(F.col("x"), df.schema["x"].dataType)).collect()]
    assert text[0] == text[1] == "d0e0" and len(set(text)) == len(values) - 1
    for v, t in zip(values, text, strict=True):
        if t[0] == "d" and "n" not in t and v:
            m, e = t[1:].split("e")
            assert int(m) * 2.0 ** int(e) == v or abs(v) < 1e-300
    row = spark.createDataFrame([("a|b", True, 7, Decimal("1.50"), bytearray(b"\x01"), [1, None], (2, "z"))], "s string, b boolean, i int, d decimal(9,2), x binary, l array<int>, r struct<k:int,a:string>")
    assert [row.select(governance.encoded_cell(F.col(f.name), f.dataType)).first()[0] for f in row.schema] == ["s3:a|b", "b1", "i7", "m1.50", "x01", "[i1,n]", "{s1:z,i2}"]
    one = lambda d: governance.dataset_id({"t": d}).first()[0]
    assert one(df) == one(df.repartition(5)) != one(df.unionByName(df)) and one(df) != one(df.where("x is not null"))


def test_rows_meet_every_fold_that_has_them(spark):
    from tidemark.operators import backtest

    rng = np.random.default_rng(3)
    rows = [(int(s), f"a{int(rng.integers(3))}") for s in np.sort(rng.integers(0, 200 * 86_400, 400))]
    panel = spark.createDataFrame(rows, "sec long, asset string").withColumn("ts", F.timestamp_seconds("sec"))
    spans = [(0, 0, 50, 55, 80), (1, 20, 90, 85, 120), (2, 100, 199, None, None), (3, 30, 20, 40, 41)]
    at = lambda c: F.timestamp_seconds(F.col(c) * 86_400)
    folds = spark.createDataFrame(spans, "fold_id int, a long, b long, c long, d long").select("fold_id", at("a").alias("train_start"), at("b").alias("train_end"), at("c").alias("test_start"), at("d").alias("test_end"))
    got = sorted((r["sec"], r["asset"], r["fold_id"], r["part"]) for r in backtest.by_fold(panel, folds).collect())
    want = []
    for s, a in rows:
        for k, p, q, u, v in spans:
            if p * 86_400 <= s <= q * 86_400:
                want.append((s, a, k, "train"))
            elif u is not None and u * 86_400 <= s <= v * 86_400:
                want.append((s, a, k, "test"))
    assert got == sorted(want)
    assert "NestedLoop" not in backtest.by_fold(panel, folds)._jdf.queryExecution().executedPlan().toString()


def test_documents_of_any_shape(spark, tmp_path):
    import json

    from tidemark.sources import documents

    (tmp_path / "m").mkdir()
    for i, text in enumerate([json.dumps({"run_id": "r1", "outputs": {"b": 1, "a": 2}, "spec": {"research_spec_version": "2"}}), json.dumps({"run_id": 7, "outputs": ["x"], "name": "n\nm"}, indent=2), "{broken", "", "[1]", '{"outputs": null}']):
        (tmp_path / "m" / f"{i}.json").write_text(text)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in documents.manifests(spark, f"{tmp_path}/m/*.json").collect()}
    assert (rows["0.json"]["run_id"], rows["0.json"]["outputs"], rows["0.json"]["spec_version"], rows["0.json"]["corrupt"]) == ("r1", "a, b", "2", None)
    assert (rows["1.json"]["run_id"], rows["1.json"]["outputs"], rows["1.json"]["name"]) == ("7", '["x"]', "n\nm")
    assert rows["2.json"]["corrupt"] == "{broken" and rows["2.json"]["outputs"] is None and rows["4.json"]["run_id"] is None and rows["4.json"]["corrupt"] is None and rows["5.json"]["outputs"] == ""
    assert documents.manifests(spark, f"{tmp_path}/none/*.json").count() == 0
    p = spark.createDataFrame([("a/b", "/base/"), ("./a", "/base"), ("/x", "/base"), ("s3a://k/v", "/base")], "p string, b string")
    assert [r[0] for r in p.select(documents.resolved(F.col("p"), F.col("b"))).collect()] == ["/base/a/b", "/base/a", "/x", "s3a://k/v"]


def test_a_stored_run_is_read_from_its_partition(spark, tmp_path):
    from tidemark.sources import runs

    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k int, v double")
    for name in ("one", "two"):
        assert runs.persist_run(df, str(tmp_path / "r"), name) and not runs.persist_run(df, str(tmp_path / "r"), name)
    back = runs.load_run(spark, str(tmp_path / "r"), "two")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert back.columns == ["k", "v"] and back.count() == 2 and back.where("v is null").count() == 1
    assert "PartitionFilters: [isnotnull(run_id" in plan and "run_id#" in plan


# --- streams ------------------------------------------------------------------------------------


def test_bars_by_arrival_over_several_batches(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming import ticks as streams

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [("a", at(0, 30), 1, 10.0, 1.0), ("a", at(0, 10), 2, 12.0, 1.0), ("b", at(0, 5), 3, 5.0, None), ("b", at(0, 6), 4, -1.0, 1.0)],
        [("a", at(0, 25), 5, 8.0, 1.0), ("a", at(1, 5), 6, 9.0, 2.0), ("a", at(0, 2), 99, 1.0, 1.0)],
        [("a", at(3, 0), 7, 7.0, 1.0)],
        [("a", at(0, 59), 8, 99.0, 1.0), ("a", at(3, 1), 9, 6.0, 1.0)],  # the first bar is closed by now; in the batch before, 00:02 was behind the watermark of 00:20
        [("z", at(9, 0), 10, 1.0, 1.0)],
    ]
    schema = "asset string, ts timestamp, event_id long, price double, size double"
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    streams.state_store(spark)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = streams.arrival_bars(streams.read_ticks(spark, str(tmp_path / "in")))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.set(store, before)
    got = {(r["asset"], r["ts"].hour): (r["open"], r["high"], r["low"], r["close"], r["volume"], r["n_ticks"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): (10.0, 12.0, 8.0, 8.0, 3.0, 3), ("b", 0): (5.0, 5.0, 5.0, 5.0, 0.0, 1), ("a", 1): (9.0, 9.0, 9.0, 9.0, 2.0, 1), ("a", 3): (7.0, 7.0, 6.0, 6.0, 2.0, 2)}


def test_a_cycle_is_whole_or_not_there(spark, tmp_path):
    from tidemark.streaming import ticks as streams

    root = str(tmp_path / "cycles")
    with pytest.raises(ValueError):
        streams.cycle_rows(spark, root, "spot")
    batch = spark.createDataFrame([("spot", "SOL", 1.0), ("spot", "BAD", -1.0), ("pair", "p", 2.0)], "kind string, asset string, price double")
    assert streams.run_cycle(batch, 0, root) and streams.run_cycle(batch, 0, root)
    assert not streams.run_cycle(batch.where("asset <> 'SOL'"), 1, root)
    batch.where("kind = 'spot'").write.parquet(f"{root}/spot/batch=2")  # crashed before the pairs
    count = lambda name: sorted((r["batch"], r["asset"]) for r in streams.cycle_rows(spark, root, name).collect())
    assert count("spot") == [(0, "SOL")] and count("pair") == [(0, "p")]
    assert streams.run_cycle(batch, 2, root) and count("spot") == [(0, "SOL"), (2, "SOL")] and count("pair") == [(0, "p"), (2, "p")]


def test_traded_is_lagged_returns_and_turnover(spark):
    from tidemark.operators import portfolio

    rng = np.random.default_rng(12)
    rows = [(int(t), f"a{i}", float(rng.normal())) for t in range(9) for i in range(6) if rng.random() < 0.6]
    w = spark.createDataFrame(rows, "ts int, asset string, weight double")
    r = spark.createDataFrame([(t, f"a{i}", float(rng.normal()) if rng.random() < 0.8 else None) for t in range(9) for i in range(6)], "ts int, asset string, log_return double")
    for bars in (1, 2):
        held = portfolio.lagged(w, bars)
        want = {x["ts"]: (x["pnl"], x["turnover"]) for x in portfolio.portfolio_returns(held, r).join(portfolio.turnover(held), "ts").collect()}
        got = {x["ts"]: (x["pnl"], x["turnover"]) for x in portfolio.traded(w, r, bars).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], atol=1e-12) for t in want)


def test_no_frame_is_passed_over_for_each_row(spark):
    """Minima from the last row down and values to come grow along the reverse order."""
    from tidemark.operators import bars, inference, signals

    p = spark.createDataFrame([(i, "g", (i * 7 % 50) / 50, i % 3 or None) for i in range(50)], "id int, g string, p double, z int")
    fills = p.withColumn("f", bars.fill_both_ways(F.col("z"), "g", "id"))
    assert [r["f"] for r in fills.orderBy("id").limit(4).collect()] == [1, 1, 2, 2]
    for df in (inference.adjusted(p), inference.adjusted(p, by=("g",)), fills, signals.sign_of(p, "z", "id")):
        assert not re.search(r"(currentrow\$\(\)|\d), unboundedfollowing", df._jdf.queryExecution().optimizedPlan().toString().lower())
    want = {}
    for r in sorted(range(1, 51), reverse=True):
        q = sorted((row["p"], row["id"]) for row in p.collect())[r - 1]
        want[q[1]] = min(1.0, q[0] * 50 / r, want.get("last", 1.0))
        want["last"] = want[q[1]]
    got = {r["id"]: r["p_adj"] for r in inference.adjusted(p, by=("g",)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(50))


def test_arrival_orders_a_batch_whose_ticks_come_in_any_order(spark, tmp_path):
    """More ticks of one bar than Python takes at once, from the last to arrive to the first, in a folder of files."""
    from tidemark.plans.study_queries import arrival_bars
    from tidemark.session import ready

    e = spark.range(3001).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, if(id = 3000, 5, 0), 0, id % 3000) as ts", "1L as user_id", "'a' as event_type", "double(1 + id) as value", "'{}' as props")
    e.orderBy(F.desc("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = arrival_bars(ready(spark), str(tmp_path)).collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["n_ticks"]) for r in got] == [(1.0, 3000.0, 1.0, 3000.0, 3000)]


def test_new_pairs_are_bounded_beside_churn(spark):
    from tidemark.operators import universe

    ranks = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "pair_address string, rank int")
    prev, new = ranks([f"p{i}" for i in range(20)]), ranks(["p3", *[f"n{i}" for i in range(20)]])
    got = lambda **limits: [tuple(r) for r in universe.churn_controlled(prev, new, 100, 0.25, **limits).collect()]
    assert len(got()) == 6 and got(most_new=2) == [("p3", 3, True), ("n0", 1, False), ("n1", 2, False)]


def test_a_series_that_does_not_move_has_volatility_zero(spark):
    from tidemark.operators import backtest

    e = spark.range(4).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) as ts", "2.0D as equity")
    row = backtest.performance(e, "1D").first()
    assert row["vol_annual"] == 0.0 and row["sharpe"] is None and row["max_drawdown"] == 0.0


def test_correlation_means_are_those_of_all_pairs(spark, monkeypatch):
    from tidemark.operators.returns import correlation_matrix

    monkeypatch.setattr(gram, "SIDE", 4)
    rng = np.random.default_rng(5)
    rows = [(f"a{i:02}", t, float(rng.normal())) for i in range(23) for t in range(12) if rng.random() < 0.7]
    p = spark.createDataFrame(rows, "asset string, t int, log_return double").selectExpr("asset", "timestamp'2024-01-01' + make_interval(0, 0, 0, t * 200) as ts", "log_return")
    want = correlation_matrix(p).groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n_times"), F.avg(F.when(F.col("n") >= 5, F.col("corr"))).alias("m"))
    want = {r["a"]: r for r in want.collect()}
    got = gram.correlation_means(p, tiles=3).collect()
    assert len(got) == len(want) == 23
    for r in got:
        w = want[r["a"]]
        assert (r["n_pairs"], r["n_times"]) == (w["n_pairs"], w["n_times"]) and (r["mean_corr"] is None) == (w["m"] is None) and abs((r["mean_corr"] or 0) - (w["m"] or 0)) < 1e-12
    # no pair leaves a task: one row for each asset and group
    assert "n_corr" in gram.correlation_means(p, tiles=3)._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_makes_few_files(spark, tmp_path, monkeypatch):
    from tidemark.plans import study_queries

    monkeypatch.setattr(study_queries, "workspace", lambda spark, name: str(tmp_path / name))
    (tmp_path / "sf").mkdir()
    spark.range(1, 61).selectExpr("id as s_suppkey", "double(id) as s_acctbal").write.parquet(str(tmp_path / "sf" / "supplier.parquet"))
    rows = study_queries.resolved_evidence(spark, str(tmp_path / "sf")).collect()
    assert len(rows) == 60 + 15 and sum(r["found"] for r in rows) == 32 + 15
    assert len(list((tmp_path / "evidence").rglob("part-*"))) <= 10  # not one for each supplier


def test_programs_of_many_assets_need_few_steps():
    rng = np.random.default_rng(8)
    s, v, e = rng.normal(size=(3, 1500)), rng.uniform(0.05, 3, size=(3, 1500)), rng.normal(1, 0.5, size=(3, 1500, 1))
    there = np.arange(1500)[None, :] < np.array([[1500], [900], [7]])
    for limits in ({"gross": 0.5}, {"gross": 2.0, "net": 0.1}, {"gross": 1.0, "net": 0.3, "long_only": True}):
        w, kkt = optimize.solve(*[np.where(there, a, 0.0) for a in (s, v)], np.where(there[:, :, None], e, 0.0), there, rounds=1, **limits)
        assert kkt.max() < 1e-9 and np.abs(w.sum(1) - limits.get("net", 0.0)).max() < 1e-9 and np.abs(w).sum(1).max() < limits["gross"] + 1e-9
