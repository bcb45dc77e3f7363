"""Golden values, identities and the future's lack of influence on the past."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity, registry, scalars
from tidemark.functions.scalars import normal_cdf
from tidemark.functions.windows import average_rank, clip, correlation
from tidemark.operators import backtest, bars, cross_section, factors, filters, governance, inference, portfolio, regimes, returns, signals, universe
from tidemark.plans import report, scan
from tidemark.sources import loaders, runs, sinks

T0 = datetime(2025, 1, 1)


def series(spark, rows, schema="asset string, ts timestamp, close double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    n = 120
    f = rng.normal(0, 0.01, n)
    rows = [("BTC", T0 + timedelta(hours=i), float(f[i])) for i in range(n)]
    for k, a in enumerate("ABCDE"):
        rows += [(a, T0 + timedelta(hours=i), float(0.5 * (k + 1) * f[i] + rng.normal(0, 0.002))) for i in range(n)]
    return spark.createDataFrame(rows, "asset string, ts timestamp, log_return double").cache()


def test_hourly_bar_of_three_ticks(spark):
    t = spark.createDataFrame([("X", T0 + timedelta(seconds=5), 1, 100.0, 1.0), ("X", T0 + timedelta(minutes=30, seconds=5), 2, 101.0, 2.0), ("X", T0 + timedelta(hours=1, seconds=5), 3, 99.0, 1.5)], "asset string, ts timestamp, event_id long, price double, size double")
    first = bars.ohlc(t, "1h", tie="event_id", size="size").orderBy("ts").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (100.0, 101.0, 100.0, 101.0, 3.0)


def test_non_positive_prices_make_no_bars(spark):
    t = spark.createDataFrame([("X", T0, 0.0), ("X", T0, -1.0), ("X", T0, None)], "asset string, ts timestamp, price double")
    assert bars.ohlc(t, "1h").count() == 0


def test_returns_identities(spark):
    p = series(spark, [("X", T0 + timedelta(hours=i), c) for i, c in enumerate([100.0, 110.0, 99.0, None, 120.0])])
    r = p.withColumn("r", returns.log_return(F.col("close"))).withColumn("cum", returns.cumulative_return(F.col("r"))).orderBy("ts").collect()
    assert r[0]["r"] is None and r[3]["r"] is None and r[4]["r"] is None
    assert r[2]["cum"] == pytest.approx(99 / 100 - 1)
    assert r[3]["cum"] is None


def test_average_rank_and_clip_keep_nulls(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, None)], "g int, x double")
    got = sorted((r["x"], r["r"]) for r in d.select("x", average_rank(F.col("x"), "g").alias("r")).collect() if r["x"] is not None)
    assert got == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5)]
    assert d.select(clip(F.col("x"), 0, 2).alias("c")).where("c is null").count() == 1


def test_constant_side_has_no_correlation(spark):
    d = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert d.agg(correlation(F.col("x"), F.col("y")).alias("c")).first()["c"] is None


def test_perfect_signal_has_coefficient_one(spark, panel):
    fwd = returns.forward_return(panel, 1)
    ic = cross_section.information_coefficient(fwd.withColumnRenamed("fwd", "value"), returns.forward_return(panel, 1)).where("ic is not null")
    assert ic.agg(F.min("ic")).first()[0] == pytest.approx(1.0)


def test_causal_fit_against_least_squares_and_future(spark, panel):
    m = factors.factor_columns(panel, {"btc": "BTC"}).where("asset = 'C'")
    fit = factors.causal_ols(m, ["btc"], 40, 20).orderBy("ts").toPandas()
    p = m.orderBy("ts").toPandas()
    i = 90
    x = np.column_stack([p["btc"][i - 40 : i], np.ones(40)])
    beta, alpha = np.linalg.lstsq(x, p["log_return"][i - 40 : i], rcond=None)[0]
    assert fit["beta_btc"][i] == pytest.approx(beta) and fit["alpha"][i] == pytest.approx(alpha)
    assert fit["residual"][i] == pytest.approx(p["log_return"][i] - alpha - beta * p["btc"][i])
    assert fit["beta_btc"][:20].isna().all()
    cut = T0 + timedelta(hours=80)
    shocked = m.withColumn("log_return", F.when(F.col("ts") > F.lit(cut), F.lit(9.9)).otherwise(F.col("log_return")))
    again = factors.causal_ols(shocked, ["btc"], 40, 20).orderBy("ts").toPandas()
    np.testing.assert_allclose(fit["beta_btc"][20:81], again["beta_btc"][20:81], atol=1e-12)
    with pytest.raises(ValueError):
        factors.causal_ols(m, ["btc"], lag=0)


def test_kalman_beta_converges(spark, panel):
    m = factors.factor_columns(panel, {"btc": "BTC"}).where("asset = 'D'")
    last = filters.kalman_betas(m, ["btc"], q=1e-7, r=1e-5).orderBy(F.desc("ts")).first()
    assert last["beta_btc"] == pytest.approx(2.0, abs=0.2)


def test_long_short_sums(spark, panel):
    w = portfolio.long_short(cross_section.ranked(panel, "log_return"), 2, 2)
    row = w.groupBy("ts").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).first()
    assert row["net"] == pytest.approx(0) and row["gross"] == pytest.approx(1)


def test_orthogonal_signals_have_no_common_part(spark):
    rng = np.random.default_rng(5)
    rows = [(T0 + timedelta(hours=t), f"a{i}", *map(float, (x := rng.normal(size=3)) + [0, x[0], x[1]])) for t in range(4) for i in range(12)]
    d = spark.createDataFrame(rows, "ts timestamp, asset string, s double, t double, u double")
    out = cross_section.orthogonalized(d, ["s", "t", "u"])
    for t in range(4):
        p = out.where(F.col("ts") == F.lit(T0 + timedelta(hours=t))).toPandas()
        assert len(p) == 12
        assert abs(np.corrcoef(p["s_orth"], p["t_orth"])[0, 1]) < 1e-9 and abs(np.corrcoef(p["t_orth"], p["u_orth"])[0, 1]) < 1e-9
    assert {r["a"] for r in cross_section.cross_correlations(out, ["s_orth", "t_orth"]).collect()} == {"s_orth"}


def test_costs_lower_returns(spark):
    s = spark.createDataFrame([(T0, 0.01, 1.0), (T0 + timedelta(hours=1), -0.005, 0.5)], "ts timestamp, pnl double, turnover double")
    rows = portfolio.net_of_costs(s, 30, 10).orderBy("ts").collect()
    assert rows[0]["net"] == pytest.approx(0.01 - 0.004)
    curve = portfolio.capacity_curve(s)
    assert not portfolio.rises_with_size(curve).first()[0]


def test_benjamini_hochberg_golden(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.05])], "id int, p double")
    for compat in (False, True):
        assert [r["p_adj"] for r in inference.adjusted(d, compat=compat).collect()] == pytest.approx([0.05] * 5)


def test_hac_has_the_textbook_scale(spark):
    x = np.random.default_rng(0).normal(0.5, 1, 400)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "ts int, value double")
    plain = x.mean() * math.sqrt(400) / x.std()
    assert inference.hac_mean(d, lags=0).first()["t_hac"] == pytest.approx(plain)
    assert inference.hac_mean(d.limit(10)).first()["t_hac"] is None


def test_breaks_find_a_shift(spark):
    x = np.concatenate([np.zeros(80), np.ones(80)]) + np.random.default_rng(1).normal(0, 0.3, 160)
    d = spark.createDataFrame([("s", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(x)], "series string, ts timestamp, value double")
    b = {r["test"]: r for r in inference.break_diagnostics(d).collect()}
    assert b["cusum"]["break_suspected"] and b["sup_chow"]["break_suspected"]
    assert abs(inference.sup_chow(d, "series").first()["break_index"] - 80) <= 2


def test_dominant_strategy_is_not_overfit(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, (80, 4))
    r[:, 0] += 0.02
    d = spark.createDataFrame([(f"s{j}", i, float(r[i, j])) for i in range(80) for j in range(4)], "strategy string, ts int, value double")
    assert inference.pbo(d, 8).first()["pbo"] == 0.0
    assert inference.pbo(d, 8, compat=True).first()["pbo"] == 1.0


def test_resampling_repeats_and_reality_check_finds_an_edge(spark):
    a, b = (inference.resample_table(spark, 30, 3, 5).orderBy("sim", "at").toPandas() for _ in range(2))
    assert a.equals(b) and a["pos"].between(0, 29).all()
    rng = np.random.default_rng(4)
    rows = [(h, i, float(rng.normal(0.8 if h == "good" else 0.0, 1))) for h in ("good", "bad") for i in range(120)]
    s = spark.createDataFrame(rows, "hypothesis string, ts int, value double")
    obs = s.groupBy("hypothesis").agg(F.avg("value").alias("stat"))
    nulls = inference.null_statistics(s, 100, 1, recenter=True)
    assert inference.reality_check(obs, nulls).first()["p_value"] < 0.05
    p = {r["hypothesis"]: r["p_adj"] for r in inference.romano_wolf(obs, nulls).collect()}
    assert p["good"] < 0.05 <= p["bad"]


def test_null_signals_keep_values(spark, panel):
    s = panel.select("ts", "asset", F.col("log_return").alias("value"))
    for kind in ("permute", "blocks"):
        got = inference.null_signals(s, kind, 3)
        assert got.count() == s.count()
        assert got.agg(F.sum("value")).first()[0] == pytest.approx(s.agg(F.sum("value")).first()[0])


def test_null_suite_by_hand_in_one_pass(spark):
    import hashlib

    rng = np.random.default_rng(8)
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(days=d), f"a{i}", None if rng.random() < 0.1 else float(rng.integers(0, 5)), None if rng.random() < 0.2 else float(rng.normal())) for d in range(25) for i in range(7) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows, "ts timestamp, asset string, value double, fwd double")
    signal, forward = frame.select("ts", "asset", "value"), frame.where("fwd is not null and asset <> 'a6'").select("ts", "asset", "fwd")
    n_sim = 12
    out = inference.null_suite(signal, forward, n_sim, 3, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 25
    got = {r["kind"]: (r["observed_ic"], r["p_value"], r["n_sim"]) for r in out.collect()}

    s = {(t, a): v for t, a, v, _ in rows if v is not None}
    f = {(t, a): x for t, a, _, x in rows if x is not None and a != "a6"}
    times, byday = sorted({t for t, _, _, _ in rows}), {}
    for t, a in s:
        byday.setdefault(t, []).append(a)

    def mean_ic(sig):
        ics = []
        for t in times:
            names = [a for (u, a) in sig if u == t and (t, a) in f]
            x, y = (pd.Series([d[t, a] for a in names], dtype=float).rank() for d in (sig, f))
            if len(names) > 1 and x.std() > 1e-15 and y.std() > 1e-15:
                ics.append(x.corr(y))
        return np.mean(ics)

    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    observed, sims = mean_ic(s), {"ranks": [], "permute": [], "blocks": []}
    for sim in range(n_sim):
        ranks, permuted = {}, {}
        for t, names in byday.items():
            order = sorted(names, key=lambda a: (md5(f"3|{{{t:%Y-%m-%d %H:%M:%S}, {sim}}}|{a}"), a))
            ranks |= {(t, a): (b + 1) / len(order) for b, a in enumerate(order)}
            permuted |= {(t, a): s[t, other] for a, other in zip(sorted(names), order, strict=True)}
        new = sorted(range(len(times)), key=lambda i: (md5(f"{3 + sim}|{i // 4}"), i // 4, i))
        to = {times[i]: times[j] for j, i in enumerate(new)}
        for kind, sig in (("ranks", ranks), ("permute", permuted), ("blocks", {(to[t], a): v for (t, a), v in s.items()})):
            sims[kind].append(mean_ic(sig))
    for kind, m in sims.items():
        assert got[kind] == pytest.approx((observed, np.mean(np.array(m) >= observed - 1e-12), n_sim)), kind
    assert len({round(p, 3) for _, p, _ in got.values()} - {0.0, 1.0}) >= 2  # shares that say something


def test_normal_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.96,), (-1.96,)], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5, 0.9750021, 0.0249979], abs=1e-6)


def test_folds_leave_gaps(spark, panel):
    f = backtest.walk_forward_folds(panel, 60, 10, 10, purge=2, embargo=3).collect()
    assert f and all((r["test_start"] - r["train_end"]) == timedelta(hours=6) for r in f)
    rows = backtest.by_fold(panel, backtest.walk_forward_folds(panel, 60, 10, 10, purge=2, embargo=3))
    assert backtest.causality_violations(rows).count() == 0
    ten = panel.select("ts").distinct().orderBy("ts").limit(10)
    at = {r["ts"]: i for i, r in enumerate(ten.collect())}
    found = [tuple(at[r[c]] for c in ("train_start", "train_end", "test_start", "test_end")) for r in backtest.purged_folds(ten, 5, 2, 1).orderBy("fold_id").collect()]
    assert found == [(0, 4, 6, 7), (0, 5, 7, 8), (0, 6, 8, 9)] and backtest.purged_folds(ten, 9, 2).count() == 0


def test_regime_carries_over_gaps(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([None, 0.1, None, 0.9, None])], "ts int, realized_vol double")
    m = spark.createDataFrame([(0.3, 0.6)], "low double, high double")
    assert [r["regime"] for r in regimes.predict(d, m).orderBy("ts").collect()] == ["med_vol", "low_vol", "low_vol", "high_vol", "high_vol"]


def test_universe_rules_and_churn(spark):
    d = spark.createDataFrame([("A", "USDC", 10.0, 10.0), ("USDC", "USDT", 10.0, 10.0), ("A", "A", 10.0, 10.0), (None, "B", 10.0, 10.0), ("A", "B", None, 1.0), ("A", "B", 1.0, 10.0)], "b string, q string, l double, v double")
    got = [r[0] for r in d.select(universe.keep_reason(F.col("b"), F.col("q"), F.col("l"), F.col("v"), 5, 5)).collect()]
    assert got == ["accept", "stable/stable pair", "base==quote", "missing base or quote symbol", "missing liquidity", "liquidity below minimum"]
    prev = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "pair_address string, rank int")
    new = spark.createDataFrame([("a", 1), ("x", 2), ("y", 3), ("z", 4)], "pair_address string, rank int")
    assert sorted(r[0] for r in universe.churn_controlled(prev, new, 10, 0.5).collect()) == ["a", "x", "y"]


def test_promotion_needs_a_report(spark):
    c = spark.createDataFrame([("c1", "r1", "candidate"), ("c2", "r2", "candidate")], "candidate_id string, run_id string, status string")
    r = spark.createDataFrame([("e1", "c1", "accepted", True), ("e2", "c2", "accepted", False)], "eligibility_report_id string, candidate_id string, level string, passed boolean")
    new, events = governance.promote(c, r, "accepted")
    assert {x["candidate_id"]: x["status"] for x in new.collect()} == {"c1": "accepted", "c2": "candidate"}
    assert events.count() == 1
    assert governance.unsupported(new.where("status = 'accepted'"), r).count() == 0
    lin = spark.createDataFrame([], governance.LINEAGE)
    assert [x["lacks"] for x in governance.unauditable(new, r, events, lin).collect()] == [["lineage"]]


def test_dataset_id_ignores_order_and_sees_change(spark):
    a = spark.range(50).withColumn("x", F.col("id") * 2.5)
    one = governance.dataset_id({"t": a}).first()[0]
    assert one == governance.dataset_id({"t": a.orderBy(F.desc("id")).repartition(3)}).first()[0]
    assert one != governance.dataset_id({"t": a.union(a.limit(1))}).first()[0]


def test_identity_and_seeds():
    assert identity.run_key({"a": 1, "created_at": "x"}) == identity.run_key({"a": 1, "created_at": "y"})
    assert identity.family_id({"s": [2, 1]}) == identity.family_id({"s": [1, 2]}) != identity.family_id({"s": [1]})
    assert identity.seed_root("k", "s") != identity.seed_root("k", "s", "f1")
    assert identity.rng_for("k", "s").random() == identity.rng_for("k", "s").random()
    assert identity.to_json({"b": float("nan"), "a": 0.12345678901234}) == '{"a":0.123456789,"b":null}'
    assert "no folds" in identity.attestation_blockers({"context": {}})


def test_frequencies_and_config(monkeypatch):
    assert scalars.normalize_freq("60min") == "1h" and scalars.bars_per_day("15min") == 96 and scalars.periods_per_year("1h") == 8760
    monkeypatch.setenv("TIDEMARK_FILTERS__MIN_BARS", "7")
    assert registry.config()["filters"]["min_bars"] == 7 and registry.config()["filters"]["min_liquidity_usd"] == 250_000.0
    r = registry.Registry()
    r.register("a", dict)
    with pytest.raises(ValueError):
        r.register("a", dict)


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, first int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "id int, v string, first int")
    assert sorted(map(tuple, sinks.merged(old, new, "id", keep=("first",)).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 9)]


def test_a_run_is_written_once(spark, tmp_path, panel):
    from tidemark.sources import runs

    root, key = str(tmp_path / "runs"), identity.factor_run_id({"w": 40})
    fit = factors.causal_ols(factors.factor_columns(panel, {"btc": "BTC"}), ["btc"], 40, 20)
    betas = runs.long_betas(fit, ["btc"])
    assert runs.persist_run(betas, root, key) and not runs.persist_run(betas, root, key)
    assert runs.persist_run(betas, root, key, force=True)
    assert runs.load_run(spark, root, key).count() == betas.count()
    assert runs.fit_quality(runs.load_run(spark, root, key)).agg(F.max("n_factors")).first()[0] == 1


def test_payloads_and_fallback(spark):
    p = spark.createDataFrame([('{"success":true,"data":{"items":[{"unixTime":0,"o":2.0,"l":1.0,"v":5.0},{"unixTime":60,"c":3.0}]}}',), ("broken",)], "payload string")
    assert [r["price"] for r in loaders.candle_points(p).orderBy("ts").collect()] == [1.5, 3.0]
    q = spark.createDataFrame([("X", T0, "b", 2.0), ("X", T0, "a", 1.0), ("X", T0 + timedelta(seconds=60), "a", None), ("X", T0 + timedelta(seconds=999), "a", None)], "asset string, ts timestamp, provider string, price double")
    rows = loaders.fallback(q, ["a", "b"]).orderBy("ts").collect()
    assert [(r["price"], r["stale"]) for r in rows] == [(1.0, False), (1.0, True), (None, True)]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import ticks as st

    rows = [("X", T0 + timedelta(minutes=7 * i), i, 100.0 + (i * 37) % 11, 1.0) for i in range(60)]
    schema = "asset string, ts timestamp, event_id long, price double, size double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = st.write_bars(st.streaming_bars(st.read_ticks(spark, str(tmp_path / "in"))), out, ck)
    q.awaitTermination(60)
    batch = {r["ts"]: r["close"] for r in st.streaming_bars(spark.createDataFrame(rows, schema)).collect()}
    got = {r["ts"]: r["close"] for r in spark.read.parquet(out).collect()}
    assert got and all(batch[t] == c for t, c in got.items())
    assert len(got) >= len(batch) - 1  # the last interval is still open


def test_report_and_scan(spark, panel):
    s = signals.momentum_24h(panel, "1h")
    r = report.signal_report(s, panel, "1h", horizons=(1, 6))
    assert r.performance.first()["n_bars"] > 50
    assert report.validation_bundle({"m": r}).first()["p_adj"] is not None
    with pytest.raises(ValueError):
        scan.run(panel, "nonsense", "1h", 3)


def test_empty_panels(spark):
    e = spark.createDataFrame([], "asset string, ts timestamp, log_return double, close double")
    assert returns.forward_return(e, 3).count() == 0
    assert cross_section.information_coefficient(e.withColumn("value", F.lit(1.0)), e.withColumn("fwd", F.lit(1.0))).count() == 0
    assert backtest.walk_forward_folds(e, 5, 2, 1).count() == 0
    assert pd.isna(inference.cusum(e.withColumn("value", F.col("close")), "asset").toPandas().get("stat", pd.Series(dtype=float))).all()


def test_lineage_of_any_depth_and_many_ways(spark):
    chain = [(i + 1, i) for i in range(60)]
    lattice = [(1000 + 10 * (d + 1) + a, 1000 + 10 * d + b) for d in range(25) for a in range(2) for b in range(2)]  # 2^25 ways
    loop = [(5001, 5000), (5000, 5001)]
    out = governance.ancestors(spark, spark.createDataFrame(chain + lattice + loop, "child_artifact_id long, parent_artifact_id long")).toPandas()
    assert out[out.artifact_id == 60].depth.max() == 60 and len(out[out.artifact_id == 60]) == 60
    top = out[out.artifact_id == 1250]
    assert len(top) == 50 and (top.depth == 25 - (top.ancestor_id - 1000) // 10).all()
    assert sorted(map(tuple, out[out.artifact_id >= 5000].to_numpy().tolist())) == [(5000, 5000, 2), (5000, 5001, 1), (5001, 5000, 1), (5001, 5001, 2)]
    assert not out.duplicated(["artifact_id", "ancestor_id"]).any()


def test_lineage_of_forests_by_stretches(spark, monkeypatch):
    def brute(edges):
        up, want = {}, {}
        for c, p in edges:
            up.setdefault(c, set()).add(p)
        for v in up:
            level, d = {v}, 0
            while level:
                level, d = {p for u in level for p in up.get(u, ()) if (v, p) not in want}, d + 1
                want |= {(v, p): d for p in level}
        return want

    rng = np.random.default_rng(4)
    forest = [(i, int(max(0, i - rng.integers(1, 4)))) for i in range(1, 70)] + [(i, int(rng.integers(60, 65))) for i in range(70, 80)]
    hanging = [(int(rng.integers(1, 80)), 1000 + int(rng.integers(0, 12))) for _ in range(90)] + [(i, 2000) for i in range(1, 80, 2)]
    cycle = [(5001, 5000), (5000, 5001), (5002, 5001)]
    schema = "child_artifact_id long, parent_artifact_id long"
    for edges, by_stretches in ((forest + hanging, True), (forest + cycle, False)):
        found = []
        real = governance._forest
        monkeypatch.setattr(governance, "_forest", lambda *a, real=real: (found.append(real(*a)), found[-1])[1])
        got = governance.ancestors(spark, spark.createDataFrame(edges, schema), stretch=4).collect()
        monkeypatch.setattr(governance, "_forest", real)
        assert (found[-1] is not None) == by_stretches
        assert len(got) == len({r[:2] for r in got}) and {(r[0], r[1]): r[2] for r in got} == brute(edges)


def test_lineage_of_forests_by_lists(spark, tmp_path):
    chain = spark.range(3000).selectExpr("'s' || id as child_artifact_id", "'s' || (id - if(id % 7 > 0, id % 7, 0) - 1) as parent_artifact_id").unionByName(spark.range(3000).selectExpr("'s' || id", "'t' || (id div 3)").toDF("child_artifact_id", "parent_artifact_id"))
    governance.ancestors(spark, chain, stretch=16).write.parquet(str(tmp_path / "pairs"))
    pairs, size = spark.read.parquet(str(tmp_path / "pairs")), sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    n = pairs.count()
    assert n == pairs.select("artifact_id", "ancestor_id").distinct().count() > 1_200_000 and size < n  # under a byte a pair

    # one node has most of the leaves, another most of the parents without parents: their lists are cut, and what hangs twice is left out once
    rng = np.random.default_rng(5)
    edges = [(i, i - 1) for i in range(1, 14)] + [(i, int(rng.integers(10, 14))) for i in range(100, 160)] + [(3, 1000 + i) for i in range(40)] + [(9, 1000 + i) for i in range(0, 40, 3)] + [(i, 1000 + i % 40) for i in range(100, 160, 2)]
    up, want = {}, {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    for v in up:
        level, d = {v}, 0
        while level:
            level, d = {p for u in level for p in up.get(u, ()) if (v, p) not in want}, d + 1
            want |= {(v, p): d for p in level}
    for tile in (1, 7, 2048):
        got = governance.ancestors(spark, spark.createDataFrame(edges, "child_artifact_id long, parent_artifact_id long"), stretch=3, tile=tile).collect()
        assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want


def test_weights_need_no_grid(spark):
    from tidemark.operators import portfolio

    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.5), (2, "a", 0.5), (3, "c", 1.0), (5, "a", None)], "ts int, asset string, weight double")
    assert {(r["ts"], r["turnover"]) for r in portfolio.turnover(w).collect()} == {(1, 0.0), (2, 0.5), (3, 1.5), (5, 1.0)}
    assert {tuple(r) for r in portfolio.lagged(w).select("ts", "asset", "weight").collect()} == {(1, "a", 0.0), (1, "b", 0.0), (2, "a", 0.5), (2, "b", -0.5), (3, "a", 0.5), (5, "c", 1.0)}
    assert {tuple(r) for r in portfolio.held(w, 2).select("ts", "asset", "weight").collect()} == {(1, "a", 0.5), (1, "b", -0.5), (2, "a", 0.5), (2, "b", -0.5), (3, "c", 1.0), (5, "c", 1.0)}
    assert portfolio.turnover(w.limit(0)).count() == 0


def test_identities_of_rows_are_those_of_payloads(spark):
    rows = [(1, "a", True), (2, 'q"é', False), (3, None, None)]
    df = spark.createDataFrame(rows, "n int, name string, flag boolean")
    got = df.select("n", "name", "flag", identity.digest_of("n", "name", "flag").alias("id")).withColumn("seed", identity.seed_of("id", "s")).collect()
    for r in got:
        assert r["id"] == identity.run_id({"n": r["n"], "name": r["name"], "flag": r["flag"]})
        assert r["seed"] == identity.seed_root(r["id"], "s")


def test_fixed_blocks_do_not_wrap(spark):
    t = inference.resample_table(spark, 23, 4, 5, "fixed", 7).toPandas().sort_values(["sim", "at"])
    assert len(t) == 92 and t.pos.between(0, 22).all()
    for _, g in t.groupby("sim"):
        inside = g["at"].to_numpy()[1:] % 7 > 0
        assert (np.diff(g["pos"])[inside] == 1).all()


def test_a_run_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sorted(r["id"] for r in runs.cached(spark, str(tmp_path / "runs"), "rc_1", make).collect()) == [0, 1, 2]
    assert made == [1]


def test_grids_are_bounded(spark):
    with pytest.raises(ValueError):
        scan.parameter_grid(spark.range(1), {"a": list(range(6))})
