"""Label models against plain loops, and operators on tables whose other columns clash."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, mixing, quality, toxicity


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def brute_quality(rows):
    """Expectation-maximisation over single rows of votes, as loops."""
    n, m = len(rows), len(rows[0])
    good = [{0: 0.98, 1: 0.3}.get(sum(v < 0 for v in r), 0.05) for r in rows]
    for _ in range(100):
        w1, w0 = sum(good), sum(1 - g for g in good)
        prior = min(max((w1 + 1) / (w1 + w0 + 2), 0.02), 0.98)
        odds = []
        for i in range(m):
            p1 = {v: 1 + sum(g for g, r in zip(good, rows, strict=True) if r[i] == v) for v in (-1, 0, 1)}
            p0 = {v: 1 + sum(1 - g for g, r in zip(good, rows, strict=True) if r[i] == v) for v in (-1, 0, 1)}
            odds.append({v: math.log(p1[v] / sum(p1.values())) - math.log(p0[v] / sum(p0.values())) if v else 0.0 for v in (-1, 0, 1)})
        new = [sigmoid(math.log(prior / (1 - prior)) + sum(odds[i][r[i]] for i in range(m))) for r in rows]
        moved = max(abs(a - b) for a, b in zip(new, good, strict=True))
        if moved < 1e-9:
            break
        good = new
    return new


def test_quality_model_equals_loops():
    rng = np.random.default_rng(5)
    rows = np.where(rng.random((400, 4)) < 0.85, 1, 0)
    rows[rng.random(400) < 0.2, :2] = -1
    rows[rng.random((400, 4)) < 0.02] = -1
    patterns, at, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post = quality.LabelModel().fit(patterns, counts.astype(float)).posterior(patterns)
    want = brute_quality([tuple(int(v) for v in r) for r in rows])
    assert np.allclose(post[at.ravel()], want, atol=1e-9) and 0.02 < np.mean(np.array(want) < 0.5) < 0.5


def brute_toxicity(votes, weight, prior):
    """The same for the voters of toxicity, whose correlations within the classes share evidence."""
    n, m = len(votes), len(votes[0])
    total = sum(weight)
    weight = [w / total * n for w in weight]
    yes = [sum(v > 0 for v in r) for r in votes]
    post = [0.95 if y >= 2 else 0.8 if y == 1 else 0.02 for y in yes]
    for round_ in range(60):
        odds = []
        for i in range(m):
            p1 = {v: 0.5 + sum(w * p for w, p, r in zip(weight, post, votes, strict=True) if r[i] == v) for v in (-1, 0, 1)}
            p0 = {v: 0.5 + sum(w * (1 - p) for w, p, r in zip(weight, post, votes, strict=True) if r[i] == v) for v in (-1, 0, 1)}
            of = lambda v: math.log(p1[v] / sum(p1.values())) - math.log(p0[v] / sum(p0.values()))  # noqa: B023, E731
            odds.append({-1: min(of(-1), 0.0), 0: 0.0, 1: max(of(1), 0.0)})
        if round_ % 5 == 0:
            cov, var = np.zeros((m, m)), [1e-9] * m
            for share in (post, [1 - p for p in post]):
                w = [a * b for a, b in zip(weight, share, strict=True)]
                mean = [sum(a * r[i] for a, r in zip(w, votes, strict=True)) / max(sum(w), 1e-9) for i in range(m)]
                for i, j in itertools.product(range(m), repeat=2):
                    c = sum(a * (r[i] - mean[i]) * (r[j] - mean[j]) for a, r in zip(w, votes, strict=True))
                    cov[i, j] += c
                    if i == j:
                        var[i] += c
            corr = [[1.0 if i == j else min(max(cov[i, j] / math.sqrt(var[i] * var[j]), 0.0), 1.0) for j in range(m)] for i in range(m)]
        new = []
        for r in votes:
            z = math.log(prior / (1 - prior))
            for i in range(m):
                shared = sum(corr[j][i] for j in range(m) if r[j] != 0)
                z += odds[i][r[i]] / max(shared, 1.0)
            new.append(sigmoid(z))
        moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
        if moved < 1e-6:
            break
        post = new
    return post


def test_toxicity_model_equals_loops():
    rng = np.random.default_rng(6)
    toxic = rng.random(120) < 0.3
    votes = np.where(rng.random((120, 5)) < np.where(toxic, 0.6, 0.05)[:, None], 1, 0)
    votes[:, 3] = votes[:, 2]  # a copy of a voter
    votes[~votes[:, :4].any(axis=1), 4] = -1
    weight = rng.random(120) + 0.5
    model = toxicity.GenerativeModel()
    assert np.allclose(model.fit(votes, weight, 0.3), brute_toxicity([tuple(map(int, r)) for r in votes], list(weight), 0.3), atol=1e-9)
    assert model.correlation[2, 3] == pytest.approx(1, abs=1e-6)


def test_neighbours_with_repeated_ids_mixed_dimensions_and_clashing_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 3 else 6)]) for i in range(90)]
    rows += [rows[0], rows[20], (None, [1.0] * 4), (200, [1.0, math.inf, 0.0, 0.0]), (201, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = d.select("*", *[F.lit(1).alias(c) for c in ("shard", "level", "x", "query_id", "rank", "score", "dim", "h", "block", "ids")])
    out = hnsw.nearest(clash, clash.where("vec_id % 20 = 0"), k=5, least_shards=2).toPandas()
    assert list(out.columns) == ["query_id", "rank", "vec_id", "score"]
    sound = [(i, v) for i, v in rows if i is not None and v and np.isfinite(v).all()]
    for q in (0, 20, 40, 60, 80):
        own = next(v for i, v in sound if i == q)
        others = list(sound)
        others.remove((q, own))
        best = sorted((-float(np.dot(own, v)), i) for i, v in others if len(v) == len(own))[:5]
        got = out[out.query_id == q].sort_values("rank")
        assert list(got.vec_id) == [i for _, i in best] and np.allclose(got.score, [-s for s, _ in best])
    assert set(out.query_id) == {0, 20, 40, 60, 80}


CLASH = "id y weight hits fixed score predicted held_out label domain h m s copies tokens p rate uses quality kept class_id fp shingle start length".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(300)]
    bad = ["zuschen", "zuschung", "idiot", "vermoxa"]
    rows = [(i, " ".join([*rng.choice(vocab, 70), *(rng.choice(bad, 3) if i % 4 == 0 else [])])) for i in range(120)] + [(None, None), (7, "one"), (7, "one"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASH])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").select("*", *[F.lit("x").alias(c) for c in ("id", "y", "weight", "text", "h", "domain")])
    return docs.cache(), labels.cache()


def test_scores_and_rates_beside_clashing_columns(clashing):
    docs, labels = clashing
    plain, few = docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic")
    key = ["doc_id", "score"]
    a, b = (toxicity.toxicity(d, x).toPandas().sort_values(key)[[*key, "predicted"]].reset_index(drop=True) for d, x in ((docs, labels), (plain, few)))
    assert len(a) == 124 and a.score.nunique() > 2 and np.allclose(a.score, b.score) and a.predicted.equals(b.predicted)
    x = mixing.mixture(docs, labels).toPandas()
    assert len(x) == 124 and x.rate.notna().all() and mixing.remix(docs, labels).columns == docs.columns


def test_stages_beside_clashing_columns(spark, clashing, monkeypatch):
    """Every stage of the pipeline keeps the columns, whatever they are called, and takes an empty table."""
    import corpus_pipeline

    docs, labels = clashing
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: labels)
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, "")
            assert out.columns == d.columns, name
            n = out.count()
            assert n == 0 if not d.head(1) else n > 0 or name == "quality rules", name
        pieces = corpus_pipeline.STAGES[-1][1](spark, d, "")
        assert {"doc_id", "sequence_id", "length"} <= set(pieces.columns) and (pieces.count() > 0) == bool(d.head(1))
