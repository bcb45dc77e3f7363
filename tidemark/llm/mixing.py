"""Mixing to target weights by soft membership.

Documents have no certain domain: a classifier learnt from the labels table gives each its
posteriors. Rates, the expected number of times each document is used, are then fitted so that the
expected token totals of the domains match target weights, by projected-gradient least squares over
all documents.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, held_out, table
from tidemark.llm.text_model import Vocabulary, labelled_sample, mine, posteriors, sample_hits, train

#: Domains of the labels table, in the order of the posteriors.
DOMAINS = ("low", "plain", "toxic")
#: Shares of all tokens that the mixture is to have.
TARGETS = {"low": 0.01, "plain": 0.96, "toxic": 0.03}


@dataclass
class DomainModel:
    vocabulary: Vocabulary
    weights: np.ndarray
    intercepts: np.ndarray
    present: list[bool]

    def column(self, text: Column) -> Column:
        """Tokens (white-space separated words) and posteriors of each whole text."""
        of = posteriors(self.vocabulary, self.weights, self.intercepts)

        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"tokens": [len((t or "").split()) for t in texts], "p": [of(t) for t in texts]})

        # called nondeterministic, so that a filter on what it gives is not pushed below it and computes it again
        return F.pandas_udf(run, "tokens long, p array<double>").asNondeterministic()(text)


def fit_domains(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500) -> DomainModel:
    """Learns from ``per_class`` documents of each domain at most, drawn from the labels of ``docs`` only.
    A domain that none of these have is absent and gets a posterior of 0; without any labels at all the
    domains are equally likely."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 1)
    scratch = Scratch(docs.sparkSession)
    own = scratch.put(labels.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", domain.alias("domain")), "own-labels")
    ids = labelled_sample(own, F.col("domain"), per_class, [0, 1, 2])
    texts = docs.select("doc_id", "text")  # other columns may have the names of the sample's
    sample = texts.join(F.broadcast(ids), texts["doc_id"] == ids["id"]).select("text", "y", "weight").persist()
    try:
        vocabulary = Vocabulary(mine(sample, [0, 1, 2], max_features=2000))
        rows = sample_hits(sample, vocabulary).select("hits", F.col("y").alias("label"), "weight").persist()
        seen = {r["label"] for r in rows.select("label").distinct().collect()}
        present = [not seen or i in seen for i in range(3)]
        if len(seen) < 2:
            w, b = np.zeros((3, max(1, len(vocabulary.features)))), np.zeros(3)
        else:
            w, b = train(rows, len(vocabulary.features), 3)
        absent = ~np.array(present)
        w[absent], b[absent] = 0.0, -np.inf
        rows.unpersist()
    finally:
        sample.unpersist()
    return DomainModel(vocabulary, w, b, present)


@dataclass
class Rates:
    """The steps of the descent; a document's rate is a function of its own row and of them."""

    steps: list[np.ndarray]
    total: float
    target: np.ndarray
    reached: np.ndarray
    converged: bool = True

    def column(self, p: Column) -> Column:
        """Starts from 1 and takes every step, each cut off at 0."""
        if not self.steps:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in self.steps])
        moved = lambda rate, s: sum((p[i] * s[i] for i in range(len(self.target))), F.lit(0.0)) * -1.0 + rate
        return F.aggregate(steps, F.lit(1.0), lambda rate, s: F.greatest(F.lit(0.0), moved(rate, s)))


#: Step lengths that a line search tries at once, and dampings of the directions that it tries them in.
LENGTHS = tuple(4.0**i for i in range(-3, 6))
DAMPINGS = (0.0, 1e-4, 1e-2)


def fit_rates(rows: DataFrame, targets: np.ndarray, *, rounds: int = 25, tolerance: float = 1e-4) -> Rates:
    """Least squares of the domain totals A r against the targets over rates r >= 0, from r = 1.

    ``rows`` has tokens and p. The residual is plain, in tokens, so that a target that no document can
    serve costs what it misses and draws no others after it. The distance of rates weighs a document by
    its tokens, so that rates depend on membership and not on length. Each round projects the steps of
    ``LENGTHS`` along the gradient, and along the gradient scaled by the damped Gram matrices of all
    documents and of those with a rate above 0, and takes the best. It ends when every total is within
    ``tolerance`` of all tokens, or when a plain gradient step changes no total by more than a hundredth
    of that and rates by no more than ``tolerance`` (root mean square over tokens); if neither holds
    after ``rounds``, it warns and ``converged`` is false. A round is two aggregations over all rows;
    only sums, none of which grows with the rows, reach the driver.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    t, pairs = F.col("tokens"), [(i, j) for i in range(k) for j in range(i, k)]

    def gram_of(weight: Column) -> list[Column]:
        return [F.sum(weight * p[i] * p[j]).alias(f"g{i}{j}") for i, j in pairs]

    def gram(row) -> np.ndarray:
        return np.array([[row[f"g{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)

    def directions(g: np.ndarray, miss: np.ndarray) -> list[np.ndarray]:
        return [np.linalg.pinv(g + np.eye(k) * np.trace(g) * max(d, 1e-9), rcond=1e-9) @ miss for d in DAMPINGS]

    def along(rate: Column, step) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((p[i] * step[i] for i in range(k)), F.lit(0.0)))

    first = rows.agg(F.sum("tokens").alias("n"), *gram_of(t), *[F.sum(t * p[i]).alias(f"a{i}") for i in range(k)]).first()
    total = float(first["n"] or 0)
    if not total:
        return Rates([], 0.0, targets, np.zeros(k))
    every = gram(first)
    want = targets / targets.sum() * total
    out = Rates([], total, want, np.array([first[f"a{i}"] for i in range(k)], dtype=float), False)
    for _ in range(rounds):
        miss = out.reached - want
        if np.abs(miss).max() <= tolerance * total:
            out.converged = True
            break
        rate, plain = F.col("rate"), miss / np.linalg.eigvalsh(every)[-1]
        at = rows.select("tokens", "p", out.column(F.col("p")).alias("rate"))
        change = along(rate, [F.lit(float(x)) for x in plain]) - rate
        now = at.agg(*gram_of(F.when(rate > 0, t)), F.sum(t * change * change).alias("c"), *[F.sum(t * p[i] * change).alias(f"c{i}") for i in range(k)]).first()
        if np.sqrt(now["c"] / total) <= tolerance and max(abs(now[f"c{i}"]) for i in range(k)) <= tolerance / 100 * total:
            out.converged = True
            break
        steps = [length * d for d in (plain, *directions(every, miss), *directions(gram(now), miss)) for length in LENGTHS]
        each = at.select("tokens", "p", "rate", F.posexplode(F.lit([[float(x) for x in s] for s in steps])).alias("n", "step"))
        tried = {r["n"]: r for r in each.groupBy("n").agg(*[F.sum(t * p[i] * along(rate, F.col("step"))).alias(f"a{i}") for i in range(k)]).collect()}
        reached = np.array([[tried[n][f"a{i}"] for i in range(k)] for n in range(len(steps))], dtype=float)
        best = int(np.argmin(((reached - want) ** 2).sum(axis=1)))
        out.steps.append(steps[best])
        out.reached = reached[best]
    if not out.converged:
        warnings.warn(f"mixing rates have not converged in {rounds} rounds: shares {out.reached / total} for {want / total}", stacklevel=2)
    return out


def rates_of(model: DomainModel, rows: DataFrame, targets: dict[str, float]) -> Rates:
    """Rates for the domains that are present, whose targets are scaled to a sum of 1."""
    want = np.array([targets[d] if there else 0.0 for d, there in zip(DOMAINS, model.present, strict=True)])
    return fit_rates(rows, want if want.sum() else np.array(model.present, dtype=float))


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of uses whose expectation over keys is the rate, the same on every run."""
    u = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + u).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, per_class: int = 1500) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>, rate, copies.

    Null and empty texts have no tokens, but a rate like any. Labels of held-out ids are not used. Rows
    with equal or null ids are fitted one by one, and drawn alike only if their texts are equal, too; an
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit_domains(docs, labels.where(~held_out("doc_id")), per_class=per_class)
    seen = docs.select("doc_id", F.xxhash64("text").alias("h"), model.column(F.col("text")).alias("m"))
    rows = scratch.put(seen.select("doc_id", "h", "m.tokens", "m.p"), "memberships")
    rates = rates_of(model, rows, targets)
    rate = rates.column(F.col("p"))
    out = rows.select("doc_id", "h", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate.alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("h"))).drop("h")


def remix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, per_class: int = 1500) -> DataFrame:
    """``docs`` with each row as often as its rate says; its columns stay.

    Memberships are computed a second time where the rows lie, so that no text is moved.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit_domains(docs, labels.where(~held_out("doc_id")), per_class=per_class)
    (m, n) = fresh(docs, "membership", "uses")
    seen = docs.withColumn(m, model.column(F.col("text")))
    rows = scratch.put(seen.select(F.col(m)["tokens"].alias("tokens"), F.col(m)["p"].alias("p")), "memberships")
    rates = rates_of(model, rows, targets)
    uses = copies(rates.column(F.col(m)["p"]), F.col("doc_id"), F.xxhash64("text"))
    return seen.withColumn(n, uses).drop(m).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for TARGETS; odd rows as ``mixture`` says."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
