"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are mined lexicon entries (words and word beginnings, one voter each), a fixed lexicon of
English insults, and patterns. None is trusted by itself: a generative model estimates from the
votes alone how often each voter is right and which voters repeat each other, and gives each text
of the sample a posterior. A linear classifier over all mined features learns those posteriors and
scores every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, table
from tidemark.llm.text_model import Vocabulary, labelled_sample, mine, plain_words, sample_hits, train

#: Common English insults.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash disgusting clown imbecile filth vermin jerk bastard".split())
_PAIR = re.compile(r"\b(?:you|u|they|he|she)(?:'re| are| is|r)? (?:all |just |so |such )?(?:an? )?(?:" + "|".join(sorted(INSULTS)) + r")\b", re.IGNORECASE)
N_PATTERNS = 4


def pattern_votes(text: str | None) -> list[int]:
    """Votes of the fixed voters: 1 toxic, 0 abstain, -1 clean."""
    text = text or ""
    words = plain_words(text.lower().split())
    n = len(INSULTS & words)
    return [
        1 if n else -1,  # the fixed lexicon
        1 if n > 1 else 0,  # two of its words
        1 if _PAIR.search(text) else 0,  # an insult aimed at someone
        1 if "!!" in text and text.isupper() else 0,  # shouting
    ]


class GenerativeModel:
    """Votes in {-1, 0, 1} given a hidden class: accuracies by EM, and correlations.

    Voters that agree more than their class explains share evidence: the log odds of a vote are
    divided by the correlations, summed, with all votes cast on the same text, so that copies of one
    voter count once, and a voter that speaks alone counts in full. An abstention says nothing.
    """

    def __init__(self, rounds: int = 60, smoothing: float = 0.5):
        self.rounds, self.smoothing = rounds, smoothing

    def fit(self, votes: np.ndarray, weight: np.ndarray, prior: float) -> np.ndarray:
        """The posterior of class 1 for each row."""
        n, m = votes.shape
        if not n:
            return np.zeros(0)
        self.prior, self.correlation = prior, np.eye(m)
        weight = weight / weight.sum() * n
        hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        yes = (votes > 0).sum(1)
        post = np.where(yes >= 2, 0.95, np.where(yes == 1, 0.8, 0.02))
        for round_ in range(self.rounds):
            p1 = np.tensordot(weight * post, hot, (0, 0)) + self.smoothing
            p0 = np.tensordot(weight * (1 - post), hot, (0, 0)) + self.smoothing
            self.odds = np.log(p1 / p1.sum(1, keepdims=True)) - np.log(p0 / p0.sum(1, keepdims=True))
            self.odds[:, 2] = np.maximum(self.odds[:, 2], 0)  # a vote may be worthless, but not mean its contrary
            self.odds[:, 0] = np.minimum(self.odds[:, 0], 0)
            self.odds[:, 1] = 0
            if round_ % 5 == 0:
                self.correlation = self._correlations(votes, weight, post)
            new = self.posterior(votes)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return post

    def _correlations(self, votes: np.ndarray, weight: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Correlations of the votes within the classes, negative ones as none."""
        v, m = votes.astype(float), votes.shape[1]
        cov, var = np.zeros((m, m)), np.full(m, 1e-9)
        for w in (weight * post, weight * (1 - post)):
            d = v - (w @ v) / max(w.sum(), 1e-9)
            c = (d * w[:, None]).T @ d
            cov += c
            var += np.diag(c)
        corr = np.clip(cov / np.sqrt(np.outer(var, var)), 0, 1)
        np.fill_diagonal(corr, 1.0)
        return corr

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        cast = (votes != 0).astype(float)
        shared = np.maximum(cast @ self.correlation, 1.0)
        odds = np.where(votes > 0, self.odds[:, 2], np.where(votes < 0, self.odds[:, 0], 0.0))
        z = np.log(self.prior / (1 - self.prior)) + (odds / shared).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class ToxicityModel:
    """``features`` and their weights; a text's score is the logistic of the sum of those it has."""

    def __init__(self, features: list[str], weights: np.ndarray, intercept: float):
        self.vocabulary, self.weights, self.intercept = Vocabulary(features), weights, intercept

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.vocabulary.hits(text)].sum())
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000) -> ToxicityModel:
    """Learns from ``per_class`` labelled documents of each class at most (those of the least id hash).

    Without labelled documents of both classes the model scores by the fixed lexicon alone.
    """
    ids = labelled_sample(labels, F.col("toxic").cast("int"), per_class, [0, 1])
    texts = docs.select("doc_id", "text")  # other columns may have the names of the sample's
    sample = texts.join(F.broadcast(ids), texts["doc_id"] == ids["id"]).select("text", "y", "weight").persist()
    try:
        mined = mine(sample, [0, 1])
        features = list(dict.fromkeys(mined + ["w:" + w for w in sorted(INSULTS)]))
        vocabulary = Vocabulary(features)
        patterns = F.pandas_udf(lambda s: pd.Series([pattern_votes(t) for t in s]), "array<int>")
        rows = sample_hits(sample.withColumn("fixed", patterns(F.col("text"))), vocabulary).toPandas()
    finally:
        sample.unpersist()
    seeded = ToxicityModel(features, np.array([6.0 if f[2:] in INSULTS else 0.0 for f in features]), -4.0)
    if len(rows) == 0 or rows["y"].nunique() < 2:
        return seeded
    has = np.zeros((len(rows), len(features)), dtype=bool)
    for i, h in enumerate(rows["hits"]):
        has[i, list(h)] = True
    y, weight = rows["y"].to_numpy(), rows["weight"].to_numpy()
    toxic_like = (has & (y == 1)[:, None]).mean(0) / max(1e-9, (y == 1).mean()) > (has & (y == 0)[:, None]).mean(0) / max(1e-9, (y == 0).mean())
    lexicon = np.flatnonzero(toxic_like)
    none = ~has[:, lexicon].any(1)
    votes = np.hstack([has[:, lexicon].astype(int), np.where(none, -1, 0)[:, None], np.array(rows["fixed"].tolist())])
    prior = float((weight * (y == 1)).sum() / weight.sum())
    post = GenerativeModel().fit(votes, weight, min(max(prior, 0.01), 0.5))
    soft = pd.concat([pd.DataFrame({"hits": rows["hits"], "label": 1.0, "weight": weight * post}), pd.DataFrame({"hits": rows["hits"], "label": 0.0, "weight": weight * (1 - post)})])
    soft = soft[soft["weight"] > 1e-6]
    soft["hits"] = [list(map(int, h)) for h in soft["hits"]]
    w, b = train(docs.sparkSession.createDataFrame(soft, "hits array<int>, label double, weight double"), len(features), 2, reg=1e-5)
    return ToxicityModel(features, w[1] - w[0], float(b[1] - b[0]))


def score_toxicity(model: ToxicityModel, text_col: str = "text") -> Column:
    """The score of each whole text; null scores like the empty text."""
    return F.pandas_udf(lambda s: pd.Series([model.score(t) for t in s], dtype="float64"), "double")(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, per_class: int = 2000) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted.

    Labels count only where the id is not held out; the score depends on the text alone. Null and
    empty texts get the score of a text without features. Every row is scored, those with null or
    repeated ids too; an empty table gives no rows; other columns are ignored.
    """
    learn = labels.where(~held_out("doc_id"))
    model = fit_toxicity(docs, learn, per_class=per_class)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score_toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the labels that are not held out; odd rows as ``toxicity`` says."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
