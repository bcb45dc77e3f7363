"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_plain_words", "n_upper_words", "n_ends", "n_distinct_words")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one whole text; all are zero for null and for texts without words."""
    if not text:
        return (0,) * len(COUNTS)
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = 0
    if n > 2 and len(set(zip(words, words[1:], words[2:]))) < n - 2:
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        covered = np.zeros(n, dtype=bool)
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + 3] = True
        repeated = int(covered.sum())
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(x.rstrip(_SPACES)[-1] in '.!?"' for x in lines),
        sum(map(str.isalpha, words)),
        sum(map(str.isupper, words)),
        text.count(".") + text.count("!") + text.count("?"),
        len(set(words)),
    )


def _counts(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    # called nondeterministic, so that a filter on the counts is not pushed below them and counts again
    return F.pandas_udf(of, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()(text)


def _share(of: str, to: str):
    return lambda s: F.when(s[to] > 0, s[of] / s[to]).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """Votes bad at or beyond one bound, good within the other, and abstains between."""

    name: str
    bad_from: float
    good_to: float
    of: str
    to: str
    falling: bool = False  # small shares are the bad ones

    def vote(self, s: Column) -> Column:
        x = _share(self.of, self.to)(s)
        bad, good = (x <= self.bad_from, x >= self.good_to) if self.falling else (x >= self.bad_from, x <= self.good_to)
        return F.when(s["n_words"] == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


#: Shares follow published web-text filters; between its two bounds a rule abstains.
RULES = (
    Rule("symbols", 0.10, 0.02, "n_symbols", "n_words"),
    Rule("long_words", 10.0, 8.0, "word_chars", "n_words"),
    Rule("short_words", 3.0, 3.5, "word_chars", "n_words", falling=True),
    Rule("repeated_lines", 0.30, 0.10, "n_dup_lines", "n_lines"),
    Rule("repeated_words", 0.30, 0.10, "n_repeat_words", "n_words"),
    Rule("plain_words", 0.60, 0.75, "n_plain_words", "n_words", falling=True),
    Rule("capitals", 0.30, 0.10, "n_upper_words", "n_words"),
    Rule("line_ends", 0.10, 0.60, "n_ended_lines", "n_lines", falling=True),
    Rule("sentence_ends", 0.005, 0.02, "n_ends", "n_words", falling=True),
    Rule("variety", 0.15, 0.35, "n_distinct_words", "n_words", falling=True),
)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


class LabelModel:
    """Two-class model of rules that vote -1, 0 or 1 independently given the class; fitted by EM.

    It sees the number of documents for each pattern of votes, of which there are at most 3 to the
    number of rules, whatever the corpus. ``odds`` holds each rule's log odds of good for each vote.
    """

    def __init__(self, prior: float = 0.8, rounds: int = 100, smoothing: float = 1.0):
        self.prior, self.rounds, self.smoothing = prior, rounds, smoothing

    def fit(self, votes: np.ndarray, counts: np.ndarray) -> LabelModel:
        n_rules = votes.shape[1] if votes.size else 0
        self.odds = np.zeros((n_rules, 3))
        if not n_rules or counts.sum() == 0:
            return self
        hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        # a first guess: kinds of bad text differ, so that one bad vote says more than many good ones
        bad = (votes < 0).sum(1)
        good = np.where(bad == 0, 0.98, np.where(bad == 1, 0.3, 0.05))
        weight = counts / counts.sum() * min(counts.sum(), 1e6)
        for _ in range(self.rounds):
            w1, w0 = weight * good, weight * (1 - good)
            p1 = np.tensordot(w1, hot, (0, 0)) + self.smoothing
            p0 = np.tensordot(w0, hot, (0, 0)) + self.smoothing
            self.prior = float(np.clip((w1.sum() + 1) / (w1.sum() + w0.sum() + 2), 0.02, 0.98))
            self.odds = np.log(p1 / p1.sum(1, keepdims=True)) - np.log(p0 / p0.sum(1, keepdims=True))
            self.odds[:, 1] = 0.0  # to abstain says nothing
            new = self.posterior(votes)
            if np.abs(new - good).max() < 1e-9:
                break
            good = new
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + sum(self.odds[i][votes[:, i] + 1] for i in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def column(self, votes: list[Column]) -> Column:
        z = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for row, v in zip(self.odds, votes, strict=False):
            z = z + F.when(v < 0, F.lit(float(row[0]))).when(v > 0, F.lit(float(row[2]))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_label_model(counted: DataFrame, counts_col: str) -> LabelModel:
    """Counts the patterns of votes over all rows and fits the model to them."""
    s = F.col(counts_col)
    patterns = counted.where(s["n_words"] > 0).select(*[r.vote(s).alias(r.name) for r in RULES]).groupBy(*[r.name for r in RULES]).count().collect()
    votes = np.array([[p[r.name] for r in RULES] for p in patterns], dtype=int).reshape(len(patterns), len(RULES))
    order = np.lexsort(votes.T) if len(patterns) else []
    return LabelModel().fit(votes[order], np.array([p["count"] for p in patterns], dtype=float)[order])


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: counts, base_failed, quality (posterior) and kept.

    Null and empty texts, and texts of white space alone, have zero counts and fail the base rule.
    Rows with equal or null ids are scored one by one; other columns are ignored; an empty table
    gives no rows. Equal texts always get equal verdicts.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.put(docs.select(F.col(id_col).alias("doc_id"), _counts(F.col(text_col)).alias("s")), "counts")
    model = fit_label_model(counted, "s")
    s = F.col("s")
    quality = model.column([r.vote(s) for r in RULES])
    return counted.select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & (quality >= threshold)).alias("kept"),
        quality.alias("quality"),
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    The model is fitted in a first pass over all rows; the verdict is then a function of each row alone,
    so no row is moved or written between. Null and empty texts are not kept.
    """
    (c,) = fresh(docs, "quality_counts")
    s = F.col(c)
    counted = docs.withColumn(c, _counts(F.col(text_col)))
    model = fit_label_model(counted, c)
    return counted.where(~base_failed(s) & (model.column([r.vote(s) for r in RULES]) >= threshold)).drop(c)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; odd rows as ``score_quality`` says."""
    return score_quality(table(spark, sf_dir, "documents"))
