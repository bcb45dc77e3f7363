"""Linear models of whole texts over mined words, word beginnings and marks of style.

A vocabulary is mined from a bounded, documented sample of labelled rows; the model over it is
trained by Spark's logistic regression; scoring passes once over every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGES = ".,;:!?\"'()[]{}<>#*$%&|~^`-_=+/\\«»“”‘’…"
_LEET = str.maketrans("013457@$", "oieastas")
_PREFIXES = (4, 5, 6)


def style_marks(text: str, words: list[str]) -> list[str]:
    """Marks for shares of symbols, capitals, bars, cries and repeats that pass a fixed bound."""
    n = len(words)
    if not n:
        return ["s:empty"]
    out = []
    for mark, share, bound in (
        ("s:symbols", sum(map(text.count, "#*$%&|<>")) / n, 0.3),
        ("s:bars", text.count("|") / n, 0.2),
        ("s:cries", text.count("!") / n, 0.3),
        ("s:digits", sum(map(text.count, "0123456789")) / n, 0.5),
        ("s:few_ends", 1 - (text.count(".") + text.count("!") + text.count("?")) / n, 0.995),
    ):
        if share > bound:
            out.append(mark)
    if sum(map(str.isupper, words)) > 0.3 * n:
        out.append("s:capitals")
    if len(set(words)) < 0.3 * n:
        out.append("s:repeats")
    if n < 50:
        out.append("s:short")
    return out


def plain_words(words: list[str]) -> set[str]:
    """Distinct words in small letters without marks at their edges; letters written as digits are read."""
    out = set()
    for w in set(words):
        if not w.isalpha():
            w = w.strip(_EDGES)
            if w and not w.isalpha():
                w = w.translate(_LEET).replace("*", "").replace(".", "").replace("-", "")
        if w:
            out.add(w)
    return out


def text_features(text: str | None) -> list[str]:
    """Every feature a text has, each once: w:word, p:beginning, s:mark."""
    words = (text or "").split()
    out = style_marks(text or "", words)
    plain = plain_words((text or "").lower().split())
    out += ["w:" + w for w in plain]
    out += {"p:" + w[:k] for w in plain for k in _PREFIXES if len(w) > k}
    return out


class Vocabulary:
    """Finds which of a bounded list of features a text has."""

    def __init__(self, features: list[str]):
        self.features = features
        at = {f: i for i, f in enumerate(features)}
        self.words = {f[2:]: i for f, i in at.items() if f[0] == "w"}
        self.starts = [(k, {f[2:]: i for f, i in at.items() if f[0] == "p" and len(f) == k + 2}) for k in _PREFIXES]
        self.starts = [(k, d) for k, d in self.starts if d]
        self.marks = {f: i for f, i in at.items() if f[0] == "s"}

    def hits(self, text: str | None) -> list[int]:
        """Ascending numbers of the features that the whole text has."""
        text = text or ""
        out = set()
        if self.marks:
            out.update(self.marks[m] for m in style_marks(text, text.split()) if m in self.marks)
        words, starts = self.words, self.starts
        for w in plain_words(text.lower().split()):
            if w in words:
                out.add(words[w])
            for k, found in starts:
                if len(w) > k and (p := w[:k]) in found:
                    out.add(found[p])
        return sorted(out)


def near_copy_key(text: str | None) -> int:
    """Least hash of the five-word windows: near copies mostly share it, so that they count once."""
    from xxhash import xxh64_intdigest

    words = (text or "").split()
    windows = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxh64_intdigest(w) for w in windows) >> 1


def labelled_sample(labels: DataFrame, label: Column, per_class: int, classes: list, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those of the least hash; ``weight`` is the number
    of labelled rows that one of them stands for. Rows whose id or label is null are no labels."""
    rows = labels.select(F.col(id_col).alias("id"), label.alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = [rows.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class).withColumn("weight", F.lit(n.get(c, 0) / max(1, min(n.get(c, 0), per_class)))) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine(sample: DataFrame, classes: list, *, max_features: int = 4000, least_g2: float = 20.0, least_share: float = 0.01) -> list[str]:
    """Features that tell one class from the rest, at most ``max_features``.

    ``sample`` has text and y. A feature counts once for each group of near copies of a class. It is
    taken if it stands for some class with a likelihood ratio statistic of ``least_g2`` and is in
    ``least_share`` of the groups of that class (three at least).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"f": [text_features(t) for t in b["text"]], "g": [near_copy_key(t) for t in b["text"]], "y": b["y"]})

    rows = sample.select("text", F.col("y").cast("int").alias("y")).mapInPandas(run, "f array<string>, g long, y int")
    groups = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count_distinct("g").alias("n")).collect()}
    total = sum(groups.values())
    seen = rows.select(F.explode("f").alias("f"), "g", "y").groupBy("f", "y").agg(F.count_distinct("g").alias("n"))
    per = seen.groupBy("f").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in classes])
    best = []
    for c in classes:
        of, rest = groups.get(c, 0), total - groups.get(c, 0)
        if not of or not rest:
            continue
        a, b = F.col(f"n{c}"), F.col("n") - F.col(f"n{c}")
        ln = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
        mean = F.col("n") / F.lit(float(total))
        g2 = 2 * (ln(a, mean * of) + ln(b, mean * rest))
        own = (a / F.lit(float(of)) > b / F.lit(float(rest))) & (a >= max(3, round(least_share * of)))
        best.append(F.when(own, g2).otherwise(F.lit(0.0)))
    if not best:
        return []
    score = F.greatest(*best) if len(best) > 1 else best[0]
    return [r["f"] for r in per.select("f", score.alias("g2")).where(F.col("g2") >= least_g2).orderBy(F.desc("g2"), "f").limit(max_features).collect()]


def sample_hits(sample: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The sample with ``hits``, the numbers of the features each text has, instead of the text."""
    hits = F.pandas_udf(lambda s: pd.Series([vocabulary.hits(t) for t in s]), "array<int>")
    return sample.withColumn("hits", hits(F.col("text"))).drop("text")


def train(rows: DataFrame, n_features: int, n_classes: int, *, reg: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights (classes x features) and intercepts from rows of hits, label, weight."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    size = max(1, n_features)
    spelled = rows.select(F.col("hits").cast("array<string>").alias("hits"), F.col("label").cast("double"), F.col("weight").cast("double"))
    data = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], "hits", "features").transform(spelled)
    model = LogisticRegression(maxIter=60, regParam=reg, standardization=False, family="multinomial", weightCol="weight").fit(data)
    w, b = model.coefficientMatrix.toArray(), np.asarray(model.interceptVector.toArray())
    full_w, full_b = np.zeros((n_classes, size)), np.full(n_classes, -30.0)
    full_w[: len(w)], full_b[: len(b)] = w, b
    return full_w, full_b


def posteriors(vocabulary: Vocabulary, w: np.ndarray, b: np.ndarray) -> Callable[[str | None], np.ndarray]:
    def of(text: str | None) -> np.ndarray:
        h = vocabulary.hits(text)
        z = b + w[:, h].sum(axis=1)
        e = np.exp(z - z.max())
        return e / e.sum()

    return of
