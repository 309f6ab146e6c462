"""Toxicity by a chain of linear classifiers.

The categories are predicted in order.  Each is a logistic regression on words and word
beginnings and on the probabilities of the categories before it.  In training those are
out-of-fold predictions, so a later model sees earlier probabilities of the quality that
it will see on new documents.

At most ``sample`` labelled rows train the models, those with the smallest hashes of their
ids; features are the ``features`` words and beginnings whose association with a category
is strongest among those that pass a Bonferroni-corrected likelihood-ratio test.  Models
are applied to whole texts of all documents.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.llm.texts import map_rows, worker_state
from obsflow.plans import runtime

SAMPLE = 8_000
FEATURES = 256
FOLDS = 5
RIDGE = 0.05
# Lengths of the word beginnings that are features; "$" marks whole words.
BEGINNINGS = (4, 5, 6)
_CACHE = 200_000
_WORDS = re.compile(r"[^\W\d_]+")

# In chain order, as conditions on the labels.
CATEGORIES = {
    "abusive_prose": "toxic = 1 and coalesce(quality = 1, false)",
    "abusive_junk": "toxic = 1 and coalesce(quality = 0, false)",
    "toxic": "toxic = 1",
}


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) > k)]


def text_words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():  # one class only: its share, pulled to the middle by one row
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        w[-1] = math.log(p / (1 - p))
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + 0.5 * (penalty * v * v).sum()
    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * (1 + abs(now)):
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """One weight vector a category: features, probabilities of earlier categories, intercept."""
    models = []
    for c in range(y.shape[1]):
        models.append(fit(x, y[:, c]))
        out = np.empty(len(x))
        for f in range(FOLDS):
            held = folds == f
            if held.any():
                out[held] = _predict(x[held], fit(x[~held], y[~held, c]))
        x = np.hstack([x, out[:, None]])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, features: int = FEATURES) -> tuple[dict[str, int], list[np.ndarray]]:
    """Feature numbers and the models of the chain.  Labels with a null in all categories do not count."""
    marks = [F.coalesce(F.expr(c), F.lit(False)).alias(f"y{i}") for i, c in enumerate(categories.values())]
    seen = reduce(lambda a, b: a | b, [F.expr(c).isNotNull() for c in categories.values()])
    picked = (labels.filter(seen & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), *marks)
              .orderBy(F.xxhash64("doc_id"), "doc_id", *[f"y{i}" for i in range(len(marks))]).limit(sample))
    ys = [f"y{i}" for i in range(len(marks))]
    # At most `sample` rows.
    rows = runtime.checkpoint(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id"))

    def spread():
        def f(text, *y):
            for k in {k for w in text_words(text) for k in word_features(w)}:
                yield (k, *y)
        return f

    total = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col(y).cast("int")), F.lit(0)) for y in ys]).first()
    n = total[0]
    if not n:
        return {}, fit_chain(np.empty((0, 0)), np.empty((0, len(ys))), np.empty(0))
    counts = (map_rows(rows.select("text", *ys), spread, ", ".join(["feature string", *(f"{y} boolean" for y in ys)]), rows=20_000)
              .groupBy("feature").agg(F.count("*").alias("df"), *[F.sum(F.col(y).cast("int")).alias(y) for y in ys]).filter("df > 2"))
    counts = runtime.checkpoint(counts)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    def ratio(i: int) -> Column:
        """Likelihood ratio of the 2 x 2 table of feature and category."""
        p, k, df = total[i + 1], F.col(ys[i]).cast("double"), F.col("df").cast("double")
        cells = [(k, df, p), (df - k, df, n - p), (p - k, n - df, p), (n - p - df + k, n - df, n - p)]
        return 2 * reduce(lambda a, b: a + b, [part(c, a * F.lit(float(b)) / n) for c, a, b in cells])

    g = F.greatest(*[ratio(i) for i in range(len(ys))], F.lit(0.0))
    least = 2 * math.log(max(counts.count(), 1) / 0.05)
    best = [r["feature"] for r in counts.select("feature", g.alias("g")).filter(F.col("g") > least).orderBy(F.desc("g"), "feature").limit(features).collect()]
    index = {k: i for i, k in enumerate(best)}

    def vector():
        look = _lookup(index)

        def f(doc, text, *y):
            yield doc, [i for w in text_words(text) for i in look[w]], list(y)
        return f

    got = map_rows(rows.select("doc_id", "text", *ys), vector, "doc_id bigint, at array<int>, y array<boolean>").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(FOLDS))).orderBy("doc_id", "y").collect()
    x = np.zeros((len(got), len(index)))
    for r, row in enumerate(got):
        np.add.at(x[r], row["at"], 1.0)
    return index, fit_chain(np.minimum(x, 3.0), np.array([r["y"] for r in got], dtype=float).reshape(len(got), len(ys)), np.array([r["fold"] for r in got]))


class _Lookup(dict):
    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        got = self[word] = tuple(self.index[k] for k in word_features(word) if k in self.index)
        return got


def _lookup(index: dict[str, int]) -> _Lookup:
    state, key = worker_state("toxicity"), ("toxicity", tuple(index))
    if state.get("toxicity", (None,))[0] != key:
        state["toxicity"] = key, _Lookup(index)
    return state["toxicity"][1]


def probabilities(text: Column, index: dict[str, int], models: list[np.ndarray]) -> Column:
    """The chain's probabilities of a text column, in chain order; null for texts without words."""
    weights = [m.tolist() for m in models]
    width = len(index)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        look = _lookup(index)
        got = []
        for text in texts:
            words = text_words(text)
            hits: dict[int, int] = {}
            for w in words:
                for i in look[w]:
                    hits[i] = hits.get(i, 0) + 1
            out: list[float] = []
            for w in weights:
                z = w[-1] + sum(min(k, 3) * w[i] for i, k in hits.items()) + sum(p * u for p, u in zip(out, w[width:-1], strict=True))
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            got.append([round(p, 6) for p in out] if words else None)
        return pd.Series(got, dtype=object)

    return run(text)


def scored(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` for each category, and ``rejected`` (the last one is above the threshold), of every row.

    Null texts and texts without words have null probabilities and are never rejected.
    Without labels no word counts and nothing is rejected.  Other columns are ignored.
    """
    categories = categories or CATEGORIES
    index, models = train(docs, labels, categories, id_col, text_col, sample)
    p = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), probabilities(F.col(text_col).cast("string"), index, models).alias("p"))
    return p.select("doc_id", *[F.get("p", i).alias(f"p_{c}") for i, c in enumerate(categories)], _rejected(F.col("p"), index, models, threshold).alias("rejected"))


def _rejected(p: Column, index: dict[str, int], models: list[np.ndarray], threshold: float) -> Column:
    return F.coalesce(F.get(p, len(models) - 1) > threshold, F.lit(False)) if index else F.lit(False)


def without_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``scored`` does not reject, with all their columns."""
    index, models = train(docs, labels, categories or CATEGORIES, id_col, text_col, sample)
    return docs.filter(~_rejected(probabilities(F.col(text_col).cast("string"), index, models), index, models, threshold))
