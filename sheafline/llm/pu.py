"""Quality classifier by positive-unlabelled learning.

A linear model over binned figures of a text is trained on trusted positives
(labelled good) and unlabelled documents. It minimises the non-negative unbiased
risk

    prior * E_pos[loss(g, +1)] + max(0, E_unl[loss(g, -1)] - prior * E_pos[loss(g, -1)])

with the logistic loss; where the second term falls below zero, the step goes the other
way, which keeps the model from fitting the unlabelled data as negative. The class
prior is estimated as the share of good ones among the labelled training
documents; negative labels are used for nothing else.

Training reads at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled documents, taken by a
hash of the id from all that are not held out; scoring covers every text as a whole.

Null and empty texts have figures of zero and get the score of those. Without
any positive label every score is the prior, or 0.5 without labels at all. Repeated
labels of a document count once: it is a positive if any of them is 1.
A document's lang, source and id are never part of its figures.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.common import held_out, keyed_texts, map_texts

#: At most so many positives, and so many unlabelled documents, are trained on.
SAMPLE = 6000
BINS = 10
STEPS = 1500
RATE = 0.1
L2 = 1e-4

FIGURES = (
    "words word_length distinct symbols pipes capitals shouts neighbours windows lines "
    "stops digits marks line_words top_word longest"
).split()


def figures(text: str) -> list[float]:
    """Figures of one whole text, none of which says what language it is in."""
    words = text.encode("utf-8").split()
    n = len(words)
    if n == 0:
        return [0.0] * len(FIGURES)
    count = text.count
    chars = len(text)
    times = Counter(words)
    windows = set(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text)) or 1
    digits = sum(map(count, "0123456789"))
    symbols = sum(map(count, "#*$%&<>^~=_\\{}[]@"))
    pipes = count("|")
    stops, shouts = count("."), count("!") + count("?")
    blanks = sum(map(count, " \n\t\r"))
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n),
        (chars - blanks) / n,
        len(times) / n**0.85,
        symbols / n,
        pipes / n,
        upper / letters,
        shouts / n,
        neighbours / n,
        1 - len(windows) / (n - 2) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        stops / n,
        digits / chars,
        (chars - letters - digits - blanks) / chars,
        n / max(1, len(lines)),
        times.most_common(1)[0][1] / n,
        max(map(len, words)),
    ]


@dataclass
class Model:
    edges: np.ndarray  # of each figure's bins
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        g = design(np.array([figures(t) for t in texts]), self.edges) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(g, -30, 30)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Quantiles of each figure, with more of them in the upper tail."""
    at = np.r_[np.linspace(0, 1, bins + 1)[1:-1], 0.93, 0.97, 0.99]
    return np.quantile(x, np.sort(at), axis=0).T


def design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each figure, which of its edges a text exceeds."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float64)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by gradient steps with momentum, all rows at a time."""
    edges = bin_edges(np.concatenate([positive, unlabelled]))
    p, u = design(positive, edges), design(unlabelled, edges)
    w, b = np.zeros(p.shape[1]), 0.0
    mean_w, mean_b, var_w, var_b = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    sigmoid = lambda g: 1.0 / (1.0 + np.exp(-np.clip(g, -30, 30)))
    for step in range(1, STEPS + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = sigmoid(gp), sigmoid(gu)
        # risk of the unlabelled as negatives, less the positives' part of it
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        neg_w = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        neg_b = su.mean() - prior * sp.mean()
        if rest < 0:
            dw, db = -neg_w, -neg_b
        else:
            dw = prior * (p.T @ (sp - 1)) / len(p) + neg_w
            db = prior * (sp - 1).mean() + neg_b
        dw = dw + L2 * w
        mean_w, mean_b = 0.9 * mean_w + 0.1 * dw, 0.9 * mean_b + 0.1 * db
        var_w, var_b = 0.999 * var_w + 0.001 * dw**2, 0.999 * var_b + 0.001 * db**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - RATE * (mean_w / fix1) / (np.sqrt(var_w / fix2) + 1e-8) / np.sqrt(step)
        b = b - RATE * (mean_b / fix1) / (np.sqrt(var_b / fix2) + 1e-8) / np.sqrt(step)
    return Model(edges, w, b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model from the documents that are not held out; a float if there is nothing to learn."""
    good = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    seen, positives = good.agg(
        F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))
    ).first()
    if positives == 0:
        return 0.0 if seen else 0.5
    prior = min(0.99, positives / seen)
    ids = docs.filter(~held_out(F.col("doc_id")))
    total = ids.count()

    def share(n: int) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(
            min(1 << 20, int((1 << 20) * sample / max(1, n)) + 1)
        )

    # a bounded number of ids, so the texts are not shuffled to find them
    chosen = good.filter("quality = 1").filter(share(positives)).select("doc_id")
    texts = keyed_texts(ids).select("doc_id", "text")

    def run(rows: list[str]) -> dict[str, list]:
        return {"x": [figures(t) for t in rows]}

    def taken(df: DataFrame) -> np.ndarray:
        made = map_texts(df, run, "x array<double>", [])
        return np.array([r["x"] for r in made.limit(2 * sample).collect()]).reshape(-1, len(FIGURES))

    positive = taken(texts.join(F.broadcast(chosen), "doc_id", "left_semi"))
    unlabelled = taken(texts.filter(share(total)))
    if not len(positive) or not len(unlabelled):
        return prior
    return train(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        m = shared.value
        s = np.full(len(texts), m) if isinstance(m, float) else m.scores(texts)
        return {"score": s, "predicted": (s >= 0.5).astype(int)}

    made = map_texts(
        keyed_texts(docs), run, "doc_id long, score double, predicted int", ["doc_id"]
    )
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passes(texts: pd.Series) -> pd.Series:
        m = shared.value
        texts = texts.fillna("").tolist()
        s = np.full(len(texts), m) if isinstance(m, float) else m.scores(texts)
        return pd.Series(s >= 0.5)

    keyed_texts(docs)  # sends the package
    return docs.filter(F.pandas_udf(passes, "boolean")(F.col("text").cast("string")))
