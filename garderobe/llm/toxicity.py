"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over words."""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm.common import raw
from garderobe.llm.training import clear_labels, fold, pick, texts_of

POSITIVES = 4_000
UNLABELLED = 8_000
ROUNDS = 300
#: A word is a feature when it is in so many confirmed documents of the sample and its share there differs from that
#: in the unlabelled ones by a likelihood ratio (G squared) of at least this much.
LEAST_DOCS = 5
LEAST_RATIO = 15.0
SPLIT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def word_set(text: str | None) -> set[bytes]:
    """The different words of a whole text, A-Z lowered, cut at ASCII punctuation too; null has none."""
    return set(raw(text).lower().translate(SPLIT).split())


@dataclass
class ToxicModel:
    bias: float
    weight: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found = word_set(text) & self.weight.keys()
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weight[w] for w in found), -30, 30))))


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """G squared of a of n against b of m."""
    out, share = 0.0, (a + b) / (n + m)
    for hits, total in ((a, n), (b, m)):
        for x, p in ((hits, share), (total - hits, 1 - share)):
            out += 2 * x * np.log(x / (total * p)) if x else 0.0
    return float(out)


def nnpu_fit(positive: list[set], unlabelled: list[set], prior: float, rounds: int = ROUNDS, rate: float = 0.2, sparse: float = 3e-5) -> ToxicModel:
    """Minimise prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]) with the logistic loss.

    While the second term, the risk on negatives, is below zero the step goes against it, so that the classifier can't
    gain by pushing confirmed documents out of the unlabelled ones. Soft thresholds after each step keep the weights
    of words that only happen to stand in a few documents at zero.
    """
    seen = Counter(w for d in positive for w in d)
    around = Counter(w for d in unlabelled for w in d if w in seen)
    frequent = (w for w, n in seen.items() if n >= LEAST_DOCS)
    vocab = sorted(w for w in frequent if likelihood_ratio(seen[w], len(positive), around[w], len(unlabelled)) >= LEAST_RATIO)
    index = {w: i for i, w in enumerate(vocab)}

    def matrix(docs):
        rows = [[index[w] for w in d & index.keys()] for d in docs]
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], int), len(rows)

    p, u = matrix(positive), matrix(unlabelled)
    weight, bias = np.zeros(len(vocab) + 1), 0.0
    moment, square = np.zeros(len(weight)), np.zeros(len(weight))

    def value(m):
        return np.bincount(m[0], weights=weight[m[1]], minlength=m[2]) + bias

    def back(m, slope):
        return np.append(np.bincount(m[1], weights=slope[m[0]], minlength=len(vocab)), slope.sum()) / m[2]

    for t in range(1, rounds + 1):
        bias = weight[-1]
        fp, fu = value(p), value(u)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = -back(p, 1 - sp) * prior
        down = back(u, su) - prior * back(p, sp)
        grad = up + down if negative >= 0 else -down
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        size = rate / (np.sqrt(square / (1 - 0.99**t)) + 1e-4)
        weight = weight - size * moment / (1 - 0.9**t)
        weight[:-1] = np.sign(weight[:-1]) * np.maximum(0, np.abs(weight[:-1]) - size[:-1] * sparse)
    return ToxicModel(float(weight[-1]), {w: float(x) for w, x in zip(vocab, weight[:-1], strict=True) if abs(x) > 1e-3})


def learn(docs: DataFrame, labels: DataFrame, parts: int = 5, out: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicModel:
    """Train on at most so many confirmed and unlabelled documents outside fold ``out``. The class prior is the share of
    toxic ones among all labelled documents there; labels say nothing about the unlabelled sample. Without a confirmed
    document every score is 0."""
    known = clear_labels(labels, "toxic").where(fold(F.col("doc_id"), parts) != out)
    prior = known.agg(F.avg("label")).first()[0]
    confirmed = texts_of(docs, pick(known.where("label = 1").select("doc_id"), positives))
    if not prior or not confirmed:
        return ToxicModel(-30.0)
    others = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != out)).select("doc_id")
    rest = texts_of(docs, pick(others, unlabelled))
    return nnpu_fit([word_set(r["text"]) for r in confirmed], [word_set(r["text"]) for r in rest], min(prior, 0.9))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null and empty texts have no words and get the score of the
    bias alone; contradictory labels are left out; rows may repeat; an empty table gives no rows."""
    model = learn(docs.select("doc_id", "text"), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    out = docs.select("doc_id", score("text").alias("score"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
