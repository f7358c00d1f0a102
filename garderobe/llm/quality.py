"""Quality of documents: a conditional random field labels every line, its marginals are averaged by line length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm import crf
from garderobe.llm.common import packed, raw
from garderobe.llm.training import clear_labels, fold, pick, texts_of

SAMPLE = 5_000
ROUNDS = 150
LINES_AT_ONCE = 50_000
CLASSES = (b"#*$%&", b"|", b"<>{}[]\\/_=~^@+", b"!", b"?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\r\x0b\x0c", b"aeiou", bytes(range(128, 256)))
WIDTH = len(CLASSES) + 7


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a whole text; null and empty texts are one empty line."""
    lines = raw(text).split(b"\n")
    out = np.zeros((len(lines), WIDTH))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        n = len(line)
        row = out[i]
        row[0] = np.log1p(n) / 8
        if not n:
            row[1] = 1
            continue
        words = line.split()
        row[2] = line in seen
        seen.add(line)
        row[3] = n / (len(words) + 1) / 10
        row[4] = len(set(words)) / max(len(words), 1)
        row[5] = np.log1p(len(words)) / 8
        row[6] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
        row[7:] = [(n - len(line.translate(None, c))) / n for c in CLASSES]
    return out, np.array([max(1, len(line)) for line in lines], float)


def with_neighbours(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of a line, of the lines before and after it (zero at the ends), whether it is first or last, and 1."""
    first = np.cumsum(lengths) - lengths
    last = np.cumsum(lengths) - 1
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    ends = np.zeros((len(x), 3))
    ends[first, 0], ends[last, 1], ends[:, 2] = 1, 1, 1
    return np.hstack([x, before, after, ends])


@dataclass
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def lines_good(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        z = with_neighbours((x - self.mean) / self.scale, lengths)
        return crf.marginals(z @ self.weight, lengths, self.trans, self.start)[:, 1]


def train(texts: list[str | None], labels: list[int], rounds: int = ROUNDS) -> LineModel | None:
    """Lines take the label of their document. Without a sample there is no model (every score is then 0.5)."""
    if not texts:
        return None
    parts = [line_features(t)[0] for t in texts]
    lengths = np.array([len(p) for p in parts])
    x = np.concatenate(parts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    z = with_neighbours((x - mean) / scale, lengths)
    gold = np.repeat(np.array(labels), lengths)
    own, trans, start = crf.fit(lambda p: z @ p[0], lambda e: [z.T @ e], [np.zeros((z.shape[1], 2))], gold, lengths, 2, rounds, 0.05, 1e-4)
    return LineModel(mean, scale, own[0], trans, start)


def score_texts(model: LineModel | None, texts) -> np.ndarray:
    scores, held, rows, count = np.full(len(texts), 0.5), [], [], 0
    if model is None:
        return scores

    def flush():
        lengths = np.array([len(x) for x, _ in held])
        good = model.lines_good(np.concatenate([x for x, _ in held]), lengths)
        weight = np.concatenate([w for _, w in held])
        cuts = np.cumsum(lengths) - lengths
        scores[rows] = np.clip(np.add.reduceat(good * weight, cuts) / np.add.reduceat(weight, cuts), 0, 1)

    for i, text in enumerate(texts):
        held.append(line_features(text))
        rows.append(i)
        count += len(held[-1][1])
        if count >= LINES_AT_ONCE:
            flush()
            held, rows, count = [], [], 0
    if held:
        flush()
    return scores


def learn(docs: DataFrame, labels: DataFrame, parts: int = 4, out: int = 2, sample: int = SAMPLE) -> LineModel | None:
    """Train on at most ``sample`` labelled documents whose fold is not ``out``."""
    known = clear_labels(labels, "quality").where(fold(F.col("doc_id"), parts) != out)
    rows = texts_of(docs, pick(known, sample))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def scored(docs: DataFrame, model: LineModel | None) -> DataFrame:
    """``docs`` with quality_score: from 0 to 1, higher the likelier the document is good. The model is a few kB."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts.tolist()))

    return docs.withColumn("quality_score", score("text"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null and empty texts are scored as one empty line; labels of
    null or contradictory value are not learned from; without any labels all scores are 0.5; rows may repeat."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with the same columns; without a usable label nothing is
    learned and no row is rejected."""
    model = learn(docs.select("doc_id", "text"), labels)
    if model is None:
        return docs
    return scored(packed(docs, "text"), model).where(F.col("quality_score") >= threshold).select("row.*")
