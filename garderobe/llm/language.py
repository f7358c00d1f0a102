"""Language of documents: a conditional random field over words, for texts that switch between languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm import crf
from garderobe.llm.common import raw
from garderobe.llm.training import fold, pick, texts_of

SAMPLE = 800
ROUNDS = 25
BINS = 1 << 17
#: Bins of the lexicon, and when a word of the training rows speaks for a language: so often, and so large a share.
LEXICON = 1 << 17
LEAST_TIMES, LEAST_SHARE = 3, 0.8
#: Words of more bytes get their features one by one, in stretches, instead of in one matrix.
NARROW = 48
STRETCH = 1 << 16
WORDS_AT_ONCE = 200_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def lowered(text: str | None) -> list[bytes]:
    """The words of a text in lower case; null has none."""
    return raw(text.lower() if text else text).split()


def slot(value: np.ndarray, kind: int) -> np.ndarray:
    """Index of a feature in the weight table, from 1 on."""
    h = (value.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(BINS - 1) + np.uint64(1)).astype(np.int32)


def named(words: list[bytes], lexicon: np.ndarray | None) -> list[np.ndarray]:
    """Indices for the whole words and for what the lexicon says of them (0: nothing)."""
    whole = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = [slot(whole >> np.uint64(8), 1)]
    if lexicon is not None:
        says = lexicon[np.array([crc32(w) % LEXICON for w in words])]
        out.append(np.where(says > 0, slot(says, 12), 0).astype(np.int32))
    return out


def word_features(words: list[bytes], lexicon: np.ndarray | None = None) -> np.ndarray:
    """(words, features) of indices into the weight table: the whole word, its language in the lexicon, affixes of 1 to 3
    bytes, all n-grams of 2 to 4 bytes. Index 0 means no feature. For words of like length."""
    width = max(map(len, words))
    sizes = np.array([len(w) for w in words])
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.uint64)
    right = np.frombuffer(b"".join(w.rjust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.uint64)
    out, gram = [x[:, None] for x in named(words, lexicon)], left
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for n in range(1, min(3, width) + 1):
        head = head * np.uint64(256) + left[:, n - 1]
        tail = tail + right[:, width - n] * np.uint64(256 ** (n - 1))
        out.append(np.where(sizes >= n, slot(head, 1 + n), 0)[:, None])
        out.append(np.where(sizes >= n, slot(tail, 4 + n), 0)[:, None])
    for n in range(2, min(4, width) + 1):
        gram = gram[:, :-1] * np.uint64(256) + left[:, n - 1 :]
        out.append(np.where(np.arange(width - n + 1) + n <= sizes[:, None], slot(gram, 6 + n), 0))
    return np.hstack(out)


def long_features(word: bytes, lexicon: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The same indices for one long word, a stretch at a time."""
    first = [*named([word], lexicon)]
    for n in range(1, 4):
        first += [slot(np.array([int.from_bytes(x, "big")], np.uint64), kind + n) for x, kind in ((word[:n], 1), (word[-n:], 4))]
    yield np.concatenate(first)
    for at in range(0, len(word), STRETCH):
        x = np.frombuffer(word[at : at + STRETCH + 3], np.uint8).astype(np.uint64)
        gram, own = x, min(STRETCH, len(word) - at)
        for n in range(2, 5):
            gram = gram[:-1] * np.uint64(256) + x[n - 1 :]
            yield slot(gram[:own], 6 + n)


@dataclass
class WordModel:
    langs: list[str]
    weight: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray | None = None

    def words(self, docs: list[list[bytes]]) -> np.ndarray:
        """P(language) of every word of the documents, end to end; each document has a word."""
        kinds, of = _types(docs)
        score = _type_scores(kinds, self.weight, self.lexicon)[of]
        return crf.marginals(score.astype(float), np.array([len(d) for d in docs]), self.trans, self.start)


def _types(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    index: dict[bytes, int] = {}
    of = [index.setdefault(w, len(index)) for d in docs for w in d]
    return list(index), np.array(of)


def _type_scores(kinds: list[bytes], weight: np.ndarray, lexicon: np.ndarray | None) -> np.ndarray:
    out = np.empty((len(kinds), weight.shape[1]), np.float32)
    order = sorted(range(len(kinds)), key=lambda i: len(kinds[i]))  # like lengths together: narrow matrices
    short = [i for i in order if len(kinds[i]) <= NARROW]
    for a in range(0, len(short), 8192):
        rows = short[a : a + 8192]
        out[rows] = weight[word_features([kinds[i] for i in rows], lexicon)].sum(axis=1)
    for i in order[len(short) :]:
        out[i] = sum(weight[f].sum(axis=0) for f in long_features(kinds[i], lexicon))
    return out


def train(texts: list[str], langs: list[str], rounds: int = ROUNDS, names: list[str] | None = None, lexicon: np.ndarray | None = None) -> WordModel | None:
    """Words take the language of their document; ``lexicon`` numbers the languages of ``names`` from 1. Without a sample
    there is no model."""
    pairs = [(lowered(t), lang) for t, lang in zip(texts, langs, strict=True)]
    pairs = [p for p in pairs if p[0]]
    if not pairs:
        return None
    names = sorted({lang for _, lang in pairs}) if names is None else names
    docs = [d for d, _ in pairs]
    lengths = np.array([len(d) for d in docs])
    gold = np.repeat([names.index(lang) for _, lang in pairs], lengths)
    kinds, of = _types(docs)
    k = len(names)
    order = np.array(sorted(range(len(kinds)), key=lambda i: len(kinds[i])))
    kinds, place = [kinds[i] for i in order], np.argsort(order)
    of = place[of]
    n_short = sum(len(w) <= NARROW for w in kinds)
    slots = [word_features(kinds[a : min(a + 8192, n_short)], lexicon) for a in range(0, n_short, 8192)]
    long = [np.concatenate(list(long_features(w, lexicon))) for w in kinds[n_short:]]

    def score_of(own):
        return np.concatenate([own[0][s].sum(axis=1) for s in slots] + [own[0][f].sum(axis=0)[None] for f in long])[of]

    def push(error):
        grad = np.zeros((BINS, k))
        for j in range(k):
            per_type = np.bincount(of, weights=error[:, j], minlength=len(kinds))
            for a, s in enumerate(slots):
                own = per_type[a * 8192 : a * 8192 + len(s)]
                grad[:, j] += np.bincount(s.ravel(), weights=np.repeat(own, s.shape[1]), minlength=BINS)
            for f, e in zip(long, per_type[n_short:], strict=True):
                grad[:, j] += e * np.bincount(f, minlength=BINS)
        grad[0] = 0
        return [grad]

    own, trans, start = crf.fit(score_of, push, [np.zeros((BINS, k))], gold, lengths, k, rounds, 0.1, 1e-6)
    own[0][0] = 0
    return WordModel(names, own[0].astype(np.float32), trans, start, lexicon)


def word_lexicon(docs: DataFrame, names: list[str]) -> np.ndarray:
    """For each bin of words 1 + the language (by ``names``) that most of the words of ``docs`` in it belong to, 0 if they
    are few or mixed. All rows are counted; a task sends one row for a bin and language at most."""
    where = {n: i for i, n in enumerate(names)}

    def count(batches):
        total = np.zeros(LEXICON * len(names), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                bins = np.fromiter(map(crc32, lowered(text.as_py())), np.int64) % LEXICON
                bins, times = np.unique(bins, return_counts=True)
                total[bins * len(names) + where[lang]] += times
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    cells = docs.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    bins = cells.groupBy(F.expr(f"cell div {len(names)}").cast("int").alias("bin")).agg(F.sum("n").alias("all"), F.max(F.struct("n", (F.col("cell") % len(names)).alias("lang"))).alias("best"))
    strong = bins.where((F.col("all") >= LEAST_TIMES) & (F.col("best.n") >= LEAST_SHARE * F.col("all")))
    out = np.zeros(LEXICON, np.int32)
    rows = strong.select("bin", (F.col("best.lang") + 1).cast("int").alias("says")).toPandas()  # LEXICON rows at most
    out[rows["bin"].to_numpy()] = rows["says"].to_numpy()
    return out


def label_texts(model: WordModel | None, texts) -> tuple[list[str], np.ndarray]:
    """(language, score) of whole texts: the language with most of the words, weighted by their length, and its share."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    held: list[tuple[int, list[bytes]]] = []
    count = 0

    def flush():
        docs = [d for _, d in held]
        share = model.words(docs)
        weight = np.array([len(w) for d in docs for w in d], float)
        lengths = np.array([len(d) for d in docs])
        total = np.add.reduceat(share * weight[:, None], np.cumsum(lengths) - lengths, axis=0)
        total /= total.sum(axis=1, keepdims=True)
        for (i, _), row in zip(held, total, strict=True):
            names[i], scores[i] = model.langs[int(row.argmax())], min(1.0, float(row.max()))

    for i, text in enumerate(texts):
        if model is None or text is None or not LETTER.search(text):
            continue
        held.append((i, lowered(text)))
        count += len(held[-1][1])
        if count >= WORDS_AT_ONCE:
            flush()
            held, count = [], 0
    if held:
        flush()
    return names, scores


def learn(docs: DataFrame, parts: int = 4, out: int = 2, sample: int = SAMPLE) -> WordModel | None:
    """Train on at most ``sample`` documents outside fold ``out``: about as many of each language, chosen by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != out)).select("doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * sample / len(counts) / n))]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 20)) < share * (1 << 20))
    one = drawn.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other").select("doc_id", "lang")
    rows = texts_of(docs, pick(one, sample))
    names = sorted(counts)
    trained = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != out))
    return train([r["text"] for r in rows], [r["lang"] for r in rows], names=names, lexicon=word_lexicon(trained, names))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row. Null texts and texts without a letter are ``und`` with score
    0, and so is everything if no document has a language; rows may repeat, a null id is not learned from."""
    model = learn(docs.select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of BINS rows, whatever the input

    def label(texts: pd.Series) -> pd.DataFrame:
        names, scores = label_texts(shared.value, texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = F.pandas_udf(label, "lang_pred string, score double")
    out = docs.select("doc_id", found("text").alias("f"))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "f.lang_pred", "f.score")
