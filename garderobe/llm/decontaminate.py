"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted shingle similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm.simhash import majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Of eight blocks of 8 bits one has at most one differing bit when no more than 15 of 64 bits differ.
BLOCKS, RADIUS = 8, 15
#: Items (and their words) sent to all tasks at once; a larger benchmark is searched for in several passes.
ITEMS_AT_ONCE = 20_000
WORDS_AT_ONCE = 2_000_000


@dataclass
class Sized:
    """Items of one number of shingles: ids, fingerprints and, per block value, the items within one bit of it."""

    rows: np.ndarray
    prints: np.ndarray
    near: list[list[np.ndarray]]


class Index:
    """A benchmark to look for. Items without words are never found."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.bags = [], []
        for item_id, text in items:
            hashes = shingle_hashes(text, SHINGLE)
            if len(hashes):
                self.ids.append(item_id)
                self.bags.append(Counter(hashes.tolist()))
        in_items = Counter(h for bag in self.bags for h in bag)
        #: A shingle weighs less the more items have it; one that no item has weighs 1.
        self.weight = {h: 1.0 / n for h, n in in_items.items()}
        self.known = np.array(sorted(in_items), np.uint64)
        sizes = np.array([sum(bag.values()) for bag in self.bags], int)
        self.sized = {int(n): self._sized(np.flatnonzero(sizes == n)) for n in np.unique(sizes)}

    def _sized(self, rows: np.ndarray) -> Sized:
        prints = np.array([majority(np.array(list(self.bags[r].elements()), np.uint64)) for r in rows], np.uint64)
        near = []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(8 * b)).astype(np.uint8)
            near.append([np.flatnonzero(np.bitwise_count(block ^ np.uint8(v)) <= RADIUS // BLOCKS) for v in range(256)])
        return Sized(rows, prints, near)

    def similarity(self, window: np.ndarray, row: int) -> float:
        """Weighted Jaccard similarity of the shingles, with their multiplicities."""
        own, other = Counter(window.tolist()), self.bags[row]
        both = sum(min(n, other[h]) * self.weight[h] for h, n in own.items() if h in other)
        all_ = sum(n * self.weight.get(h, 1.0) for h, n in own.items()) + sum(n * self.weight[h] for h, n in other.items()) - both
        return both / all_

    def find(self, text: str | None, similarity: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
        """(item_id, first shingle, shingles, similarity) of the best window for each item found in a whole text.

        A window has as many shingles as the item (or is the whole text, if that has fewer). Only windows whose share of
        shingles of some item is at least ``similarity`` can be similar enough; they are fingerprinted from running sums of
        bits.
        """
        hashes = shingle_hashes(text, SHINGLE)
        if not len(hashes) or not len(self.known):
            return []
        marked = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] == hashes)
        if not len(marked):
            return []
        touched = np.zeros(len(hashes) + 1, np.int64)
        touched[1:][marked] = 1
        touched = np.cumsum(touched)
        sums = None
        best: dict[int, tuple[float, int, int]] = {}
        for size, group in self.sized.items():
            n = min(size, len(hashes))
            # A shingle of no item weighs most, so the similarity is at most the share of the others.
            starts = np.flatnonzero(touched[n:] - touched[: len(hashes) - n + 1] >= max(1e-6, similarity * n - 1e-6))
            if not len(starts):
                continue
            if sums is None:
                bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                sums = np.zeros((len(hashes) + 1, 64), np.int32)
                np.cumsum(bits, axis=0, out=sums[1:])
            prints = np.packbits(2 * (sums[starts + n] - sums[starts]) > n, axis=1).view(">u8").ravel().astype(np.uint64)
            pairs = set()
            for b in range(BLOCKS):
                values = (prints >> np.uint64(8 * b)).astype(np.uint8)
                for v in np.unique(values).tolist():
                    items = group.near[b][v]
                    if len(items):
                        at = np.flatnonzero(values == v)
                        w, i = np.nonzero(np.bitwise_count(prints[at][:, None] ^ group.prints[items]) <= RADIUS)
                        pairs.update(zip(at[w].tolist(), items[i].tolist(), strict=True))
            for w, i in sorted(pairs):
                row, start = int(group.rows[i]), int(starts[w])
                value = self.similarity(hashes[start : start + n], row)
                if value >= similarity and (row not in best or value > best[row][0]):
                    best[row] = (value, start, n)
        return [(self.ids[r], s, n, v) for r, (v, s, n) in sorted(best.items())]


def indexes(benchmark: DataFrame) -> list[Index]:
    """The benchmark in parts of a checked size; one part for any usual benchmark."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    count, words = benchmark.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-count // ITEMS_AT_ONCE), -(-words // WORDS_AT_ONCE))
    own = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    return [Index([(r["item_id"], r["text"]) for r in own.where(F.col("part") == p).orderBy("item_id", "text").collect()]) for p in range(parts)]


def _finder(index: Index, similarity: float) -> Callable:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows = [(d, item, s, n, v) for i, d in enumerate(ids) for item, s, n, v in index.find(texts[i].as_py(), similarity)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "shingles", "similarity"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, shingles, similarity): every benchmark item found in a document, with its best window.

    Whole texts are searched without a shuffle. Null and blank texts and items match nothing; repeated documents and
    items are reported again; ties go to the first window; an empty table on either side gives no rows. A row with a
    null id is reported with it.
    """
    schema = "doc_id long, item_id long, start long, shingles long, similarity double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [own.mapInArrow(_finder(index, similarity), schema) for index in indexes(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found."""
    for index in indexes(benchmark):

        @F.pandas_udf("boolean")
        def clean(texts, index=index):
            return texts.map(lambda t: not index.find(t, similarity))

        docs = docs.where(clean("text"))
    return docs
