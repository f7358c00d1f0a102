"""Substring removal: repeated token windows as edges of a De Bruijn graph, compacted along nonbranching paths."""

from __future__ import annotations

import hashlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garderobe.llm.blocks import Bucket, Shape, chain, covered, finish, first_of_runs, repeated_blocks, span_arrays
from garderobe.llm.common import Stash, raw

WIDTH = 35
ANCHOR = 6


def named(anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Dense numbers of the different (anchor, window) pairs."""
    order = np.lexsort((windows, anchor))
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(first_of_runs(anchor[order], windows[order])) - 1
    return name


def resolve(bucket: Bucket) -> pa.Table:
    """Edges of the graph in a bucket, one row for each occurrence: (doc_id, variant, start, windows, edge).

    The k-mers are the windows of 35 words, named by 64 bits of their words and 64 of their anchor. A window counts as
    often as its blocks stand anywhere. Consecutive repeated windows belong to one edge while the step between them is the
    only way out of the first and into the second: the step then stands as often as either.
    """
    head = first_of_runs(bucket.anchor, bucket.block)
    block = np.cumsum(head) - 1
    times = np.bincount(block)
    many = bucket.many[head].astype(np.int64)
    held = zip(bucket.anchor[head].tolist(), bucket.block[head].tolist(), strict=True)
    windows = np.frombuffer(b"".join(bucket.content(a, b) for a, b in held), np.uint64)
    of = np.repeat(np.arange(len(many)), many)
    name = named(bucket.anchor[head][of], windows)
    count = np.bincount(name, weights=times[of])[name].astype(np.int64)
    step = name[:-1] * (len(name) + 1) + name[1:]
    inner = of[1:] == of[:-1]
    _, step_name = np.unique(step, return_inverse=True)
    step_count = np.bincount(step_name, weights=np.where(inner, times[of[1:]], 0))[step_name] if len(step) else np.empty(0)
    repeated = count > 1
    begin = np.ones(len(windows), bool)
    begin[1:] = ~(inner & repeated[1:] & repeated[:-1] & (step_count == count[1:]) & (step_count == count[:-1]))
    starts = np.flatnonzero(begin & repeated)
    ends = np.append(np.flatnonzero(begin), len(windows))
    size = ends[np.searchsorted(ends, starts, side="right")] - starts
    edge = chain(windows[starts], windows[starts + size - 1]) if len(starts) else np.empty(0, np.uint64)
    offset = starts - (np.cumsum(many) - many)[of[starts]]
    low = np.searchsorted(of[starts], np.arange(len(many)))
    high = np.searchsorted(of[starts], np.arange(len(many)), side="right")
    each = (high - low)[block]  # edges of the block of each occurrence
    row = np.repeat(np.arange(len(block)), each)
    pick = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + low[block[row]]
    return pa.table(
        {
            "doc_id": bucket.doc[row],
            "variant": bucket.variant[row],
            "start": bucket.start[row].astype(np.int64) + offset[pick],
            "windows": size[pick].astype(np.int64),
            "edge": edge[pick].view(np.int64),
        }
    )


def compact(places: DataFrame, stash: Stash) -> DataFrame:
    """(edge, path, turn): maximal nonbranching paths of the edges in ``places``; ``turn`` is the place in the path.

    An edge follows another when each occurrence of either stands next to one of the other. Heads are found by
    doubling: every round an edge takes over what its predecessor points to. Edges on a cycle have no head and stay
    paths of their own.
    """
    order = Window.partitionBy("doc_id", "variant").orderBy("start")
    follows = F.lead("start").over(order) == F.col("start") + F.col("windows")
    before = F.lag(F.col("start") + F.col("windows")).over(order) == F.col("start")
    steps = places.select("edge", F.when(follows, F.lead("edge").over(order)).alias("after"), F.when(before, F.lag("edge").over(order)).alias("fore"))
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    graph = stash.keep(steps.groupBy("edge").agg(one("after").alias("after"), one("fore").alias("fore")))
    back = graph.where("after IS NOT NULL AND after <> edge").select(F.col("edge").alias("fore"), F.col("after").alias("edge"))
    linked = graph.select("edge", "fore").join(back, ["edge", "fore"], "left_semi")
    now = graph.select("edge").join(linked, "edge", "left").select("edge", F.coalesce("fore", "edge").alias("up"), F.when(F.col("fore").isNull(), 0).otherwise(1).cast("long").alias("turn"))
    now = stash.keep(now)
    rounds = ceil(log2(max(2, now.count()))) + 1
    for _ in range(rounds):
        over = now.select(F.col("edge").alias("up"), F.col("up").alias("top"), F.col("turn").alias("more"))
        after = stash.keep(now.join(over, "up").select("edge", F.col("top").alias("up"), (F.col("turn") + F.col("more")).alias("turn"), (F.col("top") != F.col("up")).alias("moved")))
        moving = after.where("moved").head(1)
        stash.drop(now)
        now = after.drop("moved")
        if not moving:
            return now.select("edge", F.col("up").alias("path"), "turn")
    heads = linked.select("edge").withColumn("inner", F.lit(True))
    cyclic = now.join(heads.withColumnRenamed("edge", "up"), "up", "left")
    return cyclic.select("edge", F.when(F.col("inner"), F.col("edge")).otherwise(F.col("up")).alias("path"), F.when(F.col("inner"), 0).otherwise(F.col("turn")).cast("long").alias("turn"))


def repeated_spans(docs: DataFrame, stash: Stash | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(documents told apart, spans (doc_id, variant, start, size, path) in words) of all repeated passages.

    The source coordinates of the edges verify a path: its edges must stand end to end in a document, in the order of
    the path, to become one span; where they don't, each edge is a span by itself.
    """
    stash = stash or Stash(docs.sparkSession)
    apart, found = repeated_blocks(docs, Shape(WIDTH, ANCHOR, True), False, resolve, "doc_id long, variant long, start long, windows long, edge long", stash, **options)
    places = stash.keep(found.distinct())
    paths = compact(places, stash)
    order = Window.partitionBy("doc_id", "variant").orderBy("start")
    joined = places.join(paths, "edge")
    goes_on = (F.lag("path").over(order) == F.col("path")) & (F.lag("turn").over(order) + 1 == F.col("turn")) & (F.lag(F.col("start") + F.col("windows")).over(order) == F.col("start"))
    joined = joined.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    joined = joined.withColumn("span", F.sum("new").over(order))
    spans = joined.groupBy("doc_id", "variant", "span").agg(F.min("start").alias("start"), (F.sum("windows") + WIDTH - 1).alias("size"), F.first("path").alias("path"))
    return apart, spans.drop("span")


def _digest(batches):
    for batch in batches:
        texts, starts, sizes = batch.column("text"), batch.column("starts"), batch.column("sizes")
        ids, out = batch.column("doc_id").to_pylist(), []
        for i, doc_id in enumerate(ids):
            words = raw(texts[i].as_py()).split()
            gone = covered(len(words), span_arrays(i, starts), span_arrays(i, sizes))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)


def remove_repeated_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept_sha256, after removing every word covered by a window of
    35 words that also starts anywhere else, in the same document too.

    Null text has no words; texts under 35 words lose none. Repeated rows are copies of each other and lose their
    windows. A null doc_id stays null. An empty table gives no rows.
    """
    apart, spans = repeated_spans(docs.select("doc_id", "text"), **options)
    return finish(apart, spans, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
