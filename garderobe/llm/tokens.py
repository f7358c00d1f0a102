"""Token sequences in training order: a keyed permutation gives every sequence its slot, shards have a fixed stride."""

from __future__ import annotations

import base64
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.common import Stash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern and the end token that belong to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 512
PER_SHARD = 4096
KEY = 20_240_601
ROUNDS = 6


def slots(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. total - 1 chosen by ``key``: a Feistel network on the next even number of bits; a value
    beyond the range goes through it again until it falls inside."""
    half = np.uint64(max(1, ((total - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    seeds = np.random.SeedSequence(key).generate_state(ROUNDS, np.uint64)

    def once(x):
        left, right = x >> half, x & mask
        for seed in seeds:
            f = (right + seed) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(31)) & mask)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(total))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def load(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids): the tokens of whole texts and one end token as 16-bit numbers; ``before``
    counts the sequences of the same input partition ahead of the row."""
    with open(vocabulary, "rb") as f:  # read once on the driver, sent to the tasks: under a megabyte
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoding, part, before = load(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, rows = batch.column("text"), []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = encoding.encode_ordinary(texts[i].as_py() or "")
                ids.append(END)
                rows.append((part, before, doc_id, len(ids), np.array(ids, np.uint16).tobytes()))
                before += -(-len(ids) // length)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "before", "doc_id", "n_tokens", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "part long, before long, doc_id long, n_tokens long, ids binary")


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """(slot, shard, place, doc_id, piece, n_tokens, ids) of every sequence, sorted by slot within its shard.

    A document and its end token are cut into sequences of ``length``; the last is filled up with end tokens and
    n_tokens says how many of its tokens count, so the pieces of a document give back its text. Sequences are numbered
    densely by input partition, so the same table cut into other partitions has another order; a Feistel permutation of
    that range makes the slot. Slot s is at place
    s % per_shard of shard s // per_shard, and every ``ids`` has 2 * length bytes: a reader finds any slot by
    arithmetic and goes on from there. Null and empty texts are one sequence with the end token alone; repeated rows
    give repeated sequences; a null id stays null; an empty table gives no rows.
    """
    stash = Stash(docs.sparkSession)
    made = stash.keep(tokenised(docs, vocabulary, length))
    pieces = F.ceil(F.col("n_tokens") / length)
    parts = made.groupBy("part").agg(F.max(F.col("before") + pieces).alias("n")).orderBy("part").collect()  # one row for each input partition
    offsets = dict(zip([r["part"] for r in parts], accumulate([0, *[r["n"] for r in parts]]), strict=False))
    total = sum(r["n"] for r in parts)

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            numbers = []
            for part, before, doc_id, blob in zip(*[batch.column(c).to_pylist() for c in ("part", "before", "doc_id", "ids")], strict=True):
                n = len(blob) // 2
                for piece in range(-(-n // length)):
                    ids = blob[2 * length * piece : 2 * length * (piece + 1)]
                    numbers.append(offsets[part] + before + piece)
                    out[0].append(doc_id)
                    out[1].append(piece)
                    out[2].append(len(ids) // 2)
                    out[3].append(ids + np.full(length - len(ids) // 2, END, np.uint16).tobytes())
            slot = slots(np.array(numbers, np.int64), total, key)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(slot), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["slot", "doc_id", "piece", "n_tokens", "ids"])

    shards = max(1, -(-total // per_shard))
    placed = made.select("part", "before", "doc_id", "ids").mapInArrow(cut, "slot long, doc_id long, piece int, n_tokens int, ids binary")
    placed = placed.withColumn("shard", F.expr(f"slot div {per_shard}")).withColumn("place", (F.col("slot") % per_shard).cast("int"))
    placed = placed.repartitionByRange(shards, "shard").sortWithinPartitions("slot")
    return placed.select("slot", "shard", "place", "doc_id", "piece", "n_tokens", "ids")


def write_shards(ordered: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order; a lost task writes its shards again under the same names."""
    ordered.write.partitionBy("shard").parquet(path)


def write_strides(ordered: DataFrame, path: str) -> None:
    """Write ``training_order`` as one row (shard, first, count, tokens) for each shard: the sequences' bytes one after
    another in slot order, so that slot s begins at byte (s - first) * stride of ``tokens``. Shards are ranges of slots; a
    lost task writes its shards again. The last shard may be shorter."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")  # one shard: a fixed number of sequences of fixed length
        blob = b"".join(x.as_py() for x in table.column("ids"))
        values = {"shard": table.column("shard")[0].as_py(), "first": table.column("slot")[0].as_py(), "count": table.num_rows, "tokens": blob}
        return pa.Table.from_pylist([values], pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("tokens", pa.binary())]))

    shards = ordered.select("shard", "slot", "ids").groupBy("shard").applyInArrow(join, "shard long, first long, count long, tokens binary")
    shards.write.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, per_shard: int = PER_SHARD, shards: int | None = None) -> DataFrame:
    """(slot, ids) from ``slot`` on, of as many shards as asked for (null: all that follow). Only the shard that holds the
    slot and the next ones are read; within it the place follows from the fixed stride."""
    first = slot // per_shard
    held = spark.read.parquet(path).where((F.col("shard") >= first) & (F.lit(True) if shards is None else F.col("shard") < first + shards))

    def cut(batches):
        for batch in batches:
            for begin, count, blob in zip(batch.column("first").to_pylist(), batch.column("count").to_pylist(), batch.column("tokens"), strict=True):
                data = blob.as_py()
                stride, skip = len(data) // count, max(0, slot - begin)
                ids = [data[i * stride : (i + 1) * stride] for i in range(skip, count)]
                yield pa.RecordBatch.from_arrays([pa.array(range(begin + skip, begin + count), pa.int64()), pa.array(ids, pa.binary())], ["slot", "ids"])

    return held.orderBy("shard").select("first", "count", "tokens").mapInArrow(cut, "slot long, ids binary")
