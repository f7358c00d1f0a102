"""SimHash near-duplicates: fingerprints, BK-trees over pigeonhole shards, exact check of candidates, components."""

from __future__ import annotations

from itertools import combinations
from math import acos, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garderobe.llm.common import Stash, components, packed, raw

SHARD_ROWS = 200_000
HOT_SHARD = 50_000
#: Pairs (item, node) that a walk over the trees holds at once, at most about so many.
WALK_PAIRS = 500_000
#: Differing bits of 192 beyond the expected number: the estimate scatters by about five, more for short texts. Wide,
#: since every candidate is compared exactly.
SLACK = 21
#: Candidates of one group that a task compares with each other; a larger group is cut into at most MOST_BLOCKS blocks,
#: one task key for every two, so that the rows sent stay linear in the group.
BLOCK_ROWS, MOST_BLOCKS = 128, 32
BUCKET_BYTES = 16_000_000
#: Odd multipliers that derive the further fingerprints from the same shingle hashes.
STIR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: str | None, k: int, lower: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``k`` words; a shorter text is one shingle, one without words has none."""
    data = raw(text)
    words = (data.lower() if lower else data).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n, k = len(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> np.uint64:
    """Bit by bit: 1 where over half of the hashes have it."""
    if not len(hashes):
        return np.uint64(0)
    totals = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(totals * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def _stirred(hashes: np.ndarray, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes * np.uint64(factor)
        x ^= x >> np.uint64(29)
        x *= np.uint64(STIR[0] ^ factor | 1)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, k: int, lower: bool = True, wide: bool = False) -> DataFrame:
    """(doc_id, mark, bytes, fp, fp2, fp3, bag): signed 64-bit fingerprints of the whole texts. With ``wide`` they are of
    the set of shingles and ``bag`` is a hash of that set; else fp counts repeated shingles and the others are 0. mark is
    a hash of the text and bytes its length."""

    def per_text(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 4), np.uint64)
        for i, text in enumerate(texts):
            hashes = shingle_hashes(text, k, lower)
            if wide:
                hashes = np.unique(hashes)
                out[i, 1:3] = [majority(_stirred(hashes, f)) for f in STIR]
                out[i, 3] = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
            out[i, 0] = majority(hashes)
        return pd.DataFrame(out.view(np.int64), columns=["fp", "fp2", "fp3", "bag"])

    apply = F.pandas_udf(per_text, "fp long, fp2 long, fp3 long, bag long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), size.alias("bytes"), apply("text").alias("f")).select("doc_id", "mark", "bytes", "f.*")


def grow_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree per shard, all grown level by level: (root, parent, edge) of each item; roots have parent -1.

    All items below a node arrive together; of those at one distance from it the
    first becomes the child on the edge with that distance and the others go on below the child.
    """
    n = len(fp)
    _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
    root = first[inverse]
    parent, edge, at = np.full(n, -1), np.zeros(n, np.int64), root.copy()
    open_ = np.flatnonzero(root != np.arange(n))
    while len(open_):
        d = np.bitwise_count(fp[open_] ^ fp[at[open_]]).astype(np.int64)
        _, lead, group = np.unique(at[open_] * 128 + d, return_index=True, return_inverse=True)
        child = open_[lead]
        parent[child], edge[child] = at[child], d[lead]
        at[open_] = child[group]
        open_ = open_[child[group] != open_]
    return root, parent, edge


def near_in_forest(root: np.ndarray, parent: np.ndarray, edge: np.ndarray, fp: np.ndarray, radius: int, items: np.ndarray):
    """Pairs (item, other) at ``radius`` or nearer: each item walks its own tree along edges within the radius."""
    nodes = np.flatnonzero(parent >= 0)
    key = parent[nodes] * 128 + edge[nodes]
    order = np.argsort(key, kind="stable")
    nodes, key = nodes[order], key[order]
    asked, node = items, root[items]
    while len(asked):
        d = np.bitwise_count(fp[asked] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (node < asked)
        yield asked[hit], node[hit]
        low = np.searchsorted(key, node * 128 + np.maximum(d - radius, 0))
        high = np.searchsorted(key, node * 128 + np.minimum(d + radius, 127), side="right")
        many = high - low
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        asked, node = np.repeat(asked, many), nodes[np.repeat(low, many) + offset]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each group after the links a-b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def link_shards(rows: pd.DataFrame, radius: int, widest: int | None) -> pd.DataFrame:
    """Links of the shards in one bucket, as (a, b) with b the smallest node of a's group: never all pairs."""
    rows = rows.sort_values(["shard", "node"], kind="stable")
    size = rows.groupby("shard")["node"].transform("size").to_numpy()
    rows, size = rows[size > 1], size[size > 1]
    if not len(rows):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    fp = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
    more = rows[["fp2", "fp3"]].to_numpy().astype(np.int64).view(np.uint64)
    root, parent, edge = grow_forest(rows["shard"].to_numpy(), fp)
    label = np.arange(len(fp))
    turns = np.cumsum(size) // WALK_PAIRS
    for items in np.split(label.copy(), np.flatnonzero(np.diff(turns)) + 1):
        for a, b in near_in_forest(root, parent, edge, fp, radius, items):
            if widest is not None and len(a):
                far = np.bitwise_count(fp[a] ^ fp[b]).astype(int) + np.bitwise_count(more[a] ^ more[b]).sum(axis=1, dtype=int)
                a, b = a[far <= widest], b[far <= widest]
            label = join_labels(label, a, b)
    node = rows["node"].to_numpy()
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Of ``bits`` cut into ``blocks`` runs, the masks of every choice of ``agree`` runs, as signed 64-bit values."""
    runs = [sum(1 << int(b) for b in run) for run in np.array_split(bits, blocks)]
    return [int(np.uint64(sum(map(int, pick))).view(np.int64)) for pick in combinations(runs, agree)]


def blocks_within(radius: int, agree: int = 2) -> list[tuple[int, int, int]]:
    """Shards that bring every pair within ``radius`` together: of ``radius + agree`` blocks of the fingerprint at least
    ``agree`` are equal in such a pair, so each choice of blocks is a table of shards."""
    return [(m, 0, 0) for m in _masks(list(range(64)), radius + agree, agree)]


def samples_of_bits(tables: int = 96, bits: int = 14, seed: int = 1) -> list[tuple[int, int, int]]:
    """Shards for pairs that are similar rather than within a small radius: fixed choices of ``bits`` of the 192 bits of the
    three fingerprints together, as one mask for each."""
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(192, bits, replace=False) for _ in range(tables)]
    return [tuple(int(np.uint64(sum(1 << int(b % 64) for b in own if b // 64 == c)).view(np.int64)) for c in range(3)) for own in chosen]


def near_links(classes: DataFrame, radius: int, stash: Stash, tables: list[tuple[int, int, int]] | None = None, widest: int | None = None, hot: int = HOT_SHARD) -> DataFrame:
    """Links (a, b) that connect every two of ``classes`` (node, fp, fp2, fp3) at ``radius`` or nearer that share a shard;
    with ``blocks_within(radius)``, the default, all such pairs do.

    A shard is a value of the bits that one of the ``tables`` masks in the fingerprints. Its tree stays in the task with its own items: the
    trees grow with the input and are never sent to all. A shard above ``hot`` items is cut again by ``radius + 1``
    blocks of the other bits of the first fingerprint, of which one must be equal; no item is left out.
    """
    tables = blocks_within(radius) if tables is None else tables
    shards = [F.xxhash64(F.lit(c), *[F.col(of).bitwiseAND(F.lit(m)) for of, m in zip(("fp", "fp2", "fp3"), masks, strict=True)]) for c, masks in enumerate(tables)]
    keyed = classes.select("node", "fp", "fp2", "fp3", F.posexplode(F.array(*shards)).alias("c", "shard"))
    rows = classes.count() * len(tables)
    crowded = stash.keep(keyed.groupBy("c", "shard").count().where(F.col("count") > hot).select("shard", "c"))
    if crowded.head(1):
        rest = []
        for m, _, _ in tables:
            free = [b for b in range(64) if not (m >> b) & 1]
            rest.append(F.array(*[F.lit(x) for x in _masks(free, radius + 1, 1)]))
        marked = keyed.join(crowded.select("shard", F.lit(True).alias("cut")), "shard", "left")
        pieces = F.when(F.col("cut"), F.element_at(F.array(*rest), F.col("c") + 1)).otherwise(F.array(F.lit(0).cast("long")))
        keyed = marked.select("node", "fp", "fp2", "fp3", "shard", F.posexplode(pieces).alias("j", "m"))
        keyed = keyed.withColumn("shard", F.xxhash64("shard", "j", F.col("fp").bitwiseAND(F.col("m"))))
    buckets = max(8, rows // SHARD_ROWS)
    keyed = keyed.select(F.pmod("shard", F.lit(buckets)).alias("bucket"), "shard", "node", "fp", "fp2", "fp3")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return keyed.groupBy("bucket").applyInPandas(lambda part: link_shards(part, radius, widest), schema)


def widest_for(similarity: float) -> int:
    """The number of differing bits out of 192 at which the estimated set similarity is ``similarity``."""
    return round(192 * acos(2 * similarity / (1 + similarity)) / pi)


def similar_links(sets: list[np.ndarray], prints: np.ndarray, side: np.ndarray | None, widest: int, similarity: float) -> np.ndarray:
    """Group (index of a member) of each set after the links between sets whose Jaccard similarity is ``similarity`` or more.

    Pairs within ``widest`` bits are compared exactly, nearest first; a pair that other links have joined already needs
    no comparison. With ``side`` only pairs of two sides are looked at.
    """
    label, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    for x in range(1, len(sets)):
        far = np.bitwise_count(prints[:x] ^ prints[x]).sum(axis=1, dtype=int)
        fits = (far <= widest) & (np.minimum(size[:x], size[x]) >= similarity * np.maximum(size[:x], size[x]) - 1e-6)
        if side is not None:
            fits &= side[:x] != side[x]
        others = np.flatnonzero(fits & (label[:x] != label[x]))
        others = others[np.argsort(far[others], kind="stable")]
        while len(others):
            y, others = others[0], others[1:]
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both and both / (size[x] + size[y] - both) >= similarity:
                label[label == label[x]] = label[y]
                others = others[label[others] != label[x]]
    return label


def check_bucket(rows: pa.Table, k: int, lower: bool, widest: int, similarity: float) -> pa.Table:
    """Confirmed links (a, b) of the groups, or pairs of blocks of groups, in one bucket."""
    root, i, j, block, node = (rows.column(c).to_numpy() for c in ("root", "i", "j", "block", "node"))
    prints = np.column_stack([rows.column(c).to_numpy() for c in ("fp", "fp2", "fp3")]).view(np.uint64)
    order = np.lexsort((node, j, i, root))
    key = np.column_stack([root, i, j])[order]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for own in np.split(order, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1):
        if len(own) < 2:
            continue
        sets = [np.unique(shingle_hashes(rows.column("text")[int(r)].as_py(), k, lower)) for r in own]
        side = None if i[own[0]] == j[own[0]] else block[own]
        label = similar_links(sets, prints[own], side, widest, similarity)
        moved = label != np.arange(len(label))
        a.append(node[own[moved]])
        b.append(node[own[label[moved]]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def confirmed(docs: DataFrame, classes: DataFrame, links: DataFrame, k: int, lower: bool, widest: int, similarity: float, stash: Stash) -> DataFrame:
    """Links (a, b) between those ``classes`` joined by candidate ``links`` whose shingles have a Jaccard similarity of
    ``similarity`` or more; they connect what all such pairs within ``widest`` bits would.

    One text of each class travels to the others of its group of candidates. A class is one set of shingles.
    """
    roots = stash.keep(components(links, stash))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    counts = members.groupBy("root").count().where(F.col("count") > BLOCK_ROWS)
    parts = F.least(F.ceil(F.col("count") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).cast("int")
    crowded = stash.keep(counts.select("root", parts.alias("parts")))
    members = members.join(crowded, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = stash.keep(members.join(classes, "node"))
    total = members.agg(F.sum(F.col("bytes") * F.col("parts"))).first()[0] or 0
    buckets = max(64, total // BUCKET_BYTES)
    asked = members.select("name", "mark", F.struct("node", "root", "parts", "block", "fp", "fp2", "fp3").alias("m"))
    texts = docs.select(row_name(), F.xxhash64("text").alias("mark"), "text").join(asked, ["name", "mark"])
    texts = texts.dropDuplicates(["name", "mark"]).select("m.*", "text")
    met = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    met = met.withColumn("bucket", F.pmod(F.xxhash64("root", "i", "j"), F.lit(buckets)))
    met = met.select("bucket", "root", "i", "j", "block", "node", "fp", "fp2", "fp3", "text")
    return met.groupBy("bucket").applyInArrow(lambda t: check_bucket(t, k, lower, widest, similarity), "a long, b long")


def row_name():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name")


def simhash_groups(docs: DataFrame, k: int = 5, radius: int = 22, similarity: float | None = 0.8, lower: bool = True, stash: Stash | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: groups of documents linked by near fingerprints.

    Links join fingerprints of ``k``-word shingles at ``radius`` or fewer differing bits. With a ``similarity`` the
    fingerprints only propose pairs (within SLACK bits of 192 beyond what is expected at that similarity; ``radius`` is
    then what the walk over the trees keeps) and a link needs that exact Jaccard similarity of the sets of shingles.
    component_id is the smallest doc_id that is reachable. Equal fingerprints, or equal sets of shingles, are one class
    before anything is compared. Texts without words (null, empty, blank) have the fingerprint zero and are alike. A
    null doc_id is kept as a row and never chosen as an id while a group has another; repeated rows stay repeated; an
    empty table gives no rows.
    """
    printed, placed = placed_classes(docs, k, radius, similarity, lower, stash or Stash(docs.sparkSession))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("node", "component_id")
    return printed.join(named, "node").select("doc_id", "fp", "component_id")


def placed_classes(docs: DataFrame, k: int, radius: int, similarity: float | None, lower: bool, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """(fingerprinted rows, classes with their root, smallest id and first row) of ``simhash_groups``."""
    wide = similarity is not None
    printed = stash.keep(fingerprints(docs.select("doc_id", "text"), k, lower, wide))
    printed = printed.withColumn("node", F.col("bag") if wide else F.col("fp"))
    one_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row_name(), "mark", "bytes")).alias("one")
    classes = stash.keep(printed.groupBy("node", "fp", "fp2", "fp3").agg(F.min("doc_id").alias("least"), one_row))
    one_each = classes.select("node", "fp", "fp2", "fp3")
    if wide:
        widest = widest_for(similarity) + SLACK
        links = near_links(one_each, radius, stash, samples_of_bits(), widest)
        links = confirmed(docs, classes.select("node", "fp", "fp2", "fp3", "one.name", "one.mark", "one.bytes"), links, k, lower, widest, similarity, stash)
    else:
        links = near_links(one_each, radius, stash)
    roots = components(links, stash)
    return printed, classes.join(roots, "node", "left").select("node", "least", "one", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The digest of the registered query: 4-word shingles, 4 bits, components by fingerprint links alone."""
    found = simhash_groups(docs, k=4, radius=4, similarity=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, radius: int = 22, similarity: float | None = 0.8, lower: bool = True) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, null ids last; of rows with the same id, and of
    those without one, a hash of the text decides. Rows are told apart by id and text (one of equal ones stays)."""
    stash = Stash(docs.sparkSession)
    _, placed = placed_classes(docs, k, radius, similarity, lower, stash)
    stay = stash.keep(placed.groupBy("root").agg(F.min("one").alias("one")).select("one.name", "one.mark"))
    rows = packed(docs, "doc_id", "text").select("row", row_name(), F.xxhash64("text").alias("mark"))
    return rows.join(stay, ["name", "mark"]).dropDuplicates(["name", "mark"]).select("row.*")
