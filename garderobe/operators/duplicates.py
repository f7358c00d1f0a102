"""Near-identical items: copies are collapsed before any pair is looked at, results stay linear in the input."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from garderobe import vocab as v
from garderobe.functions import boxes, vectors
from garderobe.operators.spread import pair_join
from garderobe.session import cut_lineage

LEAD = 16


def distinct_vectors(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct vector and key: the earliest item, the number of copies, the vector."""
    return (
        items.filter(F.col("embedding").isNotNull())
        .groupBy(*keys, "embedding")
        .agg(F.min(F.struct("created_at", "item_id")).alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("rep_id", F.col("rep.item_id"))
        .withColumns({f"_e{i}": c for i, c in enumerate(vectors.leading(F.col("embedding"), LEAD))})
    )


def near_vectors(left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float, ordered: bool) -> DataFrame:
    """Pairs of distinct vectors with cosine >= threshold. Far pairs are dropped inside the join."""

    def on(a, b):
        lead_a, lead_b = ([side(f"_e{i}") for i in range(LEAD)] for side in (a, b))
        near = vectors.may_be_near(lead_a, lead_b, threshold)
        return ((a("rep") < b("rep")) & near) if ordered else near

    pairs = pair_join(
        left,
        right,
        keys,
        ["rep_id"],
        on,
        select=lambda a, b: [
            a("rep").alias("a"),
            b("rep").alias("b"),
            a("copies").alias("a_copies"),
            b("copies").alias("b_copies"),
            a("embedding").alias("va"),
            b("embedding").alias("vb"),
        ],
    )
    near = pairs.withColumn("cosine", vectors.dot("va", "vb")).filter(F.col("cosine") >= threshold)
    return near.drop("va", "vb", "_bi", "_bj")


def find_duplicates(
    items: DataFrame, keys: Sequence[str] = ("wardrobe_id", "category"), threshold: float = v.DUPLICATE_COSINE
) -> DataFrame:
    """Items with a near-identical twin: how many there are, and the earliest one stored before the item.

    Copies of one vector are counted, not paired, so a group of n copies costs n rows.
    """
    keys = list(keys)
    reps = distinct_vectors(items, keys)
    near = near_vectors(reps, reps, keys, threshold, ordered=True)
    both = near.select(*keys, F.col("a").alias("rep"), F.col("b").alias("other"), F.col("b_copies").alias("n")).unionByName(
        near.select(*keys, F.col("b").alias("rep"), F.col("a").alias("other"), F.col("a_copies").alias("n"))
    )
    around = both.groupBy(*keys, F.col("rep.item_id").alias("rep_id")).agg(
        F.sum("n").alias("_near"), F.min("other").alias("_first")
    )
    groups = reps.select(*keys, "embedding", "rep", "rep_id", "copies").join(around, [*keys, "rep_id"], "left")
    groups = groups.filter((F.col("copies") > 1) | F.col("_near").isNotNull())
    own = F.struct("created_at", "item_id")
    before = F.array_min(
        F.filter(F.array("rep", "_first"), lambda r: r.isNotNull() & (r < F.col("_own")))
    )
    return (
        items.join(groups, [*keys, "embedding"])
        .withColumn("_own", own)
        .withColumn("duplicate_of", before["item_id"])
        .select(
            *keys,
            "item_id",
            (F.col("copies") - 1 + F.coalesce("_near", F.lit(0))).alias("n_duplicates"),
            "duplicate_of",
        )
    )


def flag_duplicates(
    new: DataFrame, stored: DataFrame, keys: Sequence[str] = ("wardrobe_id", "category"), threshold: float = v.DUPLICATE_COSINE
) -> DataFrame:
    """New items with the number of stored twins and the earliest of them (null when there is none)."""
    keys = list(keys)
    fresh, old = distinct_vectors(new, keys), distinct_vectors(stored, keys)
    hits = near_vectors(fresh, old, keys, threshold, ordered=False)
    found = hits.groupBy(*keys, F.col("a.item_id").alias("rep_id")).agg(
        F.sum("b_copies").alias("possible_duplicates"), F.min("b").alias("first_twin")
    )
    marked = fresh.select(*keys, "embedding", "rep_id").join(found, [*keys, "rep_id"])
    return new.join(
        marked.select(*keys, "embedding", "possible_duplicates", "first_twin", F.col("first_twin.item_id").alias("possible_duplicate_of")),
        [*keys, "embedding"],
        "left",
    ).withColumn("possible_duplicates", F.coalesce("possible_duplicates", F.lit(0)))


def flag_earlier(batch: DataFrame, keys: Sequence[str] = ("wardrobe_id", "category"), threshold: float = v.DUPLICATE_COSINE) -> DataFrame:
    """Per item of a batch, its twins before it in order of (created_at, item_id): how many, and the first of them.

    Copies of one vector are numbered, not paired: an item counts the earlier items of each distinct vector near its
    own. A window holds the items around one distinct vector of one batch.
    """
    keys = list(keys)
    reps = cut_lineage(distinct_vectors(batch, keys))
    near = near_vectors(reps, reps, keys, threshold, ordered=True)
    both = near.select(*keys, F.col("a.item_id").alias("own"), F.col("b.item_id").alias("rep_id")).unionByName(
        near.select(*keys, F.col("b.item_id").alias("own"), F.col("a.item_id").alias("rep_id"))
    ).unionByName(reps.select(*keys, F.col("rep_id").alias("own"), "rep_id"))
    placed = batch.join(reps.select(*keys, "embedding", "rep_id"), [*keys, "embedding"]).select(*keys, "rep_id", F.struct("created_at", "item_id").alias("at"))
    around = both.join(placed, [*keys, "rep_id"]).select(*keys, "own", (F.col("own") == F.col("rep_id")).alias("mine"), "at")
    order = Window.partitionBy(*keys, "own").orderBy("at")
    ranked = around.withColumn("n", F.row_number().over(order) - 1).withColumn("first", F.min("at").over(order))
    return ranked.filter("mine AND n > 0").select(*keys, F.col("at.item_id").alias("item_id"), F.col("n").cast("bigint").alias("earlier"), F.col("first").alias("first_earlier"))


def sign_planes(dim: int, count: int, seed: int = 42) -> np.ndarray:
    """``count`` directions of random signs; entry (p, i) is +1 when the hash of "seed:plane:p:i" is even."""
    text = (f"{seed}:plane:{p}:{i}" for p in range(count) for i in range(dim))
    odd = np.fromiter((int(hashlib.sha1(t.encode()).hexdigest()[:8], 16) % 2 for t in text), dtype=np.int64, count=count * dim)
    return (1.0 - 2.0 * odd).reshape(count, dim)


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` signs so that a pair exactly at ``threshold`` shares one with probability ``recall``."""
    same_sign = 1 - math.acos(threshold) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same_sign**bits)))


def sign_codes(tables: int, bits: int, seed: int):
    """Column function: one code of ``bits`` signs per table for a vector; zeros for an empty one."""

    def codes(vecs: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
        out = np.zeros((len(vecs), tables), dtype=np.int64)
        for size in {int(x) for x in sizes if x > 0}:
            rows = np.flatnonzero(sizes == size)
            flat = vecs.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            signs = flat.astype(float).reshape(-1, size) @ planes(size).T >= 0
            out[rows] = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
        ends = pa.array(np.arange(0, out.size + 1, tables), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    known: dict[int, np.ndarray] = {}

    def planes(size: int) -> np.ndarray:
        if size not in known:
            known[size] = sign_planes(size, tables * bits, seed)
        return known[size]

    codes.__annotations__ = {"vecs": pa.Array, "return": pa.Array}
    return F.arrow_udf(codes, ArrayType(LongType())).asNondeterministic()


#: Distinct vectors of the largest key that share one code of signs when ``bits`` is not given, if spread evenly.
BUCKET_VECTORS = 64


def lsh_duplicates(
    items: DataFrame,
    keys: Sequence[str] = ("wardrobe_id", "category"),
    threshold: float = v.DUPLICATE_COSINE,
    recall: float = 0.99,
    bits: int | None = None,
    tables: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Approximate variant for keys too large for exact pair blocks: equal bands of signs, then the exact test.

    Candidates share the key and the signs of ``bits`` random projections in one of the tables; both are equalities,
    so items of different keys never meet. Bits grow with the largest key, and tables follow from ``recall``, the
    probability that a pair at the threshold is found (closer pairs are likelier). Only codes and numbers travel to the
    join; a pair is formed in the first table that it shares, and vectors are fetched for these pairs alone. Large
    buckets are cut into blocks. Every reported pair passes the exact test. Rows with a == b stand for equal vectors.
    Items without a vector are left out; vectors of different lengths are no pair.
    """
    keys = list(keys)
    numbered = distinct_vectors(items, keys).select(*keys, "rep", "rep_id", "copies", "embedding", F.monotonically_increasing_id().alias("_n"))
    reps = cut_lineage(numbered)
    if bits is None:
        largest = reps.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
        bits = min(40, max(6, math.ceil(math.log2(largest / BUCKET_VECTORS))))
    tables = tables_for(threshold, bits, recall) if tables is None else tables
    codes = sign_codes(tables, bits, seed)
    coded = cut_lineage(reps.select(*keys, "rep", "_n", F.size("embedding").alias("_dim"), codes("embedding").alias("_codes")))
    bands = coded.select("*", F.posexplode("_codes").alias("_table", "_code"))

    def first_shared(a, b):
        agree = F.zip_with(a("_codes"), b("_codes"), lambda x, y: x == y)
        return (a("rep") < b("rep")) & (F.array_position(agree, True) == a("_table") + 1)

    met = pair_join(
        bands, bands, [*keys, "_dim", "_table", "_code"], ["_n"], first_shared, select=lambda a, b: [a("_n").alias("_a"), b("_n").alias("_b")]
    ).select("_a", "_b")

    def side(name: str, extra: Sequence[str] = ()) -> DataFrame:
        return reps.select(*extra, F.col("_n").alias(f"_{name}"), F.col("rep_id").alias(name), F.col("copies").alias(f"_c{name}"), F.col("embedding").alias(f"_v{name}"))

    near = met.join(side("a", keys), "_a").join(side("b"), "_b").withColumn("cosine", vectors.dot("_va", "_vb"))
    hits = near.filter(F.col("cosine") >= threshold).select(*keys, "a", "b", "cosine", (F.col("_ca") * F.col("_cb")).alias("n_pairs"))
    copies = reps.filter(F.col("copies") > 1).select(
        *keys,
        F.col("rep_id").alias("a"),
        F.col("rep_id").alias("b"),
        F.lit(1.0).alias("cosine"),
        (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("n_pairs"),
    )
    return hits.unionByName(copies)


def connected_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest reachable node per node of ``edges(keys, a, b)``; one checkpointed pass per round.

    Labels move to the neighbourhood minimum and then jump to their own label's label, so a chain of n nodes
    needs about log n rounds. Rounds end when no label moves; labels only ever fall, so they do end.
    """
    keys = list(keys)
    both = cut_lineage(
        edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("peer"))
        .unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("peer")))
        .distinct()
    )
    labels = cut_lineage(both.groupBy(*keys, "node").agg(F.least(F.min("peer"), F.col("node")).alias("label")))
    if labels.limit(1).count() == 0:
        return labels
    while True:
        offered = both.join(labels.select(*keys, F.col("node").alias("peer"), F.col("label").alias("_l")), [*keys, "peer"])
        lowest = offered.groupBy(*keys, "node").agg(F.min("_l").alias("_l"))
        jump = labels.select(*keys, F.col("node").alias("_to"), F.col("label").alias("_next"))
        moved = (
            labels.join(lowest, [*keys, "node"])
            .withColumn("_to", F.least("label", "_l"))
            .join(jump, [*keys, "_to"], "left")
            .select(*keys, "node", F.col("label").alias("_old"), F.least("_to", "_next").alias("label"))
        )
        moved = cut_lineage(moved)
        labels = moved.select(*keys, "node", "label")
        if moved.filter(F.col("_old") != F.col("label")).limit(1).count() == 0:
            return labels


def duplicate_groups(
    items: DataFrame, keys: Sequence[str] = ("wardrobe_id", "category"), threshold: float = v.DUPLICATE_COSINE
) -> DataFrame:
    """Every item with the id of its near-duplicate group: the earliest item of the connected component."""
    keys = list(keys)
    reps = distinct_vectors(items, keys)
    edges = near_vectors(reps, reps, keys, threshold, ordered=True).select(*keys, "a", "b")
    roots = connected_components(edges, keys).select(
        *keys, F.col("node.item_id").alias("rep_id"), F.col("label.item_id").alias("_root")
    )
    linked = reps.join(roots, [*keys, "rep_id"], "left").select(
        *keys, "embedding", F.coalesce("_root", "rep_id").alias("_group")
    )
    return items.join(linked, [*keys, "embedding"], "left").withColumn("group_id", F.coalesce("_group", "item_id")).drop("_group")


def item_conflicts(items: DataFrame, threshold: float = v.DUPLICATE_COSINE) -> DataFrame:
    """Per item, how many others of the wardrobe may not join it in an outfit, by cause.

    ``same_image``: near-identical vectors of any slot. ``same_region``: boxes of one photo with IoU >= 0.5.
    Equal vectors and equal boxes are collapsed first and only counted.
    """
    twins = find_duplicates(items, ["wardrobe_id"], threshold).select(
        "wardrobe_id", "item_id", F.col("n_duplicates").alias("same_image")
    )
    place = ["wardrobe_id", "source_image"]
    spots = (
        items.filter((F.col("source_image") != "") & F.col("bbox").isNotNull())
        .groupBy(*place, "bbox")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_box", boxes.box_text(F.col("bbox")))
    )
    overlaps = pair_join(
        spots,
        spots,
        place,
        ["_box"],
        lambda a, b: boxes.box_iou(a("bbox"), b("bbox")) >= v.SAME_REGION_IOU,
        select=lambda a, b: [a("bbox").alias("bbox"), b("n").alias("n")],
    )
    around = overlaps.groupBy(*place, "bbox").agg((F.sum("n") - 1).alias("same_region")).filter(F.col("same_region") > 0)
    regions = items.join(around, [*place, "bbox"]).select("wardrobe_id", "item_id", "same_region")
    zero = F.lit(0)
    return twins.join(regions, ["wardrobe_id", "item_id"], "full").select(
        "wardrobe_id",
        "item_id",
        F.coalesce("same_image", zero).cast("bigint").alias("same_image"),
        F.coalesce("same_region", zero).cast("bigint").alias("same_region"),
    )
