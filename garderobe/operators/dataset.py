"""Labelled pair datasets from observed outfits: positives, negatives, splits, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions.lookup import hash_int, hash_unit
from garderobe.operators.spread import hash_join, numbered, pair_join
from garderobe.session import cut_lineage

#: Last attempt of each wave of draws; what is still empty afterwards is reported, not dropped silently.
WAVES = (20, 80, 320)
#: Counted draws up to this number go to the tables they are looked up in, instead of the tables to them.
FEW_TRIES = 200_000


# ------------------------------------------------------------------ outfits
def usable_outfits(outfit_items: DataFrame) -> DataFrame:
    """Members of outfits with at least two items."""
    sizes = outfit_items.groupBy("split", "set_id").agg(F.count(F.lit(1)).alias("size"))
    return outfit_items.join(sizes.filter(F.col("size") >= 2), ["set_id", "split"])


def prepare_outfits(raw: DataFrame, usable_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep usable items of raw outfits, drop outfits left with fewer than two, renumber, and count.

    ``raw(split, set_id, ord, item_id)``; returns the members with ``pos`` from 1 and counts per split.
    """
    kept = usable_outfits(raw.join(usable_ids.select("item_id").distinct(), "item_id", "left_semi"))
    members = numbered(kept, ["split", "set_id"], ["ord"], "pos", ["set_id"], buckets=1).drop("size")
    before = raw.groupBy("split").agg(F.countDistinct("set_id").alias("raw_outfits"), F.count(F.lit(1)).alias("raw_items"))
    after = kept.groupBy("split").agg(
        F.countDistinct("set_id").alias("retained_outfits"), F.count(F.lit(1)).alias("retained_items")
    )
    return members, before.join(after, "split", "left").fillna(0)


# ------------------------------------------------------------------ pairs
def positive_pairs(outfit_items: DataFrame) -> DataFrame:
    """Every pair of items seen in one outfit, in list order. A very large outfit is spread over pair blocks."""
    members = outfit_items.select("split", "set_id", "ord", "item_id")
    pairs = pair_join(
        members,
        members,
        ["set_id", "split"],
        ["item_id"],
        lambda a, b: a("ord") < b("ord"),
        select=lambda a, b: [a("item_id").alias("item_a"), b("item_id").alias("item_b")],
    )
    return pairs.select(
        "split", "set_id", "item_a", "item_b", F.lit(1).alias("label"), F.lit("observed_positive").alias("kind")
    )


def _ends(a: str = "item_a", b: str = "item_b") -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def _draw(seed: int, tag: str, n: Column) -> Column:
    """0-based index below ``n`` from (seed, tag, split, slot, attempt)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), "split", "slot", "attempt")
    return F.pmod(hash_int(text, 15), n)


def _drawn(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


def _without(rows: DataFrame, seen: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` whose keys are not in ``seen``; for few rows only what they name in ``seen`` is moved."""
    if few:
        rows = cut_lineage(rows)
        seen = seen.select(*keys).join(F.broadcast(rows.select(*keys)), keys, "left_semi")
    return hash_join(rows, seen, keys, "left_anti")


class PairSampler:
    """Constructed negatives, as many as observed pairs. All draws are hashes, so any partitioning agrees.

    Positives, outfits and category pools get dense numbers, a draw is an index, and a drawn row is found by
    an equi-join on (split, number): no pool is ever collected and no key is hot. Totals (a row per split, or per split and
    category) are broadcast, so that no join has a split as its key.
    """

    def __init__(self, outfit_items: DataFrame, categories: DataFrame | None, seed: int = 42, usable: bool = False):
        """``usable``: ``outfit_items`` are written :func:`usable_outfits` already."""
        self.seed = seed
        self.members = outfit_items if usable else cut_lineage(usable_outfits(outfit_items))
        positives = cut_lineage(positive_pairs(self.members))  # read for the numbers and for the bucket sizes
        numbered_pairs = numbered(positives, ["split"], ["set_id", "item_a", "item_b"], "idx", ["set_id", "item_a"])
        self.positives = cut_lineage(numbered_pairs)
        self.observed = self.positives.select("split", *_ends())
        self.totals = self.positives.groupBy("split").agg(F.count(F.lit(1)).alias("n_pos"))
        self.categories = categories
        self._pool: tuple[DataFrame, DataFrame] | None = None

    def _slots(self, neg_per_pos: int, hard_ratio: float) -> DataFrame:
        """One row per wanted negative, with its kind."""
        rows = self.positives.select("split", "idx").join(F.broadcast(self.totals), "split")
        slots = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(neg_per_pos - 1)))).select(
            "split", "n_pos", (F.col("idx") - 1 + F.col("_j") * F.col("n_pos")).alias("slot")
        )
        share = hard_ratio if self.categories is not None else 0.0
        n_hard = F.floor(F.col("n_pos") * neg_per_pos * F.lit(float(share)))
        return slots.withColumn("hard", F.col("slot") < n_hard)

    def _outfits(self) -> tuple[DataFrame, DataFrame]:
        sets = self.members.select("split", "set_id", "size").distinct()
        outfits = cut_lineage(numbered(sets, ["split"], ["set_id"], "oidx", ["set_id"]))
        inside = numbered(self.members, ["split", "set_id"], ["ord"], "pos", ["set_id"], buckets=1)
        return outfits, cut_lineage(inside.select("split", "set_id", "pos", "item_id"))

    def _swaps(self) -> tuple[DataFrame, DataFrame]:
        """Sizes of the category pools and their numbered items, written once for all attempts."""
        if self._pool is None:
            known = self.categories.select("item_id", "category")
            category = F.coalesce("category", F.lit("unknown")).alias("category")
            pool = cut_lineage(
                hash_join(self.members.select("split", "set_id", "item_id"), known, ["item_id"], "left").select("split", "set_id", "item_id", category)
            )
            sizes = pool.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n_pool")).filter(F.col("n_pool") > 1)
            indexed = numbered(pool, ["split", "category"], ["item_id", "set_id"], "_pidx", ["item_id", "set_id"])
            self._pool = cut_lineage(sizes), cut_lineage(indexed.select("split", "category", "_pidx", "item_id"))
        return self._pool

    def random_negatives(self, tries: DataFrame, outfits: DataFrame, inside: DataFrame, check: bool = True) -> DataFrame:
        """Items of two different outfits; with ``check``, never an observed pair or an item of a's outfit."""
        rows = self._random(tries, outfits, inside, check)
        return self._unobserved(rows) if check else rows

    def _random(self, tries: DataFrame, outfits: DataFrame, inside: DataFrame, check: bool, few: bool = False) -> DataFrame:
        n_out = outfits.groupBy("split").agg(F.count(F.lit(1)).alias("n_out")).filter(F.col("n_out") > 1)
        rows = tries.join(F.broadcast(n_out), "split").withColumn("_ia", _draw(self.seed, "oa", F.col("n_out")))
        step = F.lit(1) + _draw(self.seed, "ob", F.col("n_out") - 1)
        rows = rows.withColumn("_ib", F.pmod(F.col("_ia") + step, F.col("n_out")))
        for side in ("a", "b"):
            named = outfits.select(
                "split", (F.col("oidx") - 1).alias(f"_i{side}"), F.col("set_id").alias(f"set_{side}"), F.col("size").alias(f"_n{side}")
            )
            rows = _drawn(rows, few).join(named, [f"_i{side}", "split"])
            rows = rows.withColumn(f"_p{side}", _draw(self.seed, f"p{side}", F.col(f"_n{side}")) + 1)
        for side in ("a", "b"):
            spot = inside.select(
                "split", F.col("set_id").alias(f"set_{side}"), F.col("pos").alias(f"_p{side}"), F.col("item_id").alias(f"item_{side}")
            )
            rows = _drawn(rows, few).join(spot, [f"set_{side}", f"_p{side}", "split"])
        if check:
            rows = rows.filter(F.col("item_a") != F.col("item_b"))
            worn = inside.select("split", F.col("set_id").alias("set_a"), F.col("item_id").alias("item_b"))
            rows = _without(rows, worn, ["set_a", "item_b", "split"], few)
        return rows.select("split", "slot", "attempt", "item_a", "item_b")

    def hard_negatives(self, tries: DataFrame, check: bool = True) -> DataFrame:
        """An observed pair with b replaced by an item of the same category."""
        rows = self._hard(tries, check)
        return self._unobserved(rows) if check else rows

    def _hard(self, tries: DataFrame, check: bool, few: bool = False) -> DataFrame:
        sizes, indexed = self._swaps()
        known = self.categories.select(F.col("item_id").alias("_was"), F.coalesce("category", F.lit("unknown")).alias("category"))
        base = self.positives.select("split", F.col("idx").alias("_base"), "item_a", F.col("item_b").alias("_was"))
        rows = tries.withColumn("_base", _draw(self.seed, "base", F.col("n_pos")) + 1)
        rows = _drawn(rows, few).join(base, ["_base", "split"])
        rows = hash_join(rows, known, ["_was"], "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
        rows = rows.join(F.broadcast(sizes), ["split", "category"]).withColumn("_pidx", _draw(self.seed, "swap", F.col("n_pool")) + 1)
        swap = indexed.select("split", "category", "_pidx", F.col("item_id").alias("item_b"))
        rows = _drawn(rows, few).join(swap, ["_pidx", "category", "split"])
        rows = rows.filter(F.col("item_a") != F.col("item_b")) if check else rows.filter(F.col("item_b") != F.col("_was"))
        return rows.select("split", "slot", "attempt", "item_a", "item_b")

    def _unobserved(self, rows: DataFrame, few: bool = False) -> DataFrame:
        low, high = _ends()
        named = rows.withColumn("lo", low).withColumn("hi", high)
        return _without(named, self.observed, ["split", "lo", "hi"], few).drop("lo", "hi")

    def negatives(self, neg_per_pos: int = 1, hard_ratio: float = 0.5, check: bool = True) -> DataFrame:
        """First attempt for every slot, further waves of attempts only for the few slots that are still empty.

        :meth:`unfilled` counts the slots that no wave could fill (as when every pair of a split was observed).
        """
        slots = self._slots(neg_per_pos, hard_ratio)
        outfits, inside = self._outfits()

        def attempt(tries: DataFrame, few: bool = False) -> DataFrame:
            drawn = self._random(tries.filter(~F.col("hard")), outfits, inside, check, few).withColumn("kind", F.lit("random_negative"))
            if self.categories is not None:
                swapped = self._hard(tries.filter("hard"), check, few).withColumn("kind", F.lit("hard_negative"))
                drawn = drawn.unionByName(swapped)
            return self._unobserved(drawn, few) if check else drawn

        first = cut_lineage(attempt(slots.withColumn("attempt", F.lit(0))))
        left = slots.join(first.select("split", "slot"), ["slot", "split"], "left_anti")
        cols = ["split", "slot", "item_a", "item_b", "kind"]
        chosen, start = first.select(*cols), 1
        for end in WAVES:
            left = cut_lineage(left)
            n_left = left.count()
            if n_left == 0:
                break
            tries = left.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
            again = attempt(tries, n_left * (end - start) <= FEW_TRIES)
            best = again.groupBy("split", "slot").agg(F.min(F.struct("attempt", "item_a", "item_b", "kind")).alias("_x"))
            more = cut_lineage(best.select("split", "slot", "_x.item_a", "_x.item_b", "_x.kind"))
            chosen = chosen.unionByName(more)
            left, start = left.join(more.select("split", "slot"), ["slot", "split"], "left_anti"), end
        self.left = left
        return chosen.withColumn("label", F.lit(0))

    def unfilled(self) -> DataFrame:
        """After :meth:`negatives`: per split and kind, how many wanted negatives could not be drawn."""
        kind = F.when(F.col("hard"), "hard_negative").otherwise("random_negative").alias("kind")
        return self.left.groupBy("split", kind).agg(F.count(F.lit(1)).alias("unfilled"))

    def typed_pairs(self, neg_per_pos: int = 1, hard_ratio: float = 0.5, check: bool = True) -> DataFrame:
        """Positives and negatives with their kind, read from written tables."""
        cols = ["split", "item_a", "item_b", "label", "kind"]
        return self.positives.select(*cols).unionByName(self.negatives(neg_per_pos, hard_ratio, check).select(*cols))


def label_kinds(pairs: DataFrame) -> DataFrame:
    kind = F.when(F.col("label") == 1, "labelled_positive").otherwise("labelled_negative")
    return pairs.withColumn("kind", kind)


def fake_outfits(members: DataFrame, categories: DataFrame, seed: int = 42) -> DataFrame:
    """Every member replaced by a hash-drawn item of the same category, drawn from all distinct items."""
    known = members.join(categories.select("item_id", "category"), "item_id", "left").withColumn(
        "category", F.coalesce("category", F.lit("unknown"))
    )
    pool = known.select("category", "item_id").distinct()
    sizes = pool.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    indexed = numbered(pool, ["category"], ["item_id"], "_idx", ["item_id"])
    text = F.concat_ws(":", F.lit(f"{seed}:fake"), "split", "set_id", "item_id")
    return (
        known.join(sizes, "category")
        .withColumn("_idx", F.pmod(hash_int(text, 15), F.col("_n")) + 1)
        .join(indexed.select("category", "_idx", F.col("item_id").alias("fake_id")), ["category", "_idx"])
        .select("split", "set_id", "ord", "category", F.col("item_id").alias("real_id"), F.col("fake_id").alias("item_id"))
    )


# ------------------------------------------------------------------ splits
def item_split(item: Column, valid_share: float = 0.1, test_share: float = 0.1, seed: int = 42) -> Column:
    u = hash_unit(F.concat(F.lit(f"{seed}:"), item))
    return F.when(u < test_share, "test").when(u < test_share + valid_share, "valid").otherwise("train")


def item_split_pairs(pairs: DataFrame, valid_share: float = 0.1, test_share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``final_split``: an explicit split wins; else the hash split both items agree on, or null (dropped)."""
    a, b = (item_split(F.col(c), valid_share, test_share, seed) for c in ("item_a", "item_b"))
    return pairs.withColumn("_a", a).withColumn("_b", b).withColumn(
        "final_split", F.coalesce("split", F.when(F.col("_a") == F.col("_b"), F.col("_a")))
    ).drop("_a", "_b")


def pair_items(pairs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    both = F.explode(F.array("item_a", "item_b")).alias("item_id")
    return pairs.select(*extra, both).distinct()


def item_disjoint_filter(pairs: DataFrame, written: bool = False) -> DataFrame:
    """Valid loses pairs with a training item; test loses pairs with a training or surviving valid item.

    The pairs are written once: the three splits and their item sets read the table instead of building it again. With
    ``written`` the caller's pairs come from written tables, as those of :meth:`PairSampler.typed_pairs`, and are read as they are.
    """
    pairs = pairs if written else cut_lineage(pairs)

    def without(rows: DataFrame, seen: DataFrame) -> DataFrame:
        for c in ("item_a", "item_b"):
            rows = hash_join(rows, seen.select(F.col("item_id").alias(c)), [c], "left_anti")
        return rows

    train = pairs.filter(F.col("split") == "train")
    trained = cut_lineage(pair_items(train))
    valid = cut_lineage(without(pairs.filter(F.col("split") == "valid"), trained))
    seen = trained.unionByName(pair_items(valid))
    test = without(pairs.filter(F.col("split") == "test"), seen)
    cols = pairs.columns
    return train.select(*cols).unionByName(valid.select(*cols)).unionByName(test.select(*cols))


def disjoint_report(pairs: DataFrame, written: bool = False) -> DataFrame:
    """Pairs per split before and after :func:`item_disjoint_filter`."""
    pairs = pairs if written else cut_lineage(pairs)
    after = item_disjoint_filter(pairs, written=True).groupBy("split").agg(F.count(F.lit(1)).alias("kept"))
    before = pairs.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        before.join(after, "split", "left").fillna(0, ["kept"]).withColumn("dropped", F.col("pairs") - F.col("kept"))
    )


def apply_canonical(pairs: DataFrame, canonical: DataFrame, bad: DataFrame) -> DataFrame:
    """Replace items by their duplicate group's canonical id; drop bad items and pairs of one item."""
    out = pairs
    for c in ("item_a", "item_b"):
        named = canonical.select(F.col("item_id").alias(c), F.col("canonical_id").alias(f"_{c}"))
        out = hash_join(out, named, [c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        out = hash_join(out, bad.select(F.col("item_id").alias(c)), [c], "left_anti")
    return out.filter(F.col("item_a") != F.col("item_b")).select(*pairs.columns)


def split_stats(pairs: DataFrame, written: bool = False) -> DataFrame:
    """Items, positives, negatives and pairs per kind of each split; ``written`` as in :func:`item_disjoint_filter`."""
    pairs = pairs if written else cut_lineage(pairs)  # read for the counts and for the items
    counts = pairs.groupBy("split").agg(
        F.count_if(F.col("label") == 1).alias("positive_pairs"),
        F.count_if(F.col("label") == 0).alias("negative_pairs"),
        *[F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in v.PAIR_KINDS],
    )
    items = pair_items(pairs, ["split"]).groupBy("split").agg(F.count(F.lit(1)).alias("items"))
    return counts.join(items, "split")


def unseen_item_check(pairs: DataFrame) -> DataFrame:
    """Number of test items that also occur in training pairs; must be zero after the disjoint filter."""
    pairs = cut_lineage(pairs.filter(F.col("split").isin("train", "test")))
    train = pair_items(pairs.filter(F.col("split") == "train"))
    test = pair_items(pairs.filter(F.col("split") == "test"))
    return test.intersect(train).agg(F.count(F.lit(1)).alias("test_items_seen_in_training"))


# ------------------------------------------------------------------ vectors
def valid_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the encoder's length without missing or infinite entries."""
    from garderobe.functions.vectors import all_finite

    return vectors.filter((F.size("vector") == dim) & all_finite(F.col("vector")))


def pair_embeddings(pairs: DataFrame, vectors: DataFrame, dim: int, how: str = "inner") -> DataFrame:
    """Both vectors of every pair as ``va`` and ``vb``; pairs missing one are dropped or kept with ``how='left'``."""
    good = valid_vectors(vectors, dim)
    for c, name in (("item_a", "va"), ("item_b", "vb")):
        pairs = hash_join(pairs, good.select(F.col("item_id").alias(c), F.col("vector").alias(name)), [c], how)
    return pairs


def missing_embedding_rate(pairs: DataFrame, vectors: DataFrame, dim: int, limit: float = 0.05) -> DataFrame:
    """Per split, pairs lacking a vector; only ids are joined, no vector is moved."""
    have = valid_vectors(vectors, dim).select("item_id").distinct()
    for c in ("item_a", "item_b"):
        pairs = hash_join(pairs, have.select(F.col("item_id").alias(c), F.lit(True).alias(f"_{c}")), [c], "left")
    lacking = F.col("_item_a").isNull() | F.col("_item_b").isNull()
    rate = F.avg(lacking.cast("double"))
    return pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(lacking).alias("missing"),
        rate.alias("missing_rate"),
        (rate > limit).alias("over_limit"),
    )
