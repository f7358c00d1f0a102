"""Dataset audit: structure, leakage, categories, images and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions.lookup import coarse_slot

SPLIT_PAIRS = (("train", "valid"), ("train", "test"), ("valid", "test"))


# ------------------------------------------------------------------ outfits
def outfit_keys(members: DataFrame) -> DataFrame:
    """Order-free fingerprint of each outfit's item set: size and two independent 64-bit hash sums.

    A fingerprint instead of the sorted set keeps the row small whatever the outfit size, and combines
    before the shuffle.
    """
    one = members.select("split", "set_id", "item_id").distinct()
    return one.groupBy("split", "set_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("item_id")).alias("h1"),
        F.sum(F.xxhash64(F.lit("b"), "item_id").cast("decimal(20,0)")).alias("h2"),
    )


def outfit_size_distribution(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("split", "set_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("outfits"))


def duplicate_outfits(members: DataFrame) -> DataFrame:
    """Per split: outfits, distinct item sets, repeats inside the split."""
    keys = outfit_keys(members)
    return keys.groupBy("split").agg(
        F.count(F.lit(1)).alias("outfits"),
        F.countDistinct("n", "h1", "h2").alias("distinct_outfits"),
        (F.count(F.lit(1)) - F.countDistinct("n", "h1", "h2")).alias("duplicates"),
    )


def _spans(df: DataFrame, key: list[str]) -> DataFrame:
    """Which splits a key occurs in, one row per key."""
    return df.groupBy(*key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in v.SPLITS])


def split_leakage(members: DataFrame) -> DataFrame:
    """Shared items per split pair, identical outfits across splits, items in several outfits."""
    items = _spans(members.select("item_id", "split"), ["item_id"])
    shared = items.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"items_{a}_{b}") for a, b in SPLIT_PAIRS])
    looks = _spans(outfit_keys(members), ["n", "h1", "h2"])
    same = looks.agg(
        F.count_if((F.col("train") == 1) & ((F.col("valid") == 1) | (F.col("test") == 1))).alias("identical_outfits")
    )
    reused = (
        members.select("item_id", "split", "set_id")
        .distinct()
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("items_in_multiple_outfits"))
    )
    # Three one-row aggregates side by side.
    return shared.join(same).join(reused)


def fully_disjoint_outfits(members: DataFrame) -> DataFrame:
    """Valid and test outfits without any training item."""
    train = members.filter(F.col("split") == "train").select("item_id").distinct().withColumn("_t", F.lit(1))
    rest = members.filter(F.col("split") != "train").join(train, "item_id", "left")
    looks = rest.groupBy("split", "set_id").agg(F.count("_t").alias("_t"))
    return looks.groupBy("split").agg(F.count(F.lit(1)).alias("outfits"), F.count_if(F.col("_t") == 0).alias("disjoint"))


def distinct_items(members: DataFrame) -> DataFrame:
    return members.select("item_id").distinct()


def unique_outfits(members: DataFrame) -> DataFrame:
    return outfit_keys(members).select("n", "h1", "h2").distinct().agg(F.count(F.lit(1)).alias("unique_outfits"))


# ------------------------------------------------------------------ items
def category_join(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Category (default unknown) and slot (default other) of each item."""
    named = items.join(categories.select("item_id", "category"), "item_id", "left")
    return named.withColumn("category", F.coalesce("category", F.lit("unknown"))).withColumn("slot", coarse_slot(F.col("category")))


def category_distribution(items: DataFrame, categories: DataFrame) -> DataFrame:
    counts = category_join(items, categories).groupBy("category", "slot").agg(F.count(F.lit(1)).alias("n_items"))
    whole = counts.agg(F.sum("n_items").alias("_all"), F.max("n_items").alias("_top"), F.min("n_items").alias("_low"))
    return counts.join(whole).select(
        "category",
        "slot",
        "n_items",
        (F.col("n_items") / F.col("_all")).alias("share"),
        (F.col("_top") / F.col("_all")).alias("top_category_share"),
        (F.col("_top") / F.greatest("_low", F.lit(1))).alias("imbalance_ratio"),
    )


def slot_coverage(items: DataFrame, categories: DataFrame) -> DataFrame:
    return category_join(items, categories).groupBy("slot").agg(F.count(F.lit(1)).alias("n_items"))


def metadata_stats(meta: DataFrame) -> DataFrame:
    """``meta(item_id, info map<string,string>)``: fields seen and items with text in any text field."""
    text = F.lit(False)
    for field in ("title", "description", "url_name"):
        text = text | (F.trim(F.coalesce(F.try_element_at("info", F.lit(field)), F.lit(""))) != "")
    return meta.agg(
        F.count(F.lit(1)).alias("items_with_metadata"), F.count_if(text).alias("items_with_text")
    ).join(
        meta.select(F.explode(F.map_keys("info")).alias("f"))
        .distinct()
        .agg(F.array_join(F.sort_array(F.collect_set("f")), ",").alias("fields"))
    )


def id_checks(items: DataFrame, categories: DataFrame) -> DataFrame:
    unique = items.select("item_id").distinct()
    known = categories.select("item_id", F.lit(1).alias("_k")).distinct()
    return unique.join(known, "item_id", "left").agg(
        F.count(F.lit(1)).alias("unique_item_ids"), F.count_if(F.col("_k").isNull()).alias("items_missing_metadata")
    )


def pairs_csv_stats(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``final_split`` from the hash split."""
    rows = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("label") == 1).alias("positive_pairs"),
        F.count_if(F.col("label") == 0).alias("negative_pairs"),
        F.coalesce(F.bool_or(F.col("split").isNotNull()), F.lit(False)).alias("explicit_split_column"),
        F.count_if(F.col("final_split").isNull()).alias("dropped_by_hash_split"),
    )
    items = pairs.select(F.explode(F.array("item_a", "item_b")).alias("i")).distinct().agg(F.count(F.lit(1)).alias("items"))
    return rows.join(items)


# ------------------------------------------------------------------ images
def image_stats(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """``images(item_id, width, height, sha1, dhash)`` with width -1 for unreadable files, against wanted ids."""
    joined = wanted.select("item_id").join(images, "item_id", "left")
    ok = F.coalesce(F.col("width") > 0, F.lit(False))
    missing, corrupt = F.count_if(F.col("width").isNull()), F.count_if(F.col("width") <= 0)
    sizes = []
    for side in ("width", "height"):
        value = F.when(ok, F.col(side))
        sizes += [
            F.min(value).alias(f"{side}_min"),
            F.percentile(value, F.lit(0.5)).alias(f"{side}_median"),
            F.max(value).alias(f"{side}_max"),
        ]
    return joined.agg(
        F.count(F.lit(1)).alias("items_checked"),
        F.count_if(ok).alias("found_ok"),
        missing.alias("missing"),
        corrupt.alias("corrupt"),
        F.try_divide(missing + corrupt, F.count(F.lit(1))).alias("missing_or_corrupt_rate"),
        *sizes,
        F.count_if(ok & (F.least("width", "height") < 64)).alias("small_images"),
    )


def duplicate_members(images: DataFrame, key: str) -> DataFrame:
    """Items that share ``key`` with another item, with the group's smallest id; groups stay rows, not arrays."""
    groups = images.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("item_id").alias("canonical_id")
    )
    return images.join(groups.filter(F.col("n") > 1), key).select("item_id", key, "canonical_id", "n")


def duplicate_rates(images: DataFrame) -> DataFrame:
    """Exact (sha1) and perceptual (dhash) duplicate groups and the perceptual duplicate rate."""
    out = images.filter(F.col("width") > 0).agg(F.count(F.lit(1)).alias("found_ok"))
    for key, name in (("sha1", "exact"), ("dhash", "perceptual")):
        groups = images.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        out = out.join(
            groups.agg(
                F.count(F.lit(1)).alias(f"{name}_groups"),
                F.coalesce(F.sum("n"), F.lit(0)).alias(f"items_in_{name}_groups"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"_{name}_extra"),
            )
        )
    rate = F.coalesce(F.try_divide("_perceptual_extra", "found_ok"), F.lit(0.0))
    return out.withColumn("duplicate_image_rate", rate).drop("_exact_extra", "_perceptual_extra")


def cross_split_duplicates(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Duplicate groups touching several splits; an item's split is the last of train, valid, test that has it."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    split_of = members.groupBy("item_id").agg(F.max(rank).alias("s"))
    spread = groups.join(split_of, "item_id", "left").groupBy("canonical_id").agg(
        F.countDistinct(F.coalesce("s", F.lit(-1))).alias("n_splits")
    )
    return spread.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n_splits") > 1).alias("groups_across_splits"))


def sample_image_ids(ids: DataFrame, most: int, prefix: int = 4) -> DataFrame:
    """Deterministic systematic sample: every (n / most)-th id of the sorted list; all ids when there are fewer.

    Ids are numbered inside ranges of equal ``prefix`` characters and shifted by the sizes of the earlier
    ranges, so the sorted list never sits in one task; choose the prefix so that ranges stay moderate.
    """
    from pyspark.sql import Window

    one = ids.select("item_id").distinct()
    ranged = one.withColumn("_range", F.substring("item_id", 1, prefix))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_s"))
    total = one.agg(F.count(F.lit(1)).alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("item_id"))
    numbered = ranged.withColumn("_r", rank).join(shift, "_range").join(total)
    index = F.col("_r") - 1 + F.col("_s")
    step = F.col("_total") / F.lit(float(most))
    # Position i of the sample is floor(i * step); an index is taken when it is the floor of some multiple.
    i = F.ceil(index / step)
    taken = (F.col("_total") <= most) | ((F.floor(i * step) == index) & (i < most))
    return numbered.filter(taken).select("item_id")


# ------------------------------------------------------------------ gate
def audit_gate(facts: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Verdict of a one-row ``facts`` table: failures, limitations and what is missing.

    Columns: is_outfits, train_outfits, raw_positive_pairs, unique_items, {split}_positive, {split}_negative,
    has_categories, slot_{slot}, top_category_share, images_checked, missing_or_corrupt_rate,
    duplicate_image_rate, images_sampled, items_checked, groups_across_splits, items_{a}_{b}, dropped_valid,
    dropped_test, items_in_multiple_outfits, license.
    """
    t = {**v.QUALITY_THRESHOLDS, **(thresholds or {})}
    c, lit = F.col, F.lit

    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else lit(p) for p in parts])

    def absent(slots):
        return F.concat_ws(", ", *[F.when(c(f"slot_{s}") == 0, s) for s in slots])

    def percent(x, digits):
        return F.concat(F.format_number(x * 100, digits), lit("%"))

    outfits, known, checked = c("is_outfits"), c("has_categories"), c("images_checked")
    few_outfits = outfits & (c("train_outfits") < t["min_train_outfits"])
    few_items = c("unique_items") < t["min_unique_items"]
    cross = c("groups_across_splits")
    cross_text = text(cross.cast("string"), " duplicate-image groups span different splits (collapsed during cleaning)")
    cross_hit = checked & (cross > 0)
    cross_bad = cross / F.greatest(c("unique_items"), lit(1)) > t["max_cross_split_duplicate_rate"]
    failures = [
        F.when(few_outfits, text("only ", c("train_outfits").cast("string"), f" training outfits (need >= {t['min_train_outfits']})")),
        F.when(~outfits & (c("raw_positive_pairs") == 0), "no positive (compatible) pairs in the CSV"),
        F.when(few_items, text("only ", c("unique_items").cast("string"), f" unique items (need >= {t['min_unique_items']})")),
    ]
    for s in v.SPLITS:
        need = t[f"min_{s}_positive_pairs"]
        note = text(f"{s}: ", c(f"{s}_positive").cast("string"), f" positive pairs after cleaning + item-disjoint split (need >= {need})")
        failures.append(F.when(c(f"{s}_positive") < need, note))
    failures += [F.when(c(f"{s}_negative") == 0, f"{s}: no negative pairs after filtering") for s in v.SPLITS]
    share = c("top_category_share")
    failures += [
        F.when(known & (absent(v.CORE_SLOTS) != ""), text("no items in core categories: ", absent(v.CORE_SLOTS))),
        F.when(
            known & (share > t["max_top_category_share"]),
            text("severe category imbalance: largest category is ", percent(share, 0), " of items"),
        ),
        F.when(
            checked & (c("missing_or_corrupt_rate") > t["max_missing_or_corrupt_rate"]),
            text(percent(c("missing_or_corrupt_rate"), 1), f" of images missing/corrupt (max {t['max_missing_or_corrupt_rate']:.0%})"),
        ),
        F.when(
            checked & (c("duplicate_image_rate") > t["max_duplicate_image_rate"]),
            text("duplicate-image rate ", percent(c("duplicate_image_rate"), 1), f" (max {t['max_duplicate_image_rate']:.0%})"),
        ),
        F.when(cross_hit & cross_bad, cross_text),
    ]
    pairs = [f"items_{a}_{b}" for a, b in SPLIT_PAIRS]
    any_shared = sum((c(p) for p in pairs[1:]), c(pairs[0])) > 0
    shared = F.concat_ws(", ", *[text(f"{a}-{b}: ", c(f"items_{a}_{b}").cast("string")) for a, b in SPLIT_PAIRS])
    limitations = [
        F.when(known & (absent(v.EXTENDED_SLOTS) != ""), text("no items for: ", absent(v.EXTENDED_SLOTS))),
        F.when(~known, "no category metadata: hard negatives and per-category evaluation are impossible"),
        F.when(checked & c("images_sampled"), text("images audited on a sample of ", c("items_checked").cast("string"), " items")),
        F.when(cross_hit & ~cross_bad, cross_text),
        F.when(~checked, "images not checked (corrupt/duplicate rates unknown)"),
        F.when(
            any_shared,
            text("raw splits share items (", shared, "); evaluation uses item-disjoint filtering (dropped valid: ",
                 c("dropped_valid").cast("string"), ", test: ", c("dropped_test").cast("string"), ")"),
        ),
        lit("no user/account identifiers, so user-level leakage cannot be checked"),
        F.when(
            outfits & (c("items_in_multiple_outfits") == 0),
            "item ids are unique per outfit, so reuse of the same garment across outfits/splits is only detectable through "
            "image hashing (exact/dHash); different photos of the same product are not detected",
        ),
        F.when(
            F.coalesce(c("license"), lit("")).isin("", "unknown"), "license not recorded; verify terms before redistribution"
        ),
    ]
    lacking = [
        F.when(few_outfits, text("at least ", (lit(t["min_train_outfits"]) - c("train_outfits")).cast("string"), " more real training outfits")),
        F.when(few_items, text("at least ", (lit(t["min_unique_items"]) - c("unique_items")).cast("string"), " more distinct items")),
    ]
    out = facts.select(
        F.array_compact(F.array(*failures)).alias("failures"),
        F.array_compact(F.array(*limitations)).alias("limitations"),
        F.array_compact(F.array(*lacking)).alias("what_is_missing"),
    )
    verdict = F.when(F.size("failures") > 0, "INSUFFICIENT").when(F.size("limitations") > 0, "SUFFICIENT_WITH_LIMITATIONS")
    return out.withColumn("verdict", verdict.otherwise("SUFFICIENT"))
