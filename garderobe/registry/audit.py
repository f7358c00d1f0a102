"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.operators import audit as a
from garderobe.operators import dataset as d
from garderobe.plans import bindings as b
from garderobe.plans.audit_report import audit_and_prepare
from garderobe.registry.base import register
from garderobe.registry.common import case_map
from garderobe.registry.dataset import BASE_CTE, CSV, DISJOINT, TI, TYPED, csv_pairs
from garderobe.registry.wardrobe import r6

M = f"WITH {BASE_CTE}, looks AS (SELECT split, set_id, list(DISTINCT item_id ORDER BY item_id) AS k FROM members GROUP BY 1, 2)"


def members(spark, sf):
    return d.usable_outfits(b.outfit_items(spark, sf))


@register(
    "outfit_size_distribution",
    f"WITH {BASE_CTE} SELECT size, count(*) AS outfits FROM sizes WHERE size >= 2 GROUP BY 1",
)
def _sizes(spark, sf):
    return a.outfit_size_distribution(members(spark, sf))


@register(
    "duplicate_outfits",
    M + " SELECT split, count(*) AS outfits, count(DISTINCT k) AS distinct_outfits, count(*) - count(DISTINCT k) AS duplicates FROM looks GROUP BY 1",
)
def _dups(spark, sf):
    return a.duplicate_outfits(members(spark, sf))


def _shared(x, y):
    return (
        f"(SELECT count(*) FROM (SELECT item_id FROM members WHERE split = '{x}' INTERSECT SELECT item_id FROM members WHERE split = '{y}')) "
        f"AS items_{x}_{y}"
    )


@register(
    "split_leakage",
    M
    + " SELECT "
    + ", ".join(_shared(x, y) for x, y in a.SPLIT_PAIRS)
    + ", (SELECT count(*) FROM (SELECT k FROM looks WHERE split = 'train' INTERSECT SELECT k FROM looks WHERE split <> 'train')) AS identical_outfits, "
    "(SELECT count(*) FROM (SELECT item_id FROM members GROUP BY 1 HAVING count(DISTINCT (split, set_id)) > 1)) AS items_in_multiple_outfits",
)
def _leakage(spark, sf):
    return a.split_leakage(members(spark, sf))


@register(
    "fully_disjoint_outfits",
    f"WITH {BASE_CTE}, t AS (SELECT DISTINCT item_id FROM members WHERE split = 'train'), x AS (SELECT split, set_id, bool_or(item_id IN (FROM t)) AS hit "
    "FROM members WHERE split <> 'train' GROUP BY 1, 2) SELECT split, count(*) AS outfits, count(*) FILTER (NOT hit) AS disjoint FROM x GROUP BY 1",
)
def _fully(spark, sf):
    return a.fully_disjoint_outfits(members(spark, sf))


@register("distinct_items", f"WITH {BASE_CTE} SELECT DISTINCT item_id FROM members")
def _distinct(spark, sf):
    return a.distinct_items(members(spark, sf))


@register("unique_outfits", M + " SELECT count(DISTINCT k) AS unique_outfits FROM looks")
def _unique(spark, sf):
    return a.unique_outfits(members(spark, sf))


COARSE = f"coalesce({case_map('lower(category)', v.COARSE_SLOT)}, 'other')"
NAMED = (
    f"WITH {BASE_CTE}, named AS (SELECT item_id, coalesce(category, 'unknown') AS category FROM (SELECT DISTINCT item_id FROM members) LEFT JOIN item_cats "
    f"USING (item_id)), counts AS (SELECT category, {COARSE} AS slot, count(*) AS n FROM named GROUP BY ALL)"
)


@register("category_join", NAMED + f" SELECT item_id, category, {COARSE} AS slot FROM named")
def _named(spark, sf):
    return a.category_join(a.distinct_items(members(spark, sf)), b.item_categories(spark, sf))


@register(
    "category_distribution",
    NAMED + " SELECT category, slot, n AS n_items, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / sum(n) OVER (), 6) AS "
    "top_category_share, round(max(n) OVER () / greatest(min(n) OVER (), 1), 6) AS imbalance_ratio FROM counts",
)
def _distribution(spark, sf):
    out = a.category_distribution(a.distinct_items(members(spark, sf)), b.item_categories(spark, sf))
    return out.select("category", "slot", "n_items", *[r6(c, c) for c in ("share", "top_category_share", "imbalance_ratio")])


@register("slot_coverage", NAMED + " SELECT slot, sum(n)::BIGINT AS n_items FROM counts GROUP BY 1")
def _coverage(spark, sf):
    return a.slot_coverage(a.distinct_items(members(spark, sf)), b.item_categories(spark, sf))


@register(
    "id_checks",
    f"WITH {BASE_CTE}, u AS (SELECT DISTINCT item_id FROM members) SELECT count(*) AS unique_item_ids, count(*) FILTER (item_id NOT IN (SELECT item_id "
    "FROM item_cats WHERE category <> 'shoes')) AS items_missing_metadata FROM u",
)
def _ids(spark, sf):
    return a.id_checks(members(spark, sf), b.item_categories(spark, sf).filter(F.col("category") != "shoes"))


@register(
    "metadata_stats",
    "SELECT count(*) AS items_with_metadata, count(*) FILTER (p_size % 3 = 0 OR p_size % 5 = 0) AS items_with_text, 'brand,category,title,url_name' AS fields "
    "FROM part",
)
def _meta(spark, sf):
    size = F.col("p_size")
    def field(name, value):
        return F.struct(F.lit(name).alias("k"), value.alias("v"))

    title = F.when(size % 3 == 0, F.col("p_name")).otherwise(" ")
    some = [field("category", F.col("p_type")), field("title", title), field("brand", F.col("p_brand"))]
    pairs = F.when(size % 5 == 0, F.array(*some, field("url_name", F.col("p_name")))).otherwise(F.array(*some))
    info = F.map_from_entries(pairs)
    return a.metadata_stats(b.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("item_id"), info.alias("info")))


@register(
    "pairs_csv_stats",
    f"WITH {CSV} SELECT count(*) AS pairs, sum(label)::BIGINT AS positive_pairs, count(*) - sum(label)::BIGINT AS negative_pairs, "
    "bool_or(split IS NOT NULL) AS explicit_split_column, count(*) FILTER (final_split IS NULL) AS dropped_by_hash_split, "
    "(SELECT count(DISTINCT i) FROM (SELECT unnest([item_a, item_b]) AS i FROM csv)) AS items FROM final",
)
def _csv(spark, sf):
    return a.pairs_csv_stats(d.item_split_pairs(csv_pairs(spark, sf)))


# Documents stand for image files: equal texts are equal files, the length gives the size.
def image_table(spark, sf):
    n = F.col("n_chars")
    return b.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("item_id"),
        F.when(n % 17 == 0, -1).otherwise(n % 700 + 20).cast("int").alias("width"),
        F.when(n % 17 == 0, -1).otherwise(n % 500 + 20).cast("int").alias("height"),
        F.when(n % 17 != 0, F.sha1("text")).alias("sha1"),
        F.when(n % 17 != 0, F.substring(F.sha1(F.concat("lang", "source", (n / 4).cast("int"))), 1, 16)).alias("dhash"),
    )


IMAGES = (
    "images AS (SELECT 'd' || doc_id AS item_id, CASE WHEN n_chars % 17 = 0 THEN -1 ELSE n_chars % 700 + 20 END AS width, CASE WHEN n_chars % 17 = 0 THEN "
    "-1 ELSE n_chars % 500 + 20 END AS height, CASE WHEN n_chars % 17 <> 0 THEN sha1(text) END AS sha1, CASE WHEN n_chars % 17 <> 0 THEN "
    "lang || source || (n_chars // 4) END AS dhash FROM documents)"
)


@register(
    "image_stats",
    f"WITH {IMAGES}, w AS (SELECT 'd' || doc_id AS item_id FROM labels UNION SELECT 'd' || (doc_id + 1) FROM documents), j AS (SELECT w.item_id, width, "
    "height FROM w LEFT JOIN images USING (item_id)) SELECT count(*) AS items_checked, count(*) FILTER (width > 0) AS found_ok, count(*) FILTER "
    "(width IS NULL) AS missing, count(*) FILTER (width <= 0) AS corrupt, round(count(*) FILTER (width IS NULL OR width <= 0) / count(*), 6) AS "
    "missing_or_corrupt_rate, "
    + ", ".join(
        f"min({s}) FILTER ({s} > 0) AS {s}_min, quantile_cont({s}::DOUBLE, 0.5) FILTER ({s} > 0) AS {s}_median, max({s}) FILTER ({s} > 0) AS {s}_max"
        for s in ("width", "height")
    )
    + ", count(*) FILTER (width > 0 AND least(width, height) < 64) AS small_images FROM j",
)
def _images(spark, sf):
    doc = F.concat(F.lit("d"), "doc_id").alias("item_id")
    nxt = F.concat(F.lit("d"), F.col("doc_id") + 1).alias("item_id")
    wanted = b.table(spark, sf, "labels").select(doc).union(b.table(spark, sf, "documents").select(nxt)).distinct()
    return a.image_stats(image_table(spark, sf), wanted).withColumn("missing_or_corrupt_rate", F.round("missing_or_corrupt_rate", 6))


@register(
    "image_exact_duplicates",
    f"WITH {IMAGES}, g AS (SELECT sha1, min(item_id) AS canonical_id, count(*) AS n FROM images WHERE sha1 IS NOT NULL GROUP BY 1 HAVING count(*) > 1) "
    "SELECT item_id, sha1, canonical_id, n FROM images JOIN g USING (sha1)",
)
def _exact(spark, sf):
    return a.duplicate_members(image_table(spark, sf), "sha1")


@register(
    "image_perceptual_duplicates",
    f"WITH {IMAGES}, g AS (SELECT dhash, min(item_id) AS canonical_id, count(*) AS n FROM images WHERE dhash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) "
    "SELECT item_id, canonical_id, n FROM images JOIN g USING (dhash)",
)
def _perceptual(spark, sf):
    return a.duplicate_members(image_table(spark, sf), "dhash").drop("dhash")


@register(
    "duplicate_rates",
    f"WITH {IMAGES}, e AS (SELECT count(*) AS n FROM images WHERE sha1 IS NOT NULL GROUP BY sha1 HAVING count(*) > 1), p AS (SELECT count(*) AS n FROM images "
    "WHERE dhash IS NOT NULL GROUP BY dhash HAVING count(*) > 1) SELECT (SELECT count(*) FROM images WHERE width > 0) AS found_ok, (SELECT count(*) FROM e) AS "
    "exact_groups, (SELECT sum(n)::BIGINT FROM e) AS items_in_exact_groups, (SELECT count(*) FROM p) AS perceptual_groups, (SELECT sum(n)::BIGINT FROM p) AS "
    "items_in_perceptual_groups, (SELECT sum(n - 1) FROM p) / (SELECT count(*) FROM images WHERE width > 0) AS duplicate_image_rate",
)
def _rates(spark, sf):
    return a.duplicate_rates(image_table(spark, sf))


@register(
    "cross_split_duplicates",
    f"WITH {BASE_CTE}, r AS (SELECT item_id, max(CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) AS s FROM members GROUP BY 1), ids AS "
    "(SELECT item_id, p_name FROM item_cats JOIN part ON p_partkey = str_split(replace(item_id, 'p', '_'), '_')[-1]::BIGINT), g AS (SELECT p_name, "
    "count(DISTINCT coalesce(s, -1)) AS k FROM ids LEFT JOIN r USING (item_id) WHERE p_name IN (SELECT p_name FROM ids GROUP BY 1 HAVING count(*) > 1) GROUP BY 1) "
    "SELECT count(*) AS groups, count(*) FILTER (k > 1) AS groups_across_splits FROM g",
)
def _cross(spark, sf):
    from garderobe.registry.dataset import canonical_tables

    return a.cross_split_duplicates(members(spark, sf), canonical_tables(spark, sf)[0])


@register(
    "sample_image_ids",
    "WITH s AS (SELECT 'd' || doc_id AS item_id, row_number() OVER (ORDER BY 'd' || doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), k AS (SELECT DISTINCT "
    "floor(x.i * (n / 37.0::DOUBLE))::BIGINT AS i FROM (SELECT unnest(range(0, 37)) AS i) x, (SELECT DISTINCT n FROM s)) SELECT item_id FROM s WHERE i IN (FROM k)",
)
def _sample(spark, sf):
    return a.sample_image_ids(b.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("item_id")), 37)


LOOSE = {"min_train_outfits": 100, "min_unique_items": 100, "min_train_positive_pairs": 100, "min_valid_positive_pairs": 10, "min_test_positive_pairs": 10}


def gate_sql(thresholds: dict) -> str:
    """Facts of the audit without images, then the gate's sentences in their order."""
    t = {**v.QUALITY_THRESHOLDS, **thresholds}
    facts = [
        "(SELECT count(DISTINCT set_id) FROM members WHERE split = 'train') AS train_outfits",
        "(SELECT count(*) FROM its) AS unique_items",
        "(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM its GROUP BY category)) AS top_share",
        "(SELECT count(*) FROM (SELECT item_id FROM members GROUP BY 1 HAVING count(DISTINCT (split, set_id)) > 1)) AS reused",
        *[f"(SELECT count(*) FROM its WHERE category = '{x}') AS slot_{x}" for x in v.SLOTS],
        *[f"(SELECT count(*) FROM disjoint WHERE split = '{x}' AND label = {y}) AS {x}_{n}" for x in v.SPLITS for y, n in ((1, "positive"), (0, "negative"))],
        *[f"(SELECT count(*) FROM typed WHERE split = '{x}') - (SELECT count(*) FROM disjoint WHERE split = '{x}') AS dropped_{x}" for x in ("valid", "test")],
        *[_shared(x, y) for x, y in a.SPLIT_PAIRS],
    ]

    def absent(slots):
        return "concat_ws(', ', " + ", ".join(f"CASE WHEN slot_{x} = 0 THEN '{x}' END" for x in slots) + ")"

    def lines(rows):
        return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in rows) + "], lambda x: x IS NOT NULL), '; ')"

    failures = [
        (f"train_outfits < {t['min_train_outfits']}", f"'only ' || train_outfits || ' training outfits (need >= {t['min_train_outfits']})'"),
        (f"unique_items < {t['min_unique_items']}", f"'only ' || unique_items || ' unique items (need >= {t['min_unique_items']})'"),
    ]
    for x in v.SPLITS:
        need = t[f"min_{x}_positive_pairs"]
        failures.append((f"{x}_positive < {need}", f"'{x}: ' || {x}_positive || ' positive pairs after cleaning + item-disjoint split (need >= {need})'"))
    failures += [(f"{x}_negative = 0", f"'{x}: no negative pairs after filtering'") for x in v.SPLITS]
    failures += [
        (f"{absent(v.CORE_SLOTS)} <> ''", f"'no items in core categories: ' || {absent(v.CORE_SLOTS)}"),
        (f"top_share > {t['max_top_category_share']}", "'severe category imbalance: largest category is ' || printf('%.0f', top_share * 100) || '% of items'"),
    ]
    shared = " || ', ' || ".join(f"'{x}-{y}: ' || items_{x}_{y}" for x, y in a.SPLIT_PAIRS)
    limitations = [
        (f"{absent(v.EXTENDED_SLOTS)} <> ''", f"'no items for: ' || {absent(v.EXTENDED_SLOTS)}"),
        ("true", "'images not checked (corrupt/duplicate rates unknown)'"),
        (
            " + ".join(f"items_{x}_{y}" for x, y in a.SPLIT_PAIRS) + " > 0",
            f"'raw splits share items (' || {shared} || '); evaluation uses item-disjoint filtering (dropped valid: ' || dropped_valid || ', test: ' || dropped_test || ')'",
        ),
        ("true", "'no user/account identifiers, so user-level leakage cannot be checked'"),
        (
            "reused = 0",
            "'item ids are unique per outfit, so reuse of the same garment across outfits/splits is only detectable through image hashing (exact/dHash); "
            "different photos of the same product are not detected'",
        ),
        ("true", "'license not recorded; verify terms before redistribution'"),
    ]
    lacking = [
        (f"train_outfits < {t['min_train_outfits']}", f"'at least ' || ({t['min_train_outfits']} - train_outfits) || ' more real training outfits'"),
        (f"unique_items < {t['min_unique_items']}", f"'at least ' || ({t['min_unique_items']} - unique_items) || ' more distinct items'"),
    ]
    return (
        TYPED + TI + DISJOINT + ", its AS (SELECT item_id, coalesce(any_value(category), 'unknown') AS category FROM members LEFT JOIN item_cats USING (item_id) "
        f"GROUP BY item_id), facts AS (SELECT {', '.join(facts)}), told AS (SELECT {lines(failures)} AS failures, {lines(limitations)} AS limitations, "
        f"{lines(lacking)} AS what_is_missing FROM facts) SELECT CASE WHEN failures <> '' THEN 'INSUFFICIENT' WHEN limitations <> '' THEN "
        "'SUFFICIENT_WITH_LIMITATIONS' ELSE 'SUFFICIENT' END AS verdict, failures, limitations, what_is_missing FROM told"
    )


@register("audit_gate", gate_sql(LOOSE))
def _gate(spark, sf):
    return _told(audit_and_prepare(b.outfit_items(spark, sf), b.item_categories(spark, sf), thresholds=LOOSE).gate)


def _told(gate):
    return gate.select("verdict", *[F.array_join(c, "; ").alias(c) for c in ("failures", "limitations", "what_is_missing")])


@register("audit_gate_strict", gate_sql(v.QUALITY_THRESHOLDS))
def _strict(spark, sf):
    return _told(audit_and_prepare(b.outfit_items(spark, sf), b.item_categories(spark, sf)).gate)


@register("audit_report")
def _report(spark, sf):
    key = F.regexp_extract("item_id", r"(\d+)$", 1).cast("bigint")
    part = b.table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    images = b.item_categories(spark, sf).select("item_id", key.alias("p_partkey")).join(part, "p_partkey")
    images = images.filter(F.col("p_size") != 7).select(
        "item_id",
        F.when(F.col("p_size") == 13, -1).otherwise(F.col("p_size") + 40).alias("width"),
        F.when(F.col("p_size") == 13, -1).otherwise(F.lit(300)).alias("height"),
        F.sha1("item_id").alias("sha1"),
        F.when(F.col("p_size") != 13, F.sha1(F.concat_ws("|", "p_name", "p_size"))).alias("dhash"),
    )
    return audit_and_prepare(b.outfit_items(spark, sf), b.item_categories(spark, sf), images, LOOSE).report
