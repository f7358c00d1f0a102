"""Item-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import colour, lookup, scores, style, vectors
from garderobe.operators import wardrobe as w
from garderobe.operators.item_table import ItemTable
from garderobe.plans import bindings as b
from garderobe.registry.base import register
from garderobe.registry.common import NEUTRAL_SQL, case_map, values, with_items
from garderobe.streaming.ingest import work_path

MODEL, DIM = b.ENCODER, b.ENCODER_DIM


def r6(c, name):
    return F.round(c, 6).alias(name)


@register(
    "scan_items",
    with_items("SELECT wardrobe_id, item_id, category, label, review_status, confidence, created_at FROM items"),
)
def _scan(spark, sf):
    return w.scan_items(b.items(spark, sf)).select(
        "wardrobe_id", "item_id", "category", "label", "review_status", "confidence", "created_at"
    )


@register("get_item", with_items("SELECT wardrobe_id, item_id, category, label FROM items WHERE item_id = 'it42'"))
def _get(spark, sf):
    return w.get_item(b.item_base(spark, sf), "it42").select("wardrobe_id", "item_id", "category", "label")


@register(
    "count_by_category",
    with_items("SELECT wardrobe_id, category, count(*) AS n_items FROM items GROUP BY ALL"),
)
def _counts(spark, sf):
    return w.count_by_category(b.item_base(spark, sf))


@register(
    "review_summary",
    with_items(
        "SELECT wardrobe_id, category, count(*) AS n_items, count(*) FILTER (review_status = 'needs_review') AS n_review "
        "FROM items GROUP BY ALL"
    ),
)
def _review(spark, sf):
    return w.review_summary(b.item_base(spark, sf))


@register(
    "slot_pools",
    with_items("SELECT wardrobe_id, category, item_id FROM items WHERE reason IS NULL"),
)
def _pools(spark, sf):
    return w.slot_pools(b.item_base(spark, sf), MODEL, DIM).select("wardrobe_id", "category", "item_id")


@register(
    "exclusion_reason",
    with_items(
        "SELECT item_id, CASE WHEN review_status = 'needs_review' THEN 'needs review (uncertain detection)' END "
        "AS exclusion FROM items"
    ),
)
def _exclusion(spark, sf):
    return b.item_base(spark, sf).select(
        "item_id", w.exclusion_reason(F.col("category"), F.col("review_status")).alias("exclusion")
    )


@register("eligible_items", with_items("SELECT item_id, health, reason FROM items"))
def _eligible(spark, sf):
    return w.eligible_items(b.item_base(spark, sf), MODEL, DIM).select("item_id", "health", "reason")


@register(
    "eligibility_summary",
    with_items(
        "SELECT wardrobe_id, category, coalesce(reason, 'eligible') AS state, count(*) AS n_items FROM items GROUP BY ALL"
    ),
)
def _eligibility(spark, sf):
    return w.eligibility_summary(b.item_base(spark, sf), MODEL, DIM)


@register(
    "embedding_health", with_items("SELECT wardrobe_id, health, count(*) AS n_items FROM items GROUP BY ALL")
)
def _health(spark, sf):
    return w.with_health(b.item_base(spark, sf), MODEL, DIM).groupBy("wardrobe_id", "health").agg(
        F.count(F.lit(1)).alias("n_items")
    )


@register("embedding_queue", with_items("SELECT wardrobe_id, item_id, health FROM items WHERE health <> 'ok'"))
def _queue(spark, sf):
    return w.embedding_queue(b.item_base(spark, sf), MODEL, DIM)


@register(
    "not_embedded",
    "SELECT 'it' || p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)",
)
def _not_embedded(spark, sf):
    ids = b.table(spark, sf, "part").select(F.concat(F.lit("it"), "p_partkey").alias("item_id"))
    done = b.table(spark, sf, "embeddings").select(F.concat(F.lit("it"), "vec_id").alias("item_id"))
    return w.not_embedded(ids, done)


@register(
    "search_items",
    with_items(
        "SELECT item_id, category, label, color, style FROM items WHERE category = 'top' "
        "AND (lower(color) = 'navy' OR lower(color2) = 'navy' OR lower(color) = 'navy') "
        "UNION ALL SELECT item_id, category, label, color, style FROM items WHERE lower(label) = 'small ring' "
        "UNION ALL SELECT item_id, category, label, color, style FROM items WHERE lower(coalesce(style, '')) = 'formal' "
        "UNION ALL SELECT item_id, category, label, color, style FROM items "
        "WHERE contains(lower(concat_ws(' ', category, label, color, style)), 'red')"
    ),
)
def _search(spark, sf):
    items = b.items(spark, sf)
    found = [
        w.search_items(items, category="top", color="Navy"),
        w.search_items(items, label="SMALL RING"),
        w.search_items(items, style_name="Formal"),
        w.search_items(items, text="red"),
    ]
    cols = ["item_id", "category", "label", "color", "style"]
    out = found[0].select(*cols)
    for f in found[1:]:
        out = out.unionByName(f.select(*cols))
    return out


@register(
    "gallery_filter",
    with_items(
        "SELECT item_id, category, label, color FROM items WHERE review_status = 'needs_review' "
        "AND contains(lower(concat_ws(' ', label, category, color, style, item_id)), 'bl')"
    ),
)
def _gallery(spark, sf):
    return w.gallery_filter(b.items(spark, sf), "needs_review", " BL ").select("item_id", "category", "label", "color")


SLOT_POS = case_map("category", {s: i for i, s in enumerate(v.SLOTS)}, "99")


@register(
    "sort_gallery",
    with_items(
        f"SELECT wardrobe_id, item_id, row_number() OVER (PARTITION BY wardrobe_id ORDER BY {SLOT_POS}, seq) AS position "
        "FROM items"
    ),
)
def _sort(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("wardrobe_id").orderBy(*w.gallery_order("category"))
    return w.sort_gallery(
        b.item_base(spark, sf).withColumn("position", F.row_number().over(order)), "category"
    ).select("wardrobe_id", "item_id", "position")


@register(
    "page_items",
    with_items(
        "SELECT wardrobe_id, item_id, position, pages FROM (SELECT *, row_number() OVER (PARTITION BY wardrobe_id ORDER BY "
        "coalesce(confidence, 0) DESC, seq) AS position, ceil(count(*) OVER (PARTITION BY wardrobe_id) / 4.0)::BIGINT "
        "AS pages FROM items) WHERE position BETWEEN 5 AND 8"
    ),
)
def _page(spark, sf):
    return w.page_items(b.item_base(spark, sf), 2, 4, "score").select("wardrobe_id", "item_id", "position", "pages")


COUNTS = values(list(v.DEMO_COUNTS.items()))


@register(
    "stratified_pick",
    with_items(
        f", demo(category, n) AS (VALUES {COUNTS}) SELECT category, item_id, pick FROM (SELECT category, item_id, row_number() "
        "OVER (PARTITION BY category ORDER BY sha1('7:' || item_id), item_id) AS pick FROM items) JOIN demo USING (category) "
        "WHERE pick <= n"
    ),
)
def _pick(spark, sf):
    picked, _ = w.stratified_pick(b.item_base(spark, sf), v.DEMO_COUNTS, seed=7)
    return picked.select("category", "item_id", "pick")


@register(
    "stratified_pick_shortage",
    with_items(
        ", c AS (SELECT category, count(*) AS n FROM items GROUP BY ALL) SELECT category, (90 - n)::BIGINT AS missing FROM c "
        "WHERE 90 > n"
    ),
)
def _shortage(spark, sf):
    return w.stratified_pick(b.item_base(spark, sf), {s: 90 for s in v.SLOTS})[1]


@register(
    "sample_top_categories",
    with_items(
        ", big AS (SELECT category FROM items GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 5) "
        "SELECT category, item_id, pick FROM (SELECT category, item_id, row_number() OVER (PARTITION BY category "
        "ORDER BY sha1('42:' || item_id), item_id) AS pick FROM items) WHERE pick <= 6 AND category IN (FROM big)"
    ),
)
def _top_categories(spark, sf):
    return w.sample_top_categories(b.item_base(spark, sf)).select("category", "item_id", "pick")


def _files(spark, sf):
    p = b.table(spark, sf, "part").filter(F.col("p_size") % 7 != 0)
    return p.select(
        (F.col("p_partkey") % 20).alias("wardrobe_id"), F.concat(F.lit("img/"), "p_partkey", F.lit(".jpg")).alias("path")
    )


FILES = ", files AS (SELECT p_partkey % 20 AS wardrobe_id, 'img/' || p_partkey || '.jpg' AS path FROM part WHERE p_size % 7 <> 0)"


def _pathed(spark, sf):
    return b.item_base(spark, sf).withColumn("image_path", F.concat(F.lit("img/"), "seq", F.lit(".jpg")))


@register(
    "wardrobe_diagnostics",
    with_items(
        FILES + ", o AS (SELECT wardrobe_id, count(*) AS orphan_files FROM files WHERE path NOT IN (SELECT 'img/' || seq || "
        "'.jpg' FROM items) GROUP BY 1) SELECT i.wardrobe_id, count(*) AS n_items, "
        + ", ".join(f"count(*) FILTER (category = '{s}') AS n_{s}" for s in v.SLOTS)
        + ", "
        + ", ".join(
            f"count(*) FILTER (health = '{s}') AS vectors_{s}" for s in ("ok", "missing", "stale", "corrupt")
        )
        + ", count(*) FILTER ('img/' || seq || '.jpg' NOT IN (SELECT path FROM files)) AS missing_images, "
        "0::BIGINT AS bad_categories, coalesce(any_value(o.orphan_files), 0)::BIGINT AS orphan_files "
        "FROM items i LEFT JOIN o USING (wardrobe_id) GROUP BY i.wardrobe_id"
    ),
)
def _diagnostics(spark, sf):
    return w.wardrobe_diagnostics(_pathed(spark, sf), _files(spark, sf), MODEL, DIM)


@register(
    "orphan_files",
    with_items(FILES + " SELECT wardrobe_id, path FROM files WHERE path NOT IN (SELECT 'img/' || seq || '.jpg' FROM items)"),
)
def _orphans(spark, sf):
    return w.orphan_files(_pathed(spark, sf), _files(spark, sf)).select("wardrobe_id", "path")


@register(
    "missing_files",
    with_items(FILES + " SELECT item_id FROM items WHERE 'img/' || seq || '.jpg' NOT IN (SELECT path FROM files)"),
)
def _missing(spark, sf):
    return w.missing_files(_pathed(spark, sf), _files(spark, sf)).select("item_id")


SHORT = ("item_id", "category", "label", "review_status", "style")


def _edits(spark, sf):
    p, size = b.table(spark, sf, "part"), F.col("p_size")
    return p.select(
        F.concat(F.lit("it"), "p_partkey").alias("item_id"),
        F.when(size % 6 == 0, "shoes").alias("category"),
        F.when(size % 5 == 0, "formal").alias("style"),
        F.when(size % 4 == 0, F.concat(F.lit(" Best "), "p_name")).alias("label"),
    )


@register(
    "edit_items",
    with_items(
        "SELECT item_id, CASE WHEN p_size % 6 = 0 THEN 'shoes' ELSE category END AS category, "
        "CASE WHEN p_size % 4 = 0 THEN lower('best ' || label) WHEN p_size % 6 = 0 AND category <> 'shoes' THEN 'shoes' "
        "ELSE label END AS label, CASE WHEN p_size % 6 = 0 THEN 'confirmed' ELSE review_status END AS review_status, "
        "CASE WHEN p_size % 5 = 0 THEN 'formal' ELSE style END AS style, "
        "CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE style_scores[3] END AS formal_score FROM items"
    ),
)
def _edit(spark, sf):
    return w.edit_items(b.items(spark, sf), _edits(spark, sf)).select(
        *SHORT, style.style_of(F.col("style_scores"), "formal").alias("formal_score")
    )


@register(
    "confirm_items",
    with_items(
        "SELECT item_id, CASE WHEN p_size % 20 = 0 THEN 'confirmed' ELSE review_status END AS review_status FROM items"
    ),
)
def _confirm(spark, sf):
    ids = _edits(spark, sf).join(
        b.table(spark, sf, "part")
        .filter(F.col("p_size") % 20 == 0)
        .select(F.concat(F.lit("it"), "p_partkey").alias("item_id")),
        "item_id",
        "left_semi",
    )
    return w.confirm_items(b.item_base(spark, sf), ids).select("item_id", "review_status")


@register(
    "update_items",
    with_items(
        "SELECT item_id, CASE WHEN p_size % 6 = 0 THEN 'shoes' ELSE category END AS category, "
        "CASE WHEN p_size % 4 = 0 THEN ' Best ' || label ELSE label END AS label FROM items"
    ),
)
def _update(spark, sf):
    return w.update_items(b.item_base(spark, sf), _edits(spark, sf).drop("style")).select("item_id", "category", "label")


@register(
    "delete_items",
    with_items(
        "SELECT category, count(*) AS n_left FROM items WHERE NOT (review_status = 'needs_review') GROUP BY ALL "
        "UNION ALL SELECT 'deleted', count(*) FROM items WHERE review_status = 'needs_review'"
    ),
)
def _delete(spark, sf):
    items = b.item_base(spark, sf)
    left, gone = w.delete_items(items, items.filter(F.col("review_status") == "needs_review").select("item_id"))
    return (
        left.groupBy("category")
        .agg(F.count(F.lit(1)).alias("n_left"))
        .unionByName(gone.select(F.lit("deleted").alias("category"), F.col("deleted").alias("n_left")))
    )


@register("clear_items", with_items("SELECT count(*) AS deleted, 0::BIGINT AS n_left FROM items"))
def _clear(spark, sf):
    empty, gone = w.clear_items(b.item_base(spark, sf))
    return gone.join(empty.agg(F.count(F.lit(1)).alias("n_left")))


@register(
    "write_items",
    with_items(
        "SELECT item_id, label FROM items UNION ALL SELECT 'it' || p_partkey, p_name FROM part "
        "WHERE 'it' || p_partkey NOT IN (SELECT item_id FROM items)"
    ),
)
def _write(spark, sf):
    stored = b.item_base(spark, sf).select("item_id", "label")
    new = b.table(spark, sf, "part").select(F.concat(F.lit("it"), "p_partkey").alias("item_id"), F.col("p_name").alias("label"))
    return w.write_items(stored, new, strict=False)


# ------------------------------------------------------------------ the stored table
STORED = ("wardrobe_id", "item_id", "category", "label", "review_status", "embedding")


def _stored(spark, sf):
    return ItemTable.create(b.item_base(spark, sf).select(*STORED), work_path(spark, "item-table"), buckets=8, slices=4)


@register(
    "item_table_update",
    with_items(
        "SELECT wardrobe_id, item_id, CASE WHEN wardrobe_id IN (3, 7) AND p_size % 6 = 0 THEN 'shoes' ELSE category END AS "
        "category, CASE WHEN wardrobe_id IN (3, 7) AND p_size % 4 = 0 THEN ' Best ' || label ELSE label END AS label, "
        "len(embedding)::INT AS dim FROM items"
    ),
)
def _table_update(spark, sf):
    table = _stored(spark, sf)
    table.update(_edits(spark, sf).drop("style").join(table.read().filter("wardrobe_id IN (3, 7)").select("wardrobe_id", "item_id"), "item_id"))
    return table.read().select("wardrobe_id", "item_id", "category", "label", F.array_size("embedding").alias("dim"))


@register(
    "item_table_edit",
    with_items(
        "SELECT item_id, CASE WHEN p_size % 6 = 0 THEN 'shoes' ELSE category END AS category, "
        "CASE WHEN p_size % 4 = 0 THEN lower('best ' || label) WHEN p_size % 6 = 0 AND category <> 'shoes' THEN 'shoes' "
        "ELSE label END AS label, CASE WHEN p_size % 6 = 0 THEN 'confirmed' ELSE review_status END AS review_status "
        "FROM items WHERE wardrobe_id = 4"
    ),
)
def _table_edit(spark, sf):
    table = ItemTable.create(b.items(spark, sf), work_path(spark, "item-table"), buckets=8, slices=4)
    table.edit(_edits(spark, sf))
    return table.wardrobe(4).select("item_id", "category", "label", "review_status")


@register(
    "item_table_delete",
    with_items(
        ", gone AS (SELECT *, wardrobe_id = 5 OR review_status = 'needs_review' AS out FROM items) SELECT wardrobe_id, "
        "count(*) AS n_left FROM gone WHERE NOT out GROUP BY ALL UNION ALL SELECT -1, count(*) FROM gone WHERE out"
    ),
)
def _table_delete(spark, sf):
    table = _stored(spark, sf)
    gone = table.delete(table.read().filter("wardrobe_id = 5 OR review_status = 'needs_review'"))
    left = table.read().groupBy("wardrobe_id").agg(F.count(F.lit(1)).alias("n_left"))
    return left.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("wardrobe_id"), F.lit(gone).cast("bigint").alias("n_left")))


@register(
    "item_table_write",
    with_items(
        "SELECT wardrobe_id, item_id, label FROM items UNION ALL SELECT p_partkey % 20, 'it' || p_partkey, p_name FROM part "
        "WHERE 'it' || p_partkey NOT IN (SELECT item_id FROM items)"
    ),
)
def _table_write(spark, sf):
    table = _stored(spark, sf)
    key, none = F.col("p_partkey"), F.lit(None)
    new = b.table(spark, sf, "part").select(
        (key % 20).alias("wardrobe_id"), F.concat(F.lit("it"), key).alias("item_id"), none.cast("string").alias("category"),
        F.col("p_name").alias("label"), F.lit("auto").alias("review_status"), none.cast("array<double>").alias("embedding"),
    )
    table.insert(new, strict=False)
    return table.read().select("wardrobe_id", "item_id", "label")


# ------------------------------------------------------------------ scalar functions over items
@register(
    "item_labels",
    with_items(
        "SELECT item_id, label AS shown, color || ' ' || label AS display_name, '#' || substr(item_id, 1, 4) AS short_id "
        "FROM items"
    ),
)
def _labels(spark, sf):
    c = F.col
    return b.item_base(spark, sf).select(
        "item_id",
        lookup.item_label(c("label"), c("category")).alias("shown"),
        lookup.display_name(c("color"), c("label"), c("category")).alias("display_name"),
        lookup.short_id(c("item_id")).alias("short_id"),
    )


@register(
    "review_status",
    with_items(
        "SELECT item_id, CASE WHEN p_size % 4 = 0 OR (p_size % 3 = 0 AND p_size % 2 = 0) THEN 'confirmed' "
        "WHEN p_size % 2 = 0 THEN 'needs_review' ELSE 'auto' END AS status FROM items"
    ),
)
def _status(spark, sf):
    s = F.col("p_size")
    return b.item_base(spark, sf).select(
        "item_id", w.review_status(s % 2 == 0, s % 4 == 0, s % 3 == 0).alias("status")
    )


@register(
    "style_scores",
    with_items(
        "SELECT item_id, style, "
        + ", ".join(f"style_scores[{i + 1}] AS s{i}" for i in range(7))
        + " FROM items"
    ),
)
def _style_scores(spark, sf):
    return b.items(spark, sf).select(
        "item_id", "style", *[F.get("style_scores", F.lit(i)).alias(f"s{i}") for i in range(7)]
    )


@register(
    "style_by_wardrobe",
    with_items(
        "SELECT wardrobe_id, style AS top_style, count(*) AS n_items, round(avg(list_max(style_scores)), 6) AS mean_peak "
        "FROM items GROUP BY ALL"
    ),
)
def _style_by(spark, sf):
    return (
        b.items(spark, sf)
        .groupBy("wardrobe_id", style.top_style(F.col("style_scores")).alias("top_style"))
        .agg(F.count(F.lit(1)).alias("n_items"), r6(F.avg(F.array_max("style_scores")), "mean_peak"))
    )


AFF = "[" + ", ".join(str(x) for x in v.OCCASION_AFFINITY["date"]) + "]"
_CTX = (
    "CASE WHEN style_scores IS NOT NULL THEN least(1.0, style_scores[3] / list_max(style_scores)) END AS style_match, "
    f"list_sum(list_transform(range(1, 8), lambda i: style_scores[i] * {AFF}[i])) / list_sum(style_scores) AS occasion_match"
)


@register(
    "item_context",
    with_items(
        f", c AS (SELECT item_id, {_CTX} FROM items) SELECT item_id, round(style_match, 6) AS style_match, "
        "round(occasion_match, 6) AS occasion_match, round((style_match + occasion_match) / 2, 6) AS context FROM c"
    ),
)
def _context(spark, sf):
    s = F.col("style_scores")
    return b.items(spark, sf).select(
        "item_id",
        r6(style.style_match(s, "formal"), "style_match"),
        r6(style.occasion_match(s, "date"), "occasion_match"),
        r6(style.item_context(s, "formal", "date"), "context"),
    )


@register(
    "user_style_scores",
    with_items(
        "SELECT item_id, "
        + ", ".join(f"(coalesce(style, 'casual') = '{s}')::INT::DOUBLE AS s{i}" for i, s in enumerate(v.STYLES))
        + " FROM items"
    ),
)
def _user_style(spark, sf):
    one = style.user_style_scores(F.coalesce("style", F.lit("casual")))
    return b.items(spark, sf).select("item_id", one.alias("s")).select(
        "item_id", *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(7)]
    )


@register(
    "l2_normalize",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: 9.0 * z * z))), 6) AS norm3, "
    "round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first "
    "FROM embeddings",
)
def _normalize(spark, sf):
    e = b.table(spark, sf, "embeddings").withColumn("big", F.transform("embedding", lambda z: z.cast("double") * 3.0))
    return e.select(
        "vec_id", r6(vectors.norm(F.col("big")), "norm3"), r6(F.get(vectors.l2_normalize(F.col("big")), F.lit(0)), "first")
    )


@register(
    "slot_lookups",
    f"SELECT p_partkey, {case_map('lower(p_type)', {k.lower(): s for k, s in b.TYPE_SLOT.items()}, 'NULL')} AS by_type, "
    f"{case_map('split_part(p_name, chr(32), 2)', v.LABEL_SLOT)} AS by_label, "
    f"{case_map('split_part(p_name, chr(32), 2) || chr(115)', v.CATALOG_SLOT)} AS by_catalog, "
    f"coalesce({case_map('lower(split_part(p_name, chr(32), 2) || chr(115))', v.COARSE_SLOT)}, 'other') AS by_coarse FROM part",
)
def _slots(spark, sf):
    word = F.element_at(F.split("p_name", " "), 2)
    return b.table(spark, sf, "part").select(
        "p_partkey",
        lookup.lookup({k: s for k, s in b.TYPE_SLOT.items()}, F.upper(F.trim(F.col("p_type")))).alias("by_type"),
        lookup.slot_for_label(F.concat(F.lit(" "), F.upper(word))).alias("by_label"),
        lookup.fashion_slot(F.concat(word, F.lit("s"))).alias("by_catalog"),
        lookup.coarse_slot(F.concat(word, F.lit("s"))).alias("by_coarse"),
    )


@register(
    "labels_for_slot",
    with_items(
        f", vocab(label, slot) AS (VALUES {values(list(v.LABEL_SLOT.items()))}) "
        "SELECT slot, v.label, count(i.item_id) AS n_items FROM vocab v LEFT JOIN items i ON i.category = v.slot GROUP BY ALL"
    ),
)
def _labels_for_slot(spark, sf):
    words = lookup.labels_for_slot(spark)
    counts = b.item_base(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, F.col("slot") == F.col("category"), "left").select(
        "slot", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items")
    )





@register(
    "colour_attributes",
    with_items(
        "SELECT item_id, color, round((0.2126 * ('0x' || substr(hex, 2, 2))::INT + 0.7152 * ('0x' || substr(hex, 4, 2))::INT "
        f"+ 0.0722 * ('0x' || substr(hex, 6, 2))::INT) / 255, 6) AS lightness, color IN {NEUTRAL_SQL} AS neutral FROM items"
    ),
)
def _colours(spark, sf):
    first = F.get("colors", F.lit(0))
    return b.item_base(spark, sf).select(
        "item_id",
        colour.primary_color(F.col("colors")).alias("color"),
        r6(colour.lightness(first["hex"]), "lightness"),
        first["name"].isin(*v.NEUTRALS).alias("neutral"),
    )


@register(
    "rgb_to_name",
    """
    WITH px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 37 % 256 AS r, l_suppkey * 91 % 256 AS g,
        (l_partkey + 3 * l_orderkey) % 256 AS b FROM lineitem),
    n AS (SELECT r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px),
    m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM n),
    f AS (SELECT *, (v - r) / d AS fr, (v - g) / d AS fg, (v - b) / d AS fb FROM m),
    hs AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, (CASE WHEN d = 0 THEN 0 WHEN r = v THEN fb - fg
        WHEN g = v THEN 2.0::DOUBLE + fr - fb ELSE 4.0::DOUBLE + fg - fr END) / 6.0::DOUBLE AS h0 FROM f),
    hsv AS (SELECT v, s, (CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END) * 360.0::DOUBLE AS h FROM hs),
    named AS (SELECT CASE
      WHEN v < 0.2 AND v >= 0.08 AND s >= 0.55 AND h >= 195 AND h < 255 THEN 'navy'
      WHEN v < 0.2 AND v >= 0.08 AND s >= 0.55 AND (h < 12 OR h >= 345) THEN 'burgundy'
      WHEN v < 0.2 THEN 'black'
      WHEN s < 0.12 OR (s < 0.2 AND v < 0.4) THEN CASE WHEN v > 0.85 THEN 'white' ELSE 'gray' END
      WHEN h >= 18 AND h < 60 AND s < 0.4 AND v > 0.5 THEN 'beige'
      WHEN h >= 8 AND h < 45 AND v < 0.62 THEN 'brown'
      WHEN h >= 45 AND h < 80 AND v < 0.55 THEN 'olive'
      WHEN h < 12 OR h >= 345 THEN CASE WHEN v < 0.45 THEN 'burgundy' WHEN s < 0.45 AND v > 0.75 THEN 'pink' ELSE 'red' END
      WHEN h < 40 THEN 'orange' WHEN h < 68 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 195 THEN 'teal'
      WHEN h < 255 THEN CASE WHEN v < 0.45 THEN 'navy' WHEN s < 0.45 AND v > 0.7 THEN 'light blue' ELSE 'blue' END
      WHEN h < 290 THEN 'purple' ELSE 'pink' END AS colour FROM hsv)
    SELECT colour, count(*) AS n FROM named GROUP BY 1
    """,
)
def _names(spark, sf):
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    named = colour.rgb_to_name(part * 37 % 256, supp * 91 % 256, (part + 3 * order) % 256)
    return b.table(spark, sf, "lineitem").groupBy(named.alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "score_functions",
    "SELECT event_id, round(greatest(0, least(1, (value / 20 - 0.45) / 0.45)), 6) AS rescaled, "
    "round((value / 20 + 1) / 2, 6) AS shifted, round(ln(greatest(1e-4, least(1 - 1e-4, value / 20)) / (1 - greatest(1e-4, "
    "least(1 - 1e-4, value / 20)))), 6) AS logit, round(1 / (1 + exp(-value / 20)), 6) AS sigmoid, "
    "round(CASE WHEN user_id % 2 = 0 THEN (0.35 * value + 0.15 * 0.5) / 0.5 ELSE value END, 6) AS mean FROM events",
)
def _functions(spark, sf):
    x = F.col("value") / 20.0
    half = F.when(F.col("user_id") % 2 == 0, F.lit(0.5))
    return b.table(spark, sf, "events").select(
        "event_id",
        r6(scores.rescale_cosine(x), "rescaled"),
        r6(scores.shifted_cosine(x), "shifted"),
        r6(scores.logit(x), "logit"),
        r6(scores.sigmoid(x), "sigmoid"),
        r6(scores.weighted_mean({"visual": F.col("value"), "category": half}), "mean"),
    )
