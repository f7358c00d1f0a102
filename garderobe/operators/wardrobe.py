"""Item tables: listing, eligibility, vector health, search, paging, edits and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import lookup, style, vectors

ITEM_ORDER = ("created_at", "item_id")


# ------------------------------------------------------------------ listing
def scan_items(items: DataFrame, category: str | None = None) -> DataFrame:
    """All items, or one category, in stored order."""
    kept = items if category is None else items.filter(F.col("category") == category)
    return kept.orderBy(*ITEM_ORDER)


def get_item(items: DataFrame, item_id: str) -> DataFrame:
    return items.filter(F.col("item_id") == item_id)


def count_by_category(items: DataFrame, keys: tuple[str, ...] = ("wardrobe_id",)) -> DataFrame:
    return items.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n_items"))


def slot_pools(items: DataFrame, model: str, dim: int) -> DataFrame:
    """Usable items of every slot, one row per item. Pools stay rows, never arrays of unbounded length."""
    return eligible_items(items, model, dim).filter(F.col("reason").isNull()).filter(F.col("category").isin(*v.SLOTS))


def review_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("wardrobe_id", "category").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("review_status") == "needs_review").alias("n_review"),
    )


# ------------------------------------------------------------------ eligibility
def exclusion_reason(category: Column, review_status: Column) -> Column:
    return F.when(~F.coalesce(category.isin(*v.SLOTS), F.lit(False)), "unknown category").when(
        review_status == "needs_review", "needs review (uncertain detection)"
    )


def embedding_health(embedding: Column, model: Column, dim: Column, want_model: str, want_dim: int | None) -> Column:
    """ok, missing, stale or corrupt; checked in the order missing, stale, corrupt."""
    stale = F.coalesce(model != want_model, F.lit(False))
    if want_dim is not None:
        stale = stale | F.coalesce(dim != want_dim, F.lit(False))
    length = vectors.norm(embedding)
    sound = (
        (F.size(embedding) > 0)
        & F.coalesce(F.size(embedding) == dim, F.lit(True))
        & vectors.all_finite(embedding)
        & (length > 0.98)
        & (length < 1.02)
    )
    return (
        F.when(embedding.isNull(), "missing")
        .when(stale, "stale")
        .when(~F.coalesce(sound, F.lit(False)), "corrupt")
        .otherwise("ok")
    )


def with_health(items: DataFrame, model: str, dim: int | None) -> DataFrame:
    state = embedding_health(F.col("embedding"), F.col("embedding_model"), F.col("embedding_dim"), model, dim)
    return items.withColumn("health", state)


def eligible_items(items: DataFrame, model: str, dim: int | None) -> DataFrame:
    """Adds ``reason``: null for usable items, else why the item cannot be part of an outfit."""
    judged = with_health(items, model, dim)
    reason = F.coalesce(
        exclusion_reason(F.col("category"), F.col("review_status")),
        F.when(F.col("health") != "ok", "missing or invalid embedding"),
    )
    return judged.withColumn("reason", reason)


def eligibility_summary(items: DataFrame, model: str, dim: int | None) -> DataFrame:
    judged = eligible_items(items, model, dim)
    return judged.groupBy("wardrobe_id", "category", F.coalesce("reason", F.lit("eligible")).alias("state")).agg(
        F.count(F.lit(1)).alias("n_items")
    )


def embedding_queue(items: DataFrame, model: str, dim: int | None) -> DataFrame:
    """Items whose vector must be computed again by the encoder hook."""
    return with_health(items, model, dim).filter(F.col("health") != "ok").select("wardrobe_id", "item_id", "health")


def not_embedded(ids: DataFrame, embedded: DataFrame) -> DataFrame:
    """Dataset items without a vector yet: the work list of a resumable embedding job."""
    return ids.join(embedded.select("item_id"), "item_id", "left_anti")


# ------------------------------------------------------------------ search
def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def search_items(
    items: DataFrame,
    category: str | None = None,
    label: str | None = None,
    color: str | None = None,
    style_name: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Exact category; case-insensitive label, colour and style; free text over the four of them."""
    out = items if not category else items.filter(F.col("category") == category)
    if label:
        out = out.filter(_text(F.col("label")) == label.lower())
    if color:
        named = F.exists("colors", lambda c: F.lower(c["name"]) == color.lower())
        out = out.filter(F.coalesce(named, F.lit(False)) | (_text(F.col("color")) == color.lower()))
    if style_name:
        out = out.filter(_text(F.col("style")) == style_name.lower())
    if text:
        hay = F.lower(F.concat_ws(" ", "category", "label", "color", "style"))
        out = out.filter(hay.contains(text.lower()))
    return out


def gallery_filter(items: DataFrame, show: str = "all", query: str = "") -> DataFrame:
    out = items
    if show == "needs_review":
        out = out.filter(F.col("review_status") == "needs_review")
    elif show != "all":
        out = out.filter(F.col("category") == show)
    query = query.strip().lower()
    if query:
        hay = F.lower(
            F.concat_ws(" ", lookup.item_label(F.col("label"), F.col("category")), "category", "color", "style", "item_id")
        )
        out = out.filter(hay.contains(query))
    return out


def gallery_order(sort: str) -> list[Column]:
    """Sort keys of the gallery; ties keep the stored order (reversed for newest)."""
    stored = [F.col(c).asc() for c in ITEM_ORDER]
    return {
        "newest": [F.col("created_at").desc(), F.col("item_id").asc()],
        "oldest": stored,
        "category": [lookup.slot_position(F.col("category")).asc(), *stored],
        "score": [F.coalesce("confidence", F.lit(0.0)).desc(), *stored],
    }[sort]


def sort_gallery(items: DataFrame, sort: str = "newest") -> DataFrame:
    return items.orderBy("wardrobe_id", *gallery_order(sort))


def page_items(items: DataFrame, page: int, per_page: int, sort: str = "newest") -> DataFrame:
    """One page per wardrobe. The bound on the rank lets Spark keep only the top rows before the shuffle."""
    rank = Window.partitionBy("wardrobe_id").orderBy(*gallery_order(sort))
    pages = items.groupBy("wardrobe_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_page)).cast("bigint").alias("pages"))
    return (
        items.withColumn("position", F.row_number().over(rank))
        .filter(F.col("position") <= page * per_page)
        .filter(F.col("position") > (page - 1) * per_page)
        .join(pages, "wardrobe_id")
    )


def stratified_pick(
    items: DataFrame, counts: dict[str, int], seed: int = 0, fine: str | None = None, accessories: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """``counts[slot]`` items per slot in a seeded hash order, and the shortage per slot."""
    pool = items.filter(F.col("category").isin(*counts))
    if fine and accessories:
        pool = pool.filter((F.col("category") != "accessory") | F.col(fine).isin(*accessories))
    order = Window.partitionBy("category").orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col("item_id"))), "item_id")
    most = max(counts.values())
    picked = (
        pool.withColumn("pick", F.row_number().over(order))
        .filter(F.col("pick") <= most)
        .filter(F.col("pick") <= lookup.lookup(counts, F.col("category")))
    )
    wanted = items.sparkSession.createDataFrame(list(counts.items()), "category string, wanted int")
    have = picked.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    short = (
        wanted.join(have, "category", "left")
        .select("category", (F.col("wanted") - F.coalesce("n", F.lit(0))).cast("bigint").alias("missing"))
        .filter(F.col("missing") > 0)
    )
    return picked, short


def sample_top_categories(items: DataFrame, per_category: int = 6, categories: int = 5, seed: int = 42) -> DataFrame:
    """``per_category`` items from each of the largest categories, in a seeded hash order."""
    largest = (
        items.groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "category")
        .limit(categories)
        .select("category")
    )
    order = Window.partitionBy("category").orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col("item_id"))), "item_id")
    picked = items.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= per_category)
    return picked.join(largest, "category", "left_semi")


# ------------------------------------------------------------------ diagnostics
def wardrobe_diagnostics(items: DataFrame, files: DataFrame, model: str, dim: int | None) -> DataFrame:
    """One row per wardrobe: sizes, vector states, missing images, bad categories and orphan files.

    ``files(wardrobe_id, path)`` is a listing; a file nobody refers to is an orphan.
    """
    listed = files.select(F.col("path").alias("image_path")).distinct()
    present = with_health(items, model, dim).join(listed.withColumn("found", F.lit(True)), "image_path", "left")
    state = F.col("health")
    summary = present.groupBy("wardrobe_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.count_if(F.col("category") == s).alias(f"n_{s}") for s in v.SLOTS],
        *[F.count_if(state == s).alias(f"vectors_{s}") for s in ("ok", "missing", "stale", "corrupt")],
        F.count_if(F.col("found").isNull()).alias("missing_images"),
        F.count_if(~F.col("category").isin(*v.SLOTS)).alias("bad_categories"),
    )
    orphans = orphan_files(items, files).groupBy("wardrobe_id").agg(F.count(F.lit(1)).alias("orphan_files"))
    return summary.join(orphans, "wardrobe_id", "left").fillna(0, ["orphan_files"])


def orphan_files(items: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(items.select(F.col("image_path").alias("path")), "path", "left_anti")


def missing_files(items: DataFrame, files: DataFrame) -> DataFrame:
    return items.join(files.select(F.col("path").alias("image_path")), "image_path", "left_anti")


# ------------------------------------------------------------------ changes (snapshots in, snapshots out)
def clashing_ids(items: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(items.select("item_id"), "item_id", "left_semi")


def write_items(items: DataFrame, new: DataFrame, strict: bool = True) -> DataFrame:
    """Insert. An id that exists is an error at run time, or is left out when not ``strict``."""
    known = items.select("item_id", F.lit(True).alias("_known")).distinct()
    marked = new.join(known, "item_id", "left")
    if strict:
        message = F.concat(F.lit("Item "), F.col("item_id"), F.lit(" already exists"))
        good = F.when(F.col("_known").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        added = marked.filter(good)
    else:
        added = marked.filter(F.col("_known").isNull())
    return items.unionByName(added.drop("_known").select(*items.columns))


def update_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite the given fields of the given ids; null leaves a field as it is."""
    fields = [c for c in changes.columns if c != "item_id"]
    new = changes.select("item_id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = items.join(new, "item_id", "left")
    keep = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in items.columns]
    return joined.select(*keep)


def edit_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """User edits ``(item_id, category, style, label)``, null = untouched.

    Choosing a category confirms the item and, without a new label, renames it when the category changes;
    choosing a style replaces the distribution by a one-hot one.
    """
    e = edits.select(
        "item_id", *[F.col(c).alias(f"_e_{c}") for c in ("category", "style", "label")], F.lit(True).alias("_edited")
    )
    new_cat, new_style, new_label = F.col("_e_category"), F.col("_e_style"), F.col("_e_label")
    renamed = new_cat.isNotNull() & (new_cat != F.col("category")) & new_label.isNull()
    values = {
        "category": F.coalesce(new_cat, F.col("category")),
        "review_status": F.when(new_cat.isNotNull(), "confirmed").otherwise(F.col("review_status")),
        "label": F.when(new_label.isNotNull(), lookup.clean(new_label))
        .when(renamed, new_cat)
        .otherwise(F.col("label")),
        "style": F.coalesce(new_style, F.col("style")),
        "style_scores": F.when(new_style.isNotNull(), style.user_style_scores(new_style)).otherwise(
            F.col("style_scores")
        ),
    }
    joined = items.join(e, "item_id", "left")
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in items.columns])


def confirm_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    marks = ids.select("item_id").distinct().withColumn("_confirm", F.lit(True))
    status = F.when(F.col("_confirm"), "confirmed").otherwise(F.col("review_status"))
    return items.join(marks, "item_id", "left").withColumn("review_status", status).select(*items.columns)


def delete_items(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining snapshot and a one-row count of what was removed."""
    gone = items.join(ids.select("item_id"), "item_id", "left_semi")
    return items.join(ids.select("item_id"), "item_id", "left_anti"), gone.agg(F.count(F.lit(1)).alias("deleted"))


def clear_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items.filter(F.lit(False)), items.agg(F.count(F.lit(1)).alias("deleted"))


def review_status(flagged: Column, corrected: Column, reviewed: Column) -> Column:
    return (
        F.when(corrected | (reviewed & flagged), "confirmed").when(flagged, "needs_review").otherwise("auto")
    )


def admit_detections(detections: DataFrame, overrides: DataFrame, reviewed: bool = False) -> DataFrame:
    """Detections to item rows: apply corrected slots, set review state, label and label source."""
    fix = overrides.select("id", F.col("category").alias("_fix"))
    slot = F.coalesce("_fix", "category")
    corrected = slot != F.col("category")
    status = review_status(F.size("flags") > 0, corrected, F.lit(reviewed))
    return (
        detections.join(fix, "id", "left")
        .withColumn("review_status", status)
        .withColumn("detector_label", F.col("label"))
        .withColumn("label_source", F.when(corrected, "user").otherwise("detector"))
        .withColumn("label", F.when(corrected, slot).otherwise(F.col("label")))
        .withColumn("category", slot)
        .drop("_fix")
    )
