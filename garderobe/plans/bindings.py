"""Shapes the shared star-schema tables into wardrobe, outfit and detection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import boxes, lookup, style, vectors

ENCODER, ENCODER_DIM = "enc64", 64
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"

# --- Fixed values: one hex per colour name, in vocabulary order -----------------------------------
PALETTE = (
    ("black", "#0a0a0a"), ("white", "#fafafa"), ("gray", "#808080"), ("beige", "#e3d3b4"), ("brown", "#6b4423"),
    ("navy", "#101c4a"), ("olive", "#6f6b1e"), ("red", "#d01c1c"), ("burgundy", "#5e0f1e"), ("pink", "#f2a0b8"),
    ("orange", "#e8811a"), ("yellow", "#f0dc28"), ("green", "#2a9a3a"), ("teal", "#159a94"),
    ("light blue", "#a3cdf2"), ("blue", "#1f4fd0"), ("purple", "#6a2fb0"),
)

# --- Fixed values: part type to slot --------------------------------------------------------------
TYPE_SLOT = {"STANDARD": "top", "MEDIUM": "bottom", "SMALL": "shoes", "LARGE": "outerwear", "ECONOMY": "one_piece"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_of_type(p_type: Column) -> Column:
    return F.coalesce(lookup.lookup(TYPE_SLOT, p_type), F.lit("accessory"))


def style_prompts(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """Seven model vectors, one per style: parameters of the scorer, so a fixed-size collect."""
    first = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < len(v.STYLES)).orderBy("vec_id")
    return [list(r.embedding) for r in first.select("embedding").collect()]


def item_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    earlier = e.select((F.col("vec_id") + 20).alias("vec_id"), F.col("embedding").alias("copied"))
    p = table(spark, sf_dir, "part")
    vec = F.col("vec_id")
    planted = (
        F.when(vec % 53 == 5, F.lit(None))
        .when((vec % 25 == 3) & (vec >= 20), F.col("copied"))
        .otherwise(F.col("embedding"))
    )
    size = F.col("p_size")
    x1, y1 = (size % 3 * 60).cast("int"), (size % 4 * 70).cast("int")
    names, hexes = (lookup.inline_array(x) for x in zip(*PALETTE))

    def colour(index: Column, share: float) -> Column:
        at = index.cast("int")
        return F.struct(F.get(names, at).alias("name"), F.get(hexes, at).alias("hex"), F.lit(share).alias("fraction"))

    return (
        e.join(p, vec == F.col("p_partkey"))
        .join(earlier, "vec_id", "left")
        .select(
            (vec % 20).alias("wardrobe_id"),
            F.concat(F.lit("it"), vec).alias("item_id"),
            vec.alias("seq"),
            F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, vec_id)").alias("created_at"),
            slot_of_type(F.col("p_type")).alias("category"),
            F.col("p_name").alias("label"),
            F.when(size % 10 == 0, "needs_review")
            .when(size % 10 == 1, "confirmed")
            .when(size % 10 == 2, "user")
            .otherwise("auto")
            .alias("review_status"),
            F.when(size % 11 != 0, (size % 10).cast("double") / F.lit(10.0)).alias("confidence"),
            F.array(colour(size % 17, 0.7), colour((size * 3 + 5) % 17, 0.3)).alias("colors"),
            F.concat(F.lit("w"), vec % 20, F.lit("_"), F.floor(vec / 100)).alias("source_image"),
            boxes.box(x1, y1, (x1 + 100 + size % 5 * 10).cast("int"), y1 + 150).alias("bbox"),
            F.when(vec % 50 == 7, "old").otherwise(ENCODER).alias("embedding_model"),
            F.lit(ENCODER_DIM).alias("embedding_dim"),
            planted.alias("embedding"),
            size.alias("p_size"),
        )
        .withColumn("color", F.get("colors", F.lit(0))["name"])
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wardrobe items with colours, photo boxes, planted vector states and zero-shot style scores."""
    logits = vectors.style_logits(style_prompts(spark, sf_dir), v.STYLE_TEMPERATURE)
    base = item_base(spark, sf_dir).withColumn("_logits", logits("embedding"))
    scored = base.withColumn("style_scores", vectors.softmax_rounded(F.col("_logits"))).drop("_logits")
    return scored.withColumn("style", style.top_style(F.col("style_scores")))


def outfit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed outfits: an order is an outfit, its distinct parts are the members, in part order.

    Members of an outfit keep the sort key ``ord``; sizes and positions are derived where needed.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    b = lookup.hash_unit(F.concat(F.lit("42:"), F.col("l_orderkey")))
    split = F.when(b < 0.1, "test").when(b < 0.2, "valid").otherwise("train")
    shared = F.col("l_partkey") % 40 == 0
    return line.withColumn("split", split).select(
        "split",
        F.col("l_orderkey").alias("set_id"),
        F.col("l_partkey").alias("ord"),
        F.when(shared, F.concat(F.lit("p"), F.col("l_partkey")))
        .otherwise(F.concat_ws("_", "split", "l_partkey"))
        .alias("item_id"),
    )


def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every item id that can occur in an outfit (a part under each of its ids)."""
    p = table(spark, sf_dir, "part").select("p_partkey", slot_of_type(F.col("p_type")).alias("category"))
    ids = F.when(F.col("p_partkey") % 40 == 0, F.array(F.concat(F.lit("p"), F.col("p_partkey")))).otherwise(
        F.array(*[F.concat(F.lit(s + "_"), F.col("p_partkey")) for s in v.SPLITS])
    )
    return p.select(F.explode(ids).alias("item_id"), "category")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    key = F.col("vec_id")
    ids = F.when(key % 40 == 0, F.array(F.concat(F.lit("p"), key))).otherwise(
        F.array(*[F.concat(F.lit(s + "_"), key) for s in v.SPLITS])
    )
    return e.select(
        F.explode(ids).alias("item_id"),
        F.col("embedding").alias("vector"),
        F.lit(ENCODER).alias("model_name"),
        F.lit(ENCODER_DIM).alias("dim"),
    )


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output per order: label, confidence and xyxy floats on a 400 x 600 image."""
    names = lookup.inline_array((*v.LABELS, "spoon", "lamp"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x1 = (supp % 4 * 70 - 20).cast("double")
    y1 = (part % 5 * 80).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.lit(400).alias("width"),
        F.lit(600).alias("height"),
        F.col("l_linenumber").alias("seq"),
        F.get(names, (part % 28).cast("int")).alias("label"),
        (((part * 7 + supp * 13) % 100).cast("double") / F.lit(100.0)).alias("confidence"),
        x1.alias("x1"),
        y1.alias("y1"),
        F.when(part % 97 == 0, x1 + 10.0).otherwise((supp % 4 * 70 + 80 + part % 3 * 40).cast("double")).alias("x2"),
        (y1 + 120 + supp % 3 * 60).alias("y2"),
    )
