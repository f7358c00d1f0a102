"""Detector output to reviewed garment regions, keyed by image.

``raw(image_id, width, height, seq, label, confidence, x1, y1, x2, y2)``: ``seq`` is the order in which the
detector reported the boxes. No image is ever collected into one row or task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import boxes
from garderobe.functions.lookup import clean, slot_for_label
from garderobe.operators.spread import pair_join
from garderobe.session import cut_lineage

IMG = "image_id"
SEPARATES = ("top", "bottom", "outerwear")


def validate_detections(
    raw: DataFrame, min_side: int = v.MIN_BOX_SIDE, min_area: float = v.MIN_AREA_SHARE, scale: float = 1.0
) -> DataFrame:
    """Usable predictions: known label, confidence in [0, 1], box clipped to the image and large enough."""
    conf = F.col("confidence").cast("double")
    corners = [F.col(c).cast("double") * F.lit(float(scale)) for c in ("x1", "y1", "x2", "y2")]
    # Exploding a one-element array computes the box once; otherwise every filter below would inline it again.
    box = F.explode(F.array(boxes.clip_box(*corners, F.col("width"), F.col("height"), min_side)))
    out = raw.withColumn("slot", slot_for_label(F.col("label"))).filter(F.col("slot").isNotNull())
    out = out.select(
        IMG, "seq", "width", "height", clean(F.col("label")).alias("label"), "slot", conf.alias("conf"), box.alias("box")
    )
    floor = F.lit(min_area) * F.col("width") * F.col("height")
    sound = F.col("conf").isNotNull() & ~F.isnan("conf") & F.col("conf").between(0.0, 1.0) & (F.abs("conf") < F.lit(math.inf))
    return out.filter(F.col("box").isNotNull() & sound).filter(boxes.box_area(F.col("box")) >= floor)


def first_seen_dedup(valid: DataFrame) -> DataFrame:
    """One row per (image, label, box): the first one reported. A plain aggregate, combined before the shuffle."""
    first = F.min(F.struct("seq", (-F.col("conf")).alias("neg"), "width", "height", "slot")).alias("f")
    return valid.groupBy(IMG, "label", "box").agg(first).select(
        IMG, F.col("f.seq").alias("seq"), F.col("f.width").alias("width"), F.col("f.height").alias("height"),
        "label", (-F.col("f.neg")).alias("conf"), "box", F.col("f.slot").alias("slot"),
    )


def evidence_filter(rows: DataFrame, display_floor: float = v.DISPLAY_FLOOR) -> DataFrame:
    return rows.filter(F.col("conf") >= min(v.EVIDENCE_FLOOR, display_floor))


def min_confidence_ingest(detections: DataFrame, minimum: float | None = None) -> DataFrame:
    return detections if minimum is None else detections.filter(F.col("confidence") >= minimum)


def top_detections(raw: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy(IMG).orderBy(F.col("confidence").desc(), "seq", "label", "x1", "y1", "x2", "y2")
    return raw.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def mask_area_filter(area: Column, image_area: Column, width: Column, height: Column) -> Column:
    """Regions that can be one garment: neither background-sized nor a speck or sliver."""
    share = area / image_area
    aspect = width / F.greatest(height, F.lit(1))
    return (share > 0.01) & (share < 0.6) & (aspect > 0.2) & (aspect < 5.0)


# ------------------------------------------------------------------ grouping
def _order(conf: str = "conf", box: str = "box") -> Column:
    return F.struct((-F.col(conf)).alias("neg"), F.col(box).alias("box"))


def region_heads(evidence: DataFrame, iou: float = v.REGION_IOU) -> tuple[DataFrame, DataFrame]:
    """Boxes that open a region, and the home region of every box.

    Greedy rule: in order of score, a box joins the first region whose head it overlaps, else opens one. So a
    box is a head exactly when no earlier head overlaps it. That is settled in rounds over the overlap edges
    of all images at once: boxes without an undecided earlier neighbour are heads, whatever they overlap is
    not, and the edges of decided boxes go. Equal boxes share their fate and are collapsed first.
    """
    spots = evidence.groupBy(IMG, "box").agg(F.max("conf").alias("conf")).withColumn("ord", _order())
    spots = cut_lineage(spots.select(IMG, "box", "ord").withColumn("_id", boxes.box_text(F.col("box"))))
    edges = pair_join(
        spots,
        spots,
        [IMG],
        ["_id"],
        lambda a, b: (a("ord") < b("ord")) & (boxes.box_iou(a("box"), b("box")) >= iou),
        select=lambda a, b: [a("ord").alias("a"), b("ord").alias("b")],
    ).select(IMG, "a", "b")
    every = cut_lineage(edges)
    open_edges, covered = every, None
    while open_edges.limit(1).count() > 0:  # every round decides the earliest box of each open chain
        later = open_edges.select(IMG, F.col("b").alias("a")).distinct()
        starts = open_edges.join(later, [IMG, "a"], "left_anti")
        hit = cut_lineage(starts.select(IMG, "b").distinct())
        covered = hit if covered is None else covered.unionByName(hit)
        rest = open_edges.join(hit, [IMG, "b"], "left_anti").join(hit.withColumnRenamed("b", "a"), [IMG, "a"], "left_anti")
        open_edges = cut_lineage(rest)
    nodes = spots.select(IMG, F.col("ord").alias("b"))
    if covered is None:
        heads = nodes
        homes = nodes.withColumn("home", F.col("b"))
    else:
        heads = nodes.join(covered, [IMG, "b"], "left_anti")
        joined = every.join(heads.withColumnRenamed("b", "a"), [IMG, "a"]).join(covered, [IMG, "b"], "left_semi")
        homes = heads.withColumn("home", F.col("b")).unionByName(joined.groupBy(IMG, "b").agg(F.min("a").alias("home")))
    return heads.select(IMG, F.col("b.box").alias("box")), homes.select(
        IMG, F.col("b.box").alias("box"), F.col("home.box").alias("home")
    )


def group_regions(evidence: DataFrame, iou: float = v.REGION_IOU) -> DataFrame:
    """One row per region: head label, slot, score and box, and the other labels seen on it, best first.

    A region has at most one entry per vocabulary label, so the array is bounded however many boxes it has.
    """
    _, homes = region_heads(evidence, iou)
    rank = F.struct((-F.col("conf")).alias("neg"), "box", "seq")
    placed = evidence.join(homes, [IMG, "box"]).withColumn("_rank", rank)
    per_label = placed.groupBy(IMG, "home", "label", "slot").agg(F.min("_rank").alias("_rank"))
    own = F.col("box") == F.col("home")
    heads = placed.filter(own).groupBy(IMG, F.col("box").alias("home")).agg(
        F.min(F.struct("_rank", "label", "slot", "width", "height")).alias("h")
    )
    both = per_label.join(heads, [IMG, "home"]).filter(F.col("label") != F.col("h.label"))
    others = both.groupBy(IMG, "home").agg(F.sort_array(F.collect_list(F.struct("_rank", "label", "slot"))).alias("o"))
    alternative = lambda x: F.struct(
        x["label"].alias("label"), x["slot"].alias("category"), (-x["_rank"]["neg"]).alias("confidence")
    )
    none = F.array().cast("array<struct<label:string,category:string,confidence:double>>")
    return heads.join(others, [IMG, "home"], "left").select(
        IMG,
        F.col("h.label").alias("label"),
        F.col("h.slot").alias("slot"),
        (-F.col("h._rank.neg")).alias("conf"),
        F.col("home").alias("box"),
        F.col("h.width").alias("width"),
        F.col("h.height").alias("height"),
        F.coalesce(F.transform("o", alternative), none).alias("alternatives"),
    )


# ------------------------------------------------------------------ review
def contained_parts(regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """For one-piece regions, the best evidence per label of separate garments inside the region."""
    ones = regions.filter(F.col("slot") == "one_piece").select(IMG, "box").withColumn("_id", boxes.box_text(F.col("box")))
    parts = evidence.filter(F.col("slot").isin(*SEPARATES)).withColumn("_id", F.concat_ws("|", "label", boxes.box_text(F.col("box"))))

    def inside(a, b):
        small = boxes.box_area(b("box")) <= F.lit(v.PART_OF_REGION) * boxes.box_area(a("box"))
        return small & (boxes.containment(b("box"), a("box")) >= v.CONTAINED)

    hits = pair_join(
        ones, parts.select(IMG, "_id", "label", "conf", "box", "seq"), [IMG], ["_id"], inside,
        select=lambda a, b: [a("box").alias("box"), b("label").alias("label"), b("conf").alias("conf"),
                             F.struct((-b("conf")).alias("neg"), b("box").alias("box"), b("seq").alias("seq")).alias("_rank")],
    )
    best = hits.groupBy(IMG, "box", "label").agg(F.max("conf").alias("conf"), F.min("_rank").alias("_rank"))
    row = F.struct((-F.col("conf")).alias("neg"), F.lit(1).alias("part"), "_rank", "label")
    return best.groupBy(IMG, "box").agg(F.sort_array(F.collect_list(row)).alias("parts"))


def region_flags(regions: DataFrame, evidence: DataFrame, threshold: float = v.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Adds ``flags`` (code, message) and ``suggested``: why a region needs a look, and a likelier slot."""
    c = F.col
    two = lambda x: F.format_string("%.2f", x)
    rows = regions.join(contained_parts(regions, evidence), [IMG, "box"], "left")
    other = F.filter("alternatives", lambda x: x["category"] != c("slot"))
    close = F.get(F.filter(other, lambda x: x["confidence"] >= F.lit(v.AMBIGUITY_RATIO) * c("conf")), F.lit(0))
    separate = F.filter(other, lambda x: x["category"].isin(*SEPARATES))
    rows = rows.withColumn("_close", close).withColumn("_sep", F.when(c("slot") == "one_piece", separate))
    # Alternatives come first among equal scores; a label counts once, with its best score.
    named_alt = F.transform("_sep", lambda x, i: F.struct((-x["confidence"]).alias("neg"), F.lit(0).alias("part"), i.alias("at"), x["label"].alias("label")))
    named_part = F.transform("parts", lambda x, i: F.struct(x["neg"].alias("neg"), F.lit(1).alias("part"), i.alias("at"), x["label"].alias("label")))
    empty = F.array().cast("array<struct<neg:double,part:int,at:int,label:string>>")
    seen = F.concat(F.coalesce(named_alt, empty), F.coalesce(named_part, empty))
    rows = rows.withColumn("_seen", F.when(c("slot") == "one_piece", seen))
    labels = F.array_distinct(F.transform("_seen", lambda x: x["label"]))
    best = F.transform(
        labels,
        lambda name: F.struct(
            F.array_min(F.transform(F.filter("_seen", lambda x: x["label"] == name), lambda x: x["neg"])).alias("neg"),
            F.array_position(labels, name).alias("at"),
            name.alias("label"),
        ),
    )
    bits = F.transform(F.array_sort(best), lambda x: F.concat(x["label"], F.lit(" "), two(-x["neg"])))
    width, height = c("box.x2") - c("box.x1"), c("box.y2") - c("box.y1")

    def flag(code, when, message):
        return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))

    flags = F.array(
        flag(
            "low_confidence", c("conf") < threshold,
            F.concat(F.lit("Low detector score ("), two(c("conf")), F.lit(f" < {threshold:.2f}).")),
        ),
        flag(
            "ambiguous_category", c("_close").isNotNull(),
            F.concat(F.lit("Also detected as "), c("_close.label"), F.lit(" ("), two(c("_close.confidence")), F.lit("), close to "),
                     c("label"), F.lit(" ("), two(c("conf")), F.lit(").")),
        ),
        flag(
            "contains_separates", F.coalesce(F.size("_seen") > 0, F.lit(False)),
            F.concat(F.lit("This one-piece region also matches separate garments ("), F.array_join(bits, ", "),
                     F.lit("). It may be a person wearing separates, not a dress/jumpsuit.")),
        ),
        flag(
            "small_crop", F.least(width, height) < v.MIN_CROP_SIDE,
            F.concat(F.lit("Crop is only "), width, F.lit("x"), height, F.lit(" px; too small to judge reliably.")),
        ),
    )
    first_separate = F.get("_sep", F.lit(0))["category"]
    return (
        rows.withColumn("flags", F.array_compact(flags))
        .withColumn("suggested", F.coalesce(first_separate, c("_close.category")))
        .drop("_close", "_sep", "_seen", "parts")
    )


def detect_regions(
    raw: DataFrame,
    display_floor: float = v.DISPLAY_FLOOR,
    threshold: float = v.CONFIDENCE_THRESHOLD,
    scale: float = 1.0,
) -> DataFrame:
    """Validate, deduplicate, group, floor, flag and identify the regions of every image."""
    floor = min(display_floor, threshold)
    evidence = cut_lineage(evidence_filter(first_seen_dedup(validate_detections(raw, scale=scale)), floor))
    regions = group_regions(evidence).filter(F.col("conf") >= floor)
    judged = region_flags(regions, evidence, threshold)
    r4 = lambda x: F.bround(x, 4)
    alternatives = F.transform(
        "alternatives", lambda x: F.struct(x["label"].alias("label"), x["category"].alias("category"), r4(x["confidence"]).alias("confidence"))
    )
    return judged.select(
        IMG,
        boxes.detection_id(F.col(IMG).cast("string"), F.col("label"), F.col("box")).alias("id"),
        "label",
        F.col("slot").alias("category"),
        r4("conf").alias("confidence"),
        F.col("box").alias("bbox"),
        boxes.pad_box(F.col("box"), F.col("width"), F.col("height")).alias("crop"),
        alternatives.alias("alternatives"),
        "flags",
        F.col("suggested").alias("suggested_category"),
    )


# ------------------------------------------------------------------ JSON
DETECTION_JSON = (
    "struct<id:string,label:string,category:string,confidence:double,bbox:struct<x1:int,y1:int,x2:int,y2:int>,"
    "alternatives:array<struct<label:string,category:string,confidence:double>>,"
    "flags:array<struct<code:string,message:string>>,suggested_category:string>"
)


def detections_to_json(detections: DataFrame) -> DataFrame:
    fields = ["id", "label", "category", "confidence", "bbox", "alternatives", "flags", "suggested_category"]
    return detections.select(IMG, F.to_json(F.struct(*fields)).alias("json"))


def detections_from_json(rows: DataFrame) -> DataFrame:
    return rows.select(IMG, F.from_json("json", DETECTION_JSON).alias("d")).select(IMG, "d.*")
