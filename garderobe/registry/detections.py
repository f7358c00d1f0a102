"""Detection and attribute-cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import boxes, lookup
from garderobe.operators import attributes as at
from garderobe.operators import detections as d
from garderobe.operators import wardrobe as w
from garderobe.plans import bindings as b
from garderobe.registry.base import register
from garderobe.registry.common import DETECTIONS, case_map
from garderobe.registry.wardrobe import r6

BOX = ("box.x1", "box.y1", "box.x2", "box.y2")


def evidence(spark, sf):
    return d.evidence_filter(d.first_seen_dedup(d.validate_detections(b.raw_detections(spark, sf))))


@register(
    "validate_detections",
    f"WITH {DETECTIONS} SELECT image_id, label, slot, confidence AS conf, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2 FROM valid_detections",
)
def _validate(spark, sf):
    return d.validate_detections(b.raw_detections(spark, sf)).select("image_id", "label", "slot", "conf", *BOX)


@register(
    "clip_box",
    f"WITH {DETECTIONS} SELECT image_id, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2, (bx2 - bx1) * (by2 - by1) AS area, count(*) AS n FROM clipped WHERE "
    "bx2 - bx1 >= 8 AND by2 - by1 >= 8 GROUP BY ALL",
)
def _clip(spark, sf):
    raw = b.raw_detections(spark, sf)
    box = boxes.clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])
    return (
        raw.select("image_id", box.alias("box"))
        .filter(F.col("box").isNotNull())
        .select("image_id", *BOX, boxes.box_area(F.col("box")).alias("area"))
        .groupBy("image_id", "x1", "y1", "x2", "y2", "area")
        .agg(F.count(F.lit(1)).alias("n"))
    )


DEDUP = (
    DETECTIONS + ", src AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, l_partkey, l_suppkey FROM lineitem), "
    "v2 AS (SELECT v.*, s.seq FROM (SELECT DISTINCT * FROM valid_detections) v JOIN (SELECT DISTINCT image_id, seq, "
    f"[{', '.join(chr(39) + x + chr(39) for x in (*v.LABELS, 'spoon', 'lamp'))}][l_partkey % 28 + 1] AS label, ((l_partkey * 7 + l_suppkey * 13) % 100)"
    "::DOUBLE / 100.0 AS confidence, greatest(0, l_suppkey % 4 * 70 - 20) AS bx1, l_partkey % 5 * 80 AS by1, least(400, CASE WHEN l_partkey % 97 = 0 THEN "
    "l_suppkey % 4 * 70 - 10 ELSE l_suppkey % 4 * 70 + 80 + l_partkey % 3 * 40 END) AS bx2, least(600, l_partkey % 5 * 80 + 120 + l_suppkey % 3 * 60) AS by2 "
    "FROM src) s USING (image_id, label, confidence, bx1, by1, bx2, by2)), "
    "dd AS (SELECT image_id, label, slot, bx1, by1, bx2, by2, arg_min(confidence, (seq, -confidence)) AS conf, min(seq) AS seq FROM v2 GROUP BY ALL), "
    "ev AS (SELECT * FROM dd WHERE conf >= 0.10)"
)


@register(
    "first_seen_dedup",
    f"WITH {DEDUP} SELECT image_id, label, conf, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2 FROM dd",
)
def _dedup(spark, sf):
    return d.first_seen_dedup(d.validate_detections(b.raw_detections(spark, sf))).select("image_id", "label", "conf", *BOX)


@register("evidence_filter", f"WITH {DEDUP} SELECT image_id, label, slot, conf FROM ev")
def _evidence(spark, sf):
    return evidence(spark, sf).select("image_id", "label", "slot", "conf")


_INTER = "greatest(0, least(a.bx2, b.bx2) - greatest(a.bx1, b.bx1)) * greatest(0, least(a.by2, b.by2) - greatest(a.by1, b.by1))"
_AREA = "(({x}.bx2 - {x}.bx1) * ({x}.by2 - {x}.by1))"


@register(
    "box_overlaps",
    f"WITH {DEDUP}, s AS (SELECT DISTINCT image_id, bx1, by1, bx2, by2 FROM ev), p AS (SELECT a.image_id, ({_INTER})::DOUBLE / ({_AREA.format(x='a')} + "
    f"{_AREA.format(x='b')} - {_INTER}) AS iou, ({_INTER})::DOUBLE / {_AREA.format(x='a')} AS inside FROM s a JOIN s b ON a.image_id = b.image_id AND "
    "(a.bx1, a.by1, a.bx2, a.by2) < (b.bx1, b.by1, b.bx2, b.by2)) SELECT image_id, count(*) AS n, round(max(iou), 6) AS max_iou, round(max(inside), 6) AS "
    "max_inside, count(*) FILTER (iou >= 0.55) AS n_same_region FROM p WHERE iou > 0 GROUP BY 1",
)
def _overlaps(spark, sf):
    from garderobe.operators.spread import pair_join

    spots = evidence(spark, sf).select("image_id", "box").distinct().withColumn("_id", boxes.box_text(F.col("box")))
    hits = pair_join(
        spots,
        spots,
        ["image_id"],
        ["_id"],
        lambda x, y: (x("box") < y("box")) & (boxes.overlap_area(x("box"), y("box")) > 0),
        select=lambda x, y: [boxes.box_iou(x("box"), y("box")).alias("iou"), boxes.containment(x("box"), y("box")).alias("inside")],
    )
    return hits.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.max("iou"), "max_iou"),
        r6(F.max("inside"), "max_inside"),
        F.count_if(F.col("iou") >= v.REGION_IOU).alias("n_same_region"),
    )


@register(
    "pad_box",
    f"WITH {DETECTIONS} SELECT image_id, bx1, by1, greatest(0, bx1 - trunc((bx2 - bx1) * 0.03::DOUBLE)::INT) AS x1, greatest(0, by1 - trunc((by2 - by1) * "
    "0.03::DOUBLE)::INT) AS y1, least(400, bx2 + trunc((bx2 - bx1) * 0.03::DOUBLE)::INT) AS x2, least(600, by2 + trunc((by2 - by1) * 0.03::DOUBLE)::INT) AS y2 "
    "FROM valid_detections",
)
def _pad(spark, sf):
    good = d.validate_detections(b.raw_detections(spark, sf))
    padded = boxes.pad_box(F.col("box"), F.col("width"), F.col("height"))
    return good.select("image_id", F.col("box.x1").alias("bx1"), F.col("box.y1").alias("by1"), padded.alias("box")).select(
        "image_id", "bx1", "by1", *BOX
    )


@register(
    "detection_id",
    f"WITH {DETECTIONS} SELECT image_id, label, substr(sha1(image_id || '|' || label || '|(' || bx1 || ', ' || by1 || ', ' || bx2 || ', ' || by2 || ')'), 1, "
    "12) AS id FROM valid_detections",
)
def _id(spark, sf):
    good = d.validate_detections(b.raw_detections(spark, sf))
    return good.select("image_id", "label", boxes.detection_id(F.col("image_id").cast("string"), F.col("label"), F.col("box")).alias("id"))


# Heads by recursion over the ranked boxes of an image: the head list grows box by box.
HEADS = (
    DEDUP
    + ", spots AS (SELECT image_id, bx1, by1, bx2, by2, row_number() OVER (PARTITION BY image_id ORDER BY max(conf) DESC, bx1, by1, bx2, by2) AS r FROM ev "
    "GROUP BY image_id, bx1, by1, bx2, by2), near AS (SELECT a.image_id, b.r, list(a.r) AS early FROM spots a JOIN spots b ON a.image_id = b.image_id AND a.r < "
    f"b.r AND ({_INTER})::DOUBLE / ({_AREA.format(x='a')} + {_AREA.format(x='b')} - {_INTER}) >= 0.55 GROUP BY 1, 2), "
    "walk AS (SELECT image_id, 1::BIGINT AS r, [1::BIGINT] AS heads FROM spots WHERE r = 1 UNION ALL SELECT w.image_id, w.r + 1, CASE WHEN "
    "list_has_any(w.heads, coalesce(n.early, [])) THEN w.heads ELSE list_append(w.heads, w.r + 1) END FROM walk w JOIN spots s ON s.image_id = w.image_id AND "
    "s.r = w.r + 1 LEFT JOIN near n ON n.image_id = w.image_id AND n.r = w.r + 1), "
    "last AS (SELECT image_id, arg_max(heads, r) AS heads FROM walk GROUP BY 1), hd AS (SELECT s.* FROM spots s JOIN last l USING (image_id) WHERE "
    "list_contains(l.heads, s.r))"
)


@register(
    "group_regions",
    "WITH RECURSIVE " + HEADS + ", home AS (SELECT s.image_id, s.r, CASE WHEN list_contains(l.heads, s.r) THEN s.r ELSE list_min(list_filter(n.early, lambda x: "
    "list_contains(l.heads, x))) END AS h FROM spots s JOIN last l USING (image_id) LEFT JOIN near n ON n.image_id = s.image_id AND n.r = s.r), "
    "placed AS (SELECT e.*, s.r, home.h FROM ev e JOIN spots s USING (image_id, bx1, by1, bx2, by2) JOIN home ON home.image_id = s.image_id AND home.r = s.r), "
    "top AS (SELECT image_id, h, arg_min(label, (-conf, seq, label)) AS label, max(conf) AS conf FROM placed WHERE r = h GROUP BY 1, 2), "
    "alt AS (SELECT p.image_id, p.h, count(DISTINCT p.label) AS n FROM placed p JOIN top t ON t.image_id = p.image_id AND t.h = p.h WHERE p.label <> t.label "
    "GROUP BY 1, 2) SELECT t.image_id, t.label, t.conf, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2, coalesce(n, 0)::BIGINT AS n_alternatives FROM top t JOIN "
    "spots s ON s.image_id = t.image_id AND s.r = t.h LEFT JOIN alt ON alt.image_id = t.image_id AND alt.h = t.h",
)
def _regions(spark, sf):
    return d.group_regions(evidence(spark, sf)).select(
        "image_id", "label", "conf", *BOX, F.size("alternatives").cast("bigint").alias("n_alternatives")
    )


def _flat(df):
    text = lambda c, f: F.array_join(F.transform(c, f), "; ")
    return df.select(
        "image_id", "id", "label", "category", "confidence",
        text("alternatives", lambda x: F.concat(x["label"], F.lit(" "), x["confidence"].cast("string"))).alias("alternatives"),
        text("flags", lambda x: x["message"]).alias("flags"),
        "suggested_category",
    )


# Regions with the labels seen on them, their parts, flags and suggestion, as lists of structs per region.
_SEPARATE = "('top', 'bottom', 'outerwear')"
_INSIDE = _INTER.replace("a.", "g.").replace("b.", "e.")
JUDGED = (
    HEADS
    + ", home AS (SELECT s.image_id, s.r, CASE WHEN list_contains(l.heads, s.r) THEN s.r ELSE list_min(list_filter(n.early, lambda x: "
    "list_contains(l.heads, x))) END AS h FROM spots s JOIN last l USING (image_id) LEFT JOIN near n ON n.image_id = s.image_id AND n.r = s.r), "
    "placed AS (SELECT e.*, s.r, home.h, row_number() OVER (PARTITION BY e.image_id, home.h ORDER BY conf DESC, bx1, by1, bx2, by2, seq, label) AS rk "
    "FROM ev e JOIN spots s USING (image_id, bx1, by1, bx2, by2) JOIN home ON home.image_id = s.image_id AND home.r = s.r), "
    "top AS (SELECT image_id, h, bx1, by1, bx2, by2, arg_min(label, rk) AS label, arg_min(slot, rk) AS slot, max(conf) AS conf FROM placed WHERE r = h "
    "GROUP BY ALL HAVING max(conf) >= 0.15), "
    "labels AS (SELECT p.image_id, p.h, p.label, p.slot, max(p.conf) AS conf, min(p.rk) AS rk FROM placed p JOIN top t ON t.image_id = p.image_id AND "
    "t.h = p.h AND t.label <> p.label GROUP BY ALL), "
    "alts AS (SELECT image_id, h, list({'label': label, 'slot': slot, 'conf': conf} ORDER BY rk) AS alternatives FROM labels GROUP BY ALL), "
    "parts AS (SELECT g.image_id, g.h, e.label, e.conf, row_number() OVER (PARTITION BY g.image_id, g.h, e.label ORDER BY e.conf DESC, e.bx1, e.by1, "
    "e.bx2, e.by2, e.seq) AS nth, e.bx1, e.by1, e.bx2, e.by2, e.seq FROM top g JOIN ev e ON e.image_id = g.image_id AND g.slot = 'one_piece' AND "
    f"e.slot IN {_SEPARATE} AND {_AREA.format(x='e')} <= {v.PART_OF_REGION} * {_AREA.format(x='g')} AND ({_INSIDE})::DOUBLE / {_AREA.format(x='e')} "
    f">= {v.CONTAINED}), "
    "named AS (SELECT image_id, h, label, conf, 0 AS part, row_number() OVER (PARTITION BY image_id, h ORDER BY rk) AS spot FROM labels JOIN (SELECT "
    f"image_id, h FROM top WHERE slot = 'one_piece') USING (image_id, h) WHERE slot IN {_SEPARATE} UNION ALL SELECT image_id, h, label, conf, 1, row_number() "
    "OVER (PARTITION BY image_id, h ORDER BY conf DESC, bx1, by1, bx2, by2, seq, label) FROM parts WHERE nth = 1), "
    "once AS (SELECT image_id, h, label, max(conf) AS conf, min((part, spot)) AS place FROM named GROUP BY ALL), "
    "bits AS (SELECT image_id, h, string_agg(label || ' ' || printf('%.2f', conf), ', ' ORDER BY conf DESC, place) AS bits FROM once GROUP BY ALL), "
    "found AS (SELECT t.*, coalesce(alternatives, []) AS alternatives, bits, list_filter(coalesce(alternatives, []), lambda x: x.slot <> t.slot AND "
    f"x.conf >= {v.AMBIGUITY_RATIO} * t.conf)[1] AS close, CASE WHEN t.slot = 'one_piece' THEN list_filter(coalesce(alternatives, []), lambda x: x.slot IN "
    f"{_SEPARATE})[1] END AS sep FROM top t LEFT JOIN alts USING (image_id, h) LEFT JOIN bits USING (image_id, h)), "
    "judged AS (SELECT image_id, substr(sha1(image_id || '|' || label || '|(' || bx1 || ', ' || by1 || ', ' || bx2 || ', ' || by2 || ')'), 1, 12) AS id, "
    "label, slot AS category, round_even(conf, 4) AS confidence, list_transform(alternatives, lambda x: {'label': x.label, 'category': x.slot, 'confidence': "
    "round_even(x.conf, 4)}) AS alternatives, list_filter([CASE WHEN conf < " + repr(v.CONFIDENCE_THRESHOLD) + " THEN {'code': 'low_confidence', 'message': "
    f"'Low detector score (' || printf('%.2f', conf) || ' < {v.CONFIDENCE_THRESHOLD:.2f}).'" + "} END, CASE WHEN close IS NOT NULL THEN {'code': "
    "'ambiguous_category', 'message': 'Also detected as ' || close.label || ' (' || printf('%.2f', close.conf) || '), close to ' || label || ' (' || "
    "printf('%.2f', conf) || ').'} END, CASE WHEN bits IS NOT NULL THEN {'code': 'contains_separates', 'message': 'This one-piece region also matches "
    "separate garments (' || bits || '). It may be a person wearing separates, not a dress/jumpsuit.'} END, CASE WHEN least(bx2 - bx1, by2 - by1) < "
    + repr(v.MIN_CROP_SIDE) + " THEN {'code': 'small_crop', 'message': 'Crop is only ' || (bx2 - bx1) || 'x' || (by2 - by1) || ' px; too small to judge "
    "reliably.'} END], lambda x: x IS NOT NULL) AS flags, coalesce(sep.slot, close.slot) AS suggested_category, bx1, by1, bx2, by2 FROM found)"
)


@register(
    "detect_regions",
    f"WITH RECURSIVE {JUDGED} SELECT image_id, id, label, category, confidence, array_to_string(list_transform(alternatives, lambda x: x.label || ' ' || "
    "x.confidence), '; ') AS alternatives, array_to_string(list_transform(flags, lambda x: x.message), '; ') AS flags, suggested_category FROM judged",
)
def _detect(spark, sf):
    return _flat(d.detect_regions(b.raw_detections(spark, sf)))


@register(
    "region_flags",
    f"WITH RECURSIVE {JUDGED}, f AS (SELECT category, unnest(flags) AS f, suggested_category FROM judged) SELECT category, f.code AS code, count(*) AS n, "
    "count(suggested_category) AS n_suggested FROM f GROUP BY ALL",
)
def _flags(spark, sf):
    found = d.detect_regions(b.raw_detections(spark, sf))
    return (
        found.select("category", F.explode("flags").alias("f"), "suggested_category")
        .groupBy("category", "f.code")
        .agg(F.count(F.lit(1)).alias("n"), F.count("suggested_category").alias("n_suggested"))
    )


@register(
    "detections_json",
    f"WITH RECURSIVE {JUDGED} SELECT image_id, '{{\"id\":\"' || id || '\",\"label\":\"' || label || '\",\"category\":\"' || category || "
    "'\",\"confidence\":' || confidence || ',\"bbox\":' || to_json({'x1': bx1, 'y1': by1, 'x2': bx2, 'y2': by2}) || ',\"alternatives\":' || "
    "to_json(alternatives) || ',\"flags\":' || to_json(flags) || CASE WHEN suggested_category IS NULL THEN '' ELSE ',\"suggested_category\":\"' || "
    "suggested_category || '\"' END || '}' AS json FROM judged",
)
def _json(spark, sf):
    return d.detections_to_json(d.detect_regions(b.raw_detections(spark, sf)))


@register(
    "admit_detections",
    f"WITH RECURSIVE {JUDGED}, fixes AS (SELECT id, any_value(suggested_category) AS fix FROM judged WHERE suggested_category IS NOT NULL GROUP BY 1), "
    "a AS (SELECT j.*, coalesce(fix, category) AS slot FROM judged j LEFT JOIN fixes USING (id) WHERE confidence >= 0.2) SELECT slot AS category, CASE WHEN "
    "slot <> category THEN 'confirmed' WHEN len(flags) > 0 THEN 'needs_review' ELSE 'auto' END AS review_status, CASE WHEN slot <> category THEN 'user' ELSE "
    "'detector' END AS label_source, count(*) AS n FROM a GROUP BY ALL",
)
def _admit(spark, sf):
    found = d.detect_regions(b.raw_detections(spark, sf))
    fixes = found.filter(F.col("suggested_category").isNotNull()).select("id", F.col("suggested_category").alias("category"))
    admitted = w.admit_detections(d.min_confidence_ingest(found, 0.2), fixes.dropDuplicates(["id"]))
    return admitted.groupBy("category", "review_status", "label_source").agg(F.count(F.lit(1)).alias("n"))


@register(
    "min_confidence_ingest",
    f"WITH {DETECTIONS} SELECT label, count(*) AS n FROM raw_detections WHERE confidence >= 0.6 GROUP BY 1",
)
def _min_conf(spark, sf):
    return d.min_confidence_ingest(b.raw_detections(spark, sf), 0.6).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "top_detections",
    f"WITH {DETECTIONS}, r AS (SELECT image_id, confidence, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC) AS position FROM raw_detections) "
    "SELECT image_id, position, confidence FROM r WHERE position <= 3",
)
def _top(spark, sf):
    return d.top_detections(b.raw_detections(spark, sf), 3).select("image_id", "position", "confidence")


@register(
    "mask_area_filter",
    f"WITH {DETECTIONS}, m AS (SELECT *, (bx2 - bx1) AS w, (by2 - by1) AS h FROM clipped) SELECT image_id, label, w, h FROM m WHERE w * h / 240000.0::DOUBLE > "
    "0.01 AND w * h / 240000.0::DOUBLE < 0.6 AND w / greatest(h, 1)::DOUBLE > 0.2 AND w / greatest(h, 1)::DOUBLE < 5.0",
)
def _mask(spark, sf):
    raw = b.raw_detections(spark, sf)
    box = boxes.clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")], min_size=0)
    sized = raw.withColumn("box", box).select(
        "image_id", "label", (F.col("width") * F.col("height")).alias("whole"),
        (F.col("box.x2") - F.col("box.x1")).alias("w"), (F.col("box.y2") - F.col("box.y1")).alias("h"),
    )
    keep = d.mask_area_filter(F.col("w") * F.col("h"), F.col("whole"), F.col("w"), F.col("h"))
    return sized.filter(keep).drop("whole")


@register(
    "map_detected_category",
    f"WITH {DETECTIONS} SELECT coalesce({case_map('label', {x: c for c, ws in v.DETECTED_CATEGORY.items() for x in ws})}, 'accessories') AS category, "
    "count(*) AS n FROM raw_detections GROUP BY 1",
)
def _mapped(spark, sf):
    raw = b.raw_detections(spark, sf)
    return raw.groupBy(lookup.map_detected_category(F.upper("label")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ attribute text, written as a chatty model would
def attribute_text(spark, sf):
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"category": "'), F.initcap("event_type"), F.lit('", "confidence": '), (F.col("value") / 10).cast("string"),
        F.lit(', "colors": ['), F.lit('" Red ", "'), F.col("event_type"), F.lit('", "", "a", "b", "c", "d", "e"], "formality": "'),
        F.when(e % 3 == 0, "Casual").when(e % 3 == 1, "loud").otherwise("formal"), F.lit('", "season": "'),
        F.when(e % 2 == 0, "Summer").otherwise(""), F.lit('", "props": '), F.col("props"), F.lit("}"),
    )
    text = (
        F.when(e % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(e % 5 == 1, F.concat(F.lit("Sure, here it is: "), body, F.lit(" Hope that helps!")))
        .when(e % 5 == 2, F.lit("I cannot see a garment."))
        .when(e % 5 == 3, F.substring(body, 1, 40))
        .otherwise(body)
    )
    return b.table(spark, sf, "events").select("event_id", "event_type", "value", text.alias("text"))


@register(
    "parse_llm_json",
    "SELECT event_id, event_id % 5 IN (0, 1, 4) AS parsed, CASE WHEN event_id % 5 IN (0, 1, 4) THEN upper(event_type[1]) || event_type[2:] END AS category, "
    "CASE WHEN event_id % 5 IN (0, 1, 4) THEN json_extract_string(props, '$.k') END AS k FROM events",
)
def _parse(spark, sf):
    rows = attribute_text(spark, sf).withColumn("m", at.parse_llm_json(F.col("text")))
    return rows.select(
        "event_id",
        F.col("m").isNotNull().alias("parsed"),
        F.try_element_at("m", F.lit("category")).alias("category"),
        F.get_json_object(F.try_element_at("m", F.lit("props")), "$.k").alias("k"),
    )


@register(
    "normalize_attributes",
    "SELECT event_id, lower(event_type) AS category, 'unknown' AS pattern, CASE event_id % 3 WHEN 0 THEN 'casual' WHEN 1 THEN 'unknown' ELSE 'formal' END AS "
    "formality, 'red,' || lower(event_type) || ',a,b,c,d,e' AS colors, CASE WHEN event_id % 2 = 0 THEN 'summer' ELSE '' END AS season, "
    "round(greatest(0, least(1, value / 10)), 6) AS confidence FROM events WHERE event_id % 5 IN (0, 1, 4)",
)
def _normalize(spark, sf):
    rows = attribute_text(spark, sf).withColumn("m", at.parse_llm_json(F.col("text"))).filter(F.col("m").isNotNull())
    n = rows.select("event_id", at.normalize_attributes(F.col("m"), F.lit("tops")).alias("n"))
    return n.select(
        "event_id", "n.category", "n.pattern", "n.formality", F.array_join("n.colors", ",").alias("colors"),
        F.array_join("n.season", ",").alias("season"), r6("n.confidence", "confidence"),
    )


def _reviewed(spark, sf):
    e = b.table(spark, sf, "events")
    items = at.split_review_queue(
        e.select(
            F.col("event_id").alias("item_id"), F.col("event_type").alias("category"), F.lit("blue").alias("color"),
            (F.col("value") / 20).alias("confidence"),
        )
    )
    k = F.col("event_id")
    answer = F.when(k % 4 == 0, "").when(k % 4 == 1, " s ").when(k % 4 == 2, "category = cropped cardigan, color=dark=brown,junk, color= red ")
    answers = e.filter(k % 4 != 3).select(k.alias("item_id"), answer.alias("answer"))
    return at.apply_corrections(items, answers, ("category", "color"))


@register(
    "apply_corrections",
    "SELECT event_id AS item_id, CASE WHEN f AND event_id % 4 = 2 THEN 'cropped cardigan' ELSE event_type END AS category, CASE WHEN f AND event_id % 4 = 2 THEN "
    "'red' ELSE 'blue' END AS color, f AND event_id % 4 = 2 AS human_corrected, f AND event_id % 4 = 3 AS needs_review FROM (SELECT *, value / 20 < 0.7 AS f FROM "
    "events)",
)
def _corrections(spark, sf):
    return _reviewed(spark, sf).drop("confidence")


@register(
    "split_review_queue",
    "SELECT event_type, value / 20 < 0.7 AS needs_review, count(*) AS n FROM events GROUP BY ALL",
)
def _queue(spark, sf):
    e = b.table(spark, sf, "events").withColumn("confidence", F.col("value") / 20)
    return at.split_review_queue(e).groupBy("event_type", "needs_review").agg(F.count(F.lit(1)).alias("n"))
