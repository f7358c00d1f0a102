"""Rectangle geometry on ``struct<x1,y1,x2,y2>`` columns of ints."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe import vocab as v


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0), x2 - x1).cast("bigint") * F.greatest(F.lit(0), y2 - y1).cast("bigint")


def box_area(b: Column) -> Column:
    return _area(b["x1"], b["y1"], b["x2"], b["y2"])


def overlap_area(a: Column, b: Column) -> Column:
    return _area(
        F.greatest(a["x1"], b["x1"]),
        F.greatest(a["y1"], b["y1"]),
        F.least(a["x2"], b["x2"]),
        F.least(a["y2"], b["y2"]),
    )


def box_iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    area = box_area(inner)
    return F.when(area > 0, overlap_area(inner, outer) / area).otherwise(F.lit(0.0))


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, min_size: int = 8) -> Column:
    """Clip to the image, put corners in order, round half to even; null if malformed or too small."""
    raw = [c.cast("double") for c in (x1, y1, x2, y2)]
    good = None
    for c in raw:
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
        good = ok if good is None else good & ok

    def edge(value: Column, limit: Column) -> Column:
        return F.bround(F.greatest(F.lit(0.0), F.least(value, limit.cast("double"))), 0).cast("int")

    left, right = edge(F.least(raw[0], raw[2]), width), edge(F.greatest(raw[0], raw[2]), width)
    upper, lower = edge(F.least(raw[1], raw[3]), height), edge(F.greatest(raw[1], raw[3]), height)
    return F.when(good & (right - left >= min_size) & (lower - upper >= min_size), box(left, upper, right, lower))


def pad_box(b: Column, width: Column, height: Column, share: float = v.CROP_PADDING) -> Column:
    px = ((b["x2"] - b["x1"]) * F.lit(share)).cast("int")
    py = ((b["y2"] - b["y1"]) * F.lit(share)).cast("int")
    return box(
        F.greatest(F.lit(0), b["x1"] - px),
        F.greatest(F.lit(0), b["y1"] - py),
        F.least(width, b["x2"] + px),
        F.least(height, b["y2"] + py),
    )


def box_text(b: Column) -> Column:
    return F.concat(
        F.lit("("), b["x1"], F.lit(", "), b["y1"], F.lit(", "), b["x2"], F.lit(", "), b["y2"], F.lit(")")
    )


def detection_id(image_key: Column, label: Column, b: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", image_key, label, box_text(b))), 1, 12)


def same_region(photo_a: Column, box_a: Column, photo_b: Column, box_b: Column) -> Column:
    """Two items cut from nearly the same box of one photo."""
    one_photo = (photo_a == photo_b) & (photo_a != "") & box_a.isNotNull() & box_b.isNotNull()
    return F.coalesce(one_photo & (box_iou(box_a, box_b) >= v.SAME_REGION_IOU), F.lit(False))
