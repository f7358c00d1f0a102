import math

import pytest
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import boxes, colour, lookup, scores, style, vectors


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


@pytest.mark.parametrize(
    "rgb,name",
    [
        ((10, 10, 10), "black"),
        ((250, 250, 250), "white"),
        ((128, 128, 128), "gray"),
        ((200, 20, 20), "red"),
        ((30, 40, 90), "navy"),
        ((230, 220, 190), "beige"),
        ((110, 70, 35), "brown"),
        ((40, 160, 60), "green"),
    ],
)
def test_colour_names(spark, rgb, name):
    assert one(spark, colour.rgb_to_name(*[F.lit(float(x)) for x in rgb])).c0 == name


def rel(spark, a, ha, b, hb):
    return one(spark, colour.relation(F.lit(a), colour.lightness(F.lit(ha)), F.lit(b), colour.lightness(F.lit(hb)))).c0


def test_colour_relations(spark):
    assert rel(spark, "white", "#fafafa", "navy", "#101c4a") == "neutral_contrast"
    assert rel(spark, "black", "#0a0a0a", "navy", "#101c4a") == "low_contrast_neutrals"
    # Contrast is tested before equality for two neutrals.
    assert rel(spark, "gray", "#404040", "gray", "#c0c0c0") == "neutral_contrast"
    assert rel(spark, "gray", "#808080", "gray", "#828282") == "tone_on_tone"
    assert rel(spark, "red", "#d01c1c", "black", "#0a0a0a") == "accent_with_neutral"
    assert rel(spark, "blue", "#1f4fd0", "blue", "#c0d0ff") == "monochrome"
    assert rel(spark, "red", "#d01c1c", "pink", "#f2a0b8") == "analogous"
    assert rel(spark, "blue", "#1f4fd0", "orange", "#e8811a") == "complementary"
    assert rel(spark, "red", "#d01c1c", "green", "#2a9a3a") == "conflicting"
    assert one(spark, colour.relation(F.lit(None).cast("string"), F.lit(0.1), F.lit("red"), F.lit(0.2))).c0 is None


def test_slot_table_is_symmetric_and_complete(spark):
    for a in v.SLOTS:
        for b in v.SLOTS:
            row = one(spark, scores.category_pair_score(F.lit(a), F.lit(b)), scores.category_pair_score(F.lit(b), F.lit(a)))
            assert row.c0 == row.c1
            assert (row.c0 == 0.0) == (a == b or {a, b} in ({"top", "one_piece"}, {"bottom", "one_piece"}))
    assert one(spark, scores.category_pair_score(F.lit("top"), F.lit("hat"))).c0 == v.UNKNOWN_SLOT_PAIR


def test_unknown_values_stay_unknown(spark):
    nothing = F.lit(None).cast("double")
    row = one(spark, scores.rescale_cosine(nothing), scores.logit(nothing), style.style_match(F.lit(None).cast("array<double>"), "formal"))
    assert tuple(row) == (None, None, None)
    assert one(spark, scores.weighted_mean({"visual": F.lit(0.8), "category": nothing})).c0 == pytest.approx(0.8)
    assert one(spark, scores.weighted_mean({"visual": nothing, "category": nothing})).c0 == 0.0


def test_boxes(spark):
    def clip(*b, m=8):
        got = one(spark, boxes.clip_box(*[F.lit(float(x)) for x in b], F.lit(100), F.lit(100), m)).c0
        return tuple(got) if got else None

    assert clip(10, 10, 50, 60) == (10, 10, 50, 60)
    assert clip(50, 60, 10, 10) == (10, 10, 50, 60)
    assert clip(-20, -5, 150, 90.5) == (0, 0, 100, 90)
    assert clip(10, 10, 12, 50) is None
    assert clip(math.nan, 0, 50, 50) is None
    a, b = (boxes.box(*[F.lit(x) for x in q]) for q in ((0, 0, 10, 10), (5, 0, 15, 10)))
    row = one(spark, boxes.box_iou(a, b), boxes.containment(a, b), boxes.pad_box(a, F.lit(100), F.lit(100), 0.5))
    assert row.c0 == pytest.approx(1 / 3) and row.c1 == 0.5 and tuple(row.c2) == (0, 0, 15, 15)


def test_lookups(spark):
    row = one(
        spark,
        lookup.fashion_slot(F.lit(" Men's Loafers & Moccasins ")),
        lookup.fashion_slot(F.lit("Home Decor")),
        lookup.slot_for_label(F.lit("Tank Top")),
        lookup.coarse_slot(F.lit("Bags")),
        lookup.map_detected_category(F.lit("umbrella")),
    )
    assert tuple(row) == ("shoes", None, "top", "accessory", "accessories")
    assert len(v.CATALOG_SLOT) == 126 and len(v.LABEL_SLOT) == 26


def test_dot_handles_nulls_and_lengths(spark):
    rows = [([1.0, 2.0], [3.0, 4.0]), (None, [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([1.0], [2.0])]
    df = spark.createDataFrame(rows, "x array<float>, y array<float>").coalesce(1)
    assert [r.d for r in df.select(vectors.dot("x", "y").alias("d")).collect()] == [11.0, None, None, 2.0]


def test_near_bound_never_drops_a_match(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = base + rng.normal(size=base.shape) * 0.03
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(base, other)], "x array<double>, y array<double>")
    near = vectors.may_be_near(vectors.leading(F.col("x")), vectors.leading(F.col("y")), 0.97)
    wrong = df.withColumn("d", vectors.dot("x", "y")).filter((F.col("d") >= 0.97) & ~near)
    assert wrong.count() == 0


def test_style(spark):
    s = F.array(*[F.lit(x) for x in (0.1, 0.1, 0.4, 0.1, 0.1, 0.1, 0.1)])
    row = one(spark, style.top_style(s), style.style_match(s, "casual"), style.style_similarity(s, s), style.item_context(s, None, None))
    assert row.c0 == "formal" and row.c1 == pytest.approx(0.25) and row.c2 == pytest.approx(1.0) and row.c3 is None
    with pytest.raises(Exception, match="Unknown style"):
        one(spark, style.user_style_scores(F.lit("grunge")))
