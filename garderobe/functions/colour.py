"""Colour naming and harmony as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions.lookup import lookup


def primary_color(colours: Column) -> Column:
    return F.get(colours, F.lit(0)).getField("name")


def hex_channel(hexv: Column, start: int) -> Column:
    return F.conv(F.substring(hexv, start, 2), 16, 10).cast("double")


def lightness(hexv: Column) -> Column:
    """Relative luminance of ``#rrggbb``; null for anything else."""
    weights = ((2, 0.2126), (4, 0.7152), (6, 0.0722))
    value = reduce(lambda p, q: p + q, [F.lit(w) * (hex_channel(hexv, at) / 255.0) for at, w in weights])
    return F.when(F.length(hexv) == 7, value)


def hue_distance(a: Column, b: Column) -> Column:
    gap = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(gap, F.lit(360.0) - gap)


def hue(name: Column) -> Column:
    return lookup(v.HUES, name)


def is_neutral(name: Column) -> Column:
    return name.isin(*v.NEUTRALS)


def relation(name_a: Column, light_a: Column, name_b: Column, light_b: Column) -> Column:
    """How two primary colours relate; null when either is unknown."""
    sides = [(n, x, is_neutral(n), hue(n)) for n, x in ((name_a, light_a), (name_b, light_b))]
    return relation_of(*sides)


def relation_of(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The same from (name, lightness, neutral, hue) of each side, for many pairs of items that know theirs."""
    (name_a, light_a, neutral_a, hue_a), (name_b, light_b, neutral_b, hue_b) = a, b
    contrast = F.abs(light_a - light_b)
    gap = hue_distance(hue_a, hue_b)
    far_apart = F.coalesce(contrast >= 0.30, F.lit(False))
    shaded = F.coalesce(contrast >= 0.20, F.lit(False))
    return (
        F.when(name_a.isNull() | name_b.isNull(), F.lit(None))
        .when(neutral_a & neutral_b & far_apart, "neutral_contrast")
        .when(neutral_a & neutral_b & (name_a == name_b), "tone_on_tone")
        .when(neutral_a & neutral_b, "low_contrast_neutrals")
        .when(neutral_a | neutral_b, "accent_with_neutral")
        .when((name_a == name_b) & shaded, "monochrome")
        .when(name_a == name_b, "tone_on_tone")
        .when(gap <= 45, "analogous")
        .when(gap.between(150, 210), "complementary")
        .otherwise("conflicting")
    )


def relation_score(rel: Column) -> Column:
    return lookup(v.RELATION_SCORE, rel)


def relation_text(rel: Column, name_a: Column, name_b: Column) -> Column:
    return F.concat(lookup(v.RELATION_TEXT, rel), F.lit(" ("), name_a, F.lit(" + "), name_b, F.lit(")"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in [0, 1] from 0-255 channels."""
    r, g, b = (c.cast("double") / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    # Same operation order as the standard library's rgb_to_hsv: hues on a rule boundary must agree with it.
    far_r, far_g, far_b = ((top - c) / span for c in (r, g, b))
    sector = (
        F.when(span == 0, F.lit(0.0))
        .when(r == top, far_b - far_g)
        .when(g == top, F.lit(2.0) + far_r - far_b)
        .otherwise(F.lit(4.0) + far_g - far_r)
    )
    hue = F.pmod(sector / 6.0, F.lit(1.0)) * 360.0
    sat = F.when(top == 0, F.lit(0.0)).otherwise(span / top)
    return hue, sat, top


def rgb_to_name(r: Column, g: Column, b: Column) -> Column:
    """Coarse colour name; the rules are tried in order, first match wins."""
    h, s, val = rgb_to_hsv(r, g, b)
    reddish = (h < 12) | (h >= 345)
    dark, deep = val < 0.20, (val >= 0.08) & (s >= 0.55)
    rules = [
        (dark & deep & (h >= 195) & (h < 255), "navy"),
        (dark & deep & reddish, "burgundy"),
        (dark, "black"),
        (((s < 0.12) | ((s < 0.20) & (val < 0.40))) & (val > 0.85), "white"),
        ((s < 0.12) | ((s < 0.20) & (val < 0.40)), "gray"),
        ((h >= 18) & (h < 60) & (s < 0.40) & (val > 0.50), "beige"),
        ((h >= 8) & (h < 45) & (val < 0.62), "brown"),
        ((h >= 45) & (h < 80) & (val < 0.55), "olive"),
        (reddish & (val < 0.45), "burgundy"),
        (reddish & (s < 0.45) & (val > 0.75), "pink"),
        (reddish, "red"),
        (h < 40, "orange"),
        (h < 68, "yellow"),
        (h < 165, "green"),
        (h < 195, "teal"),
        ((h < 255) & (val < 0.45), "navy"),
        ((h < 255) & (s < 0.45) & (val > 0.70), "light blue"),
        (h < 255, "blue"),
        (h < 290, "purple"),
    ]
    chain = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for condition, name in rules[1:]:
        chain = chain.when(condition, F.lit(name))
    return chain.otherwise("pink")
