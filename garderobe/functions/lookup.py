"""Vocabulary lookups as Column expressions: the maps are constants, so they are inlined, not joined."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe import vocab as v


def sql_literal(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else repr(x)


def inline_map(table: dict) -> Column:
    """A constant map, sent to the JVM as one expression instead of one call per entry."""
    return F.expr("map(" + ", ".join(sql_literal(x) for x in chain.from_iterable(table.items())) + ")")


def inline_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(x) for x in values) + ")")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(inline_map(table), key)


def clean(text: Column) -> Column:
    return F.lower(F.trim(text))


def slot_for_label(label: Column) -> Column:
    return lookup(v.LABEL_SLOT, clean(label))


def fashion_slot(category: Column) -> Column:
    return lookup(v.CATALOG_SLOT, clean(category))


def coarse_slot(category: Column) -> Column:
    return F.coalesce(lookup(v.COARSE_SLOT, F.lower(category)), F.lit("other"))


def slot_position(slot: Column) -> Column:
    """0-based display position; 99 for unknown slots."""
    return F.coalesce(lookup({s: i for i, s in enumerate(v.SLOTS)}, slot), F.lit(99))


def labels_for_slot(spark: SparkSession, slot: str | None = None) -> DataFrame:
    table = spark.createDataFrame(list(v.LABEL_SLOT.items()), "label string, slot string")
    return table if slot is None else table.filter(F.col("slot") == slot)


def item_label(label: Column, category: Column) -> Column:
    return F.coalesce(F.when(label != "", label), category)


def display_name(colour: Column, label: Column, category: Column) -> Column:
    return F.concat_ws(" ", F.when(colour != "", colour), item_label(label, category))


def short_id(item_id: Column) -> Column:
    return F.concat(F.lit("#"), F.substring(item_id, 1, 4))


def map_detected_category(label: Column) -> Column:
    flat = {word: cat for cat, words in v.DETECTED_CATEGORY.items() for word in words}
    return F.coalesce(lookup(flat, F.lower(label)), F.lit("accessories"))


def hash_int(text: Column, digits: int = 8) -> Column:
    """Non-negative integer from a sha1 prefix: the same in every engine and under any partitioning."""
    return F.conv(F.substring(F.sha1(text), 1, digits), 16, 10).cast("bigint")


def hash_unit(text: Column) -> Column:
    return hash_int(text) / F.lit(4294967295.0)
