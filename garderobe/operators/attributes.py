"""Cleaning of model-written attribute text: JSON recovery, normalisation, corrections, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe import vocab as v

REVIEW_CONFIDENCE = 0.7


def parse_llm_json(text: Column) -> Column:
    """Map of the JSON object inside chatty output: fences stripped, outermost braces taken; null if none parses.

    Values stay text (nested values as JSON text), so one odd field never loses the others.
    """
    bare = F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", "")
    bare = F.regexp_replace(bare, r"\s*```$", "")
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(span != "", span), "map<string,string>")


def _field(raw: Column, name: str) -> Column:
    return F.try_element_at(raw, F.lit(name))


def text_field(raw: Column, name: str) -> Column:
    value = F.trim(F.coalesce(_field(raw, name), F.lit("unknown")))
    return F.when(value == "", "unknown").otherwise(value)


def list_field(raw: Column, name: str, limit: int | None = None) -> Column:
    """A list, or a single text as a one-element list; trimmed, lower-cased, blanks dropped; with ``limit``, the first ones."""
    value = F.trim(F.coalesce(_field(raw, name), F.lit("")))
    parsed = F.from_json(F.when(value.startswith("["), value), "array<string>")
    words = F.coalesce(parsed, F.when((value != "") & ~value.startswith("[") & ~value.startswith("{"), F.array(value)))
    clean = F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: w != "")
    whole = F.coalesce(clean, F.array().cast("array<string>"))
    return whole if limit is None else F.slice(whole, 1, limit)


def normalize_attributes(raw: Column, detected: Column | None = None, limits: dict[str, int] | None = None) -> Column:
    """Struct of cleaned attributes with defaults, formality whitelist and clamped confidence; lists are whole unless
    ``limits`` (such as ``vocab.ATTRIBUTE_LIMITS``) cuts them."""
    formality = F.lower(text_field(raw, "formality"))
    category = F.lower(text_field(raw, "category"))
    if detected is not None:
        category = F.when((category == "unknown") & (F.coalesce(detected, F.lit("")) != ""), detected).otherwise(category)
    number = F.coalesce(F.trim(_field(raw, "confidence")).try_cast("double"), F.lit(0.0))
    confidence = F.when(number < 0, F.lit(0.0)).when(number > 1, F.lit(1.0)).otherwise(number)
    return F.struct(
        category.alias("category"),
        *[text_field(raw, n).alias(n) for n in ("garment_type", "pattern", "material", "fit")],
        F.when(formality.isin(*v.FORMALITIES), formality).otherwise("unknown").alias("formality"),
        *[list_field(raw, n, (limits or {}).get(n)).alias(n) for n in v.ATTRIBUTE_LIMITS],
        confidence.alias("confidence"),
    )


def apply_corrections(items: DataFrame, answers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Review answers ``(item_id, answer)``: blank or "s" accepts, else "key=value, key=value" overwrites known fields."""
    a = answers.select("item_id", F.trim("answer").alias("_a"))
    parts = F.transform(
        F.filter(F.split("_a", ","), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")
        ),
    )
    out = items.join(a, "item_id", "left").withColumn("_p", parts)
    answered, corrected = F.col("_a").isNotNull(), ~F.lower("_a").isin("", "s")
    last = lambda f: F.try_element_at(F.filter("_p", lambda p: p["k"] == f), F.lit(-1))["v"]
    flagged = F.col("needs_review")
    out = out.withColumns({f: F.when(flagged & answered & corrected, F.coalesce(last(f), F.col(f))).otherwise(F.col(f)) for f in fields})
    return (
        out.withColumn("human_corrected", flagged & answered & F.coalesce(corrected, F.lit(False)))
        .withColumn("needs_review", flagged & ~answered)
        .drop("_a", "_p")
    )


def split_review_queue(items: DataFrame, minimum: float = REVIEW_CONFIDENCE) -> DataFrame:
    return items.withColumn("needs_review", F.col("confidence") < minimum)
