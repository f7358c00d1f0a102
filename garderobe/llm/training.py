"""Folds and bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts above this length are left out of a training sample (never out of a prediction), to bound the driver.
LONGEST = 50_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def clear_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): ids whose labels agree; nulls and contradictions are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    per = known.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
    return per.where("label = other").select("doc_id", "label")


def pick(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``ids``, the ones with the smallest hashes of their ids."""
    return ids.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)


def texts_of(docs: DataFrame, picked: DataFrame) -> list:
    """Rows (doc_id, text, columns of ``picked``) on the driver. ``picked`` is bounded by ``pick``, so it is broadcast;
    a repeated id gives one text."""
    slim = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)
    return slim.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
