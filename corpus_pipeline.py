"""The corpus pipeline: quality, near-duplicates, benchmark leaks, the mix of sources, token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from garderobe.llm import decontaminate, mixing, quality, simhash, tokens
from garderobe.llm.common import Stash, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8 or more) the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, k=5, similarity=0.8)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of fixed length in training order."""
    return tokens.training_order(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_unleaked),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: The classifier, the fingerprints and the tokeniser can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again before the next."""
    stash, docs = Stash(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
