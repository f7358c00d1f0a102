"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from garderobe.llm import bpe, debruijn, decontaminate, language, mixing, prefixes, quality, resample, rules, simhash, suffixes, tokens, toxicity
from garderobe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op4_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeated_words(table(spark, sf_dir, "documents"))


def op6_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op7_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_word_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_nodes(table(spark, sf_dir, "conversations"))


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded_documents(table(spark, sf_dir, "documents"))


def op13_importance_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.drawn_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    chosen = (
        op1_simhash_windows,
        op2_training_order,
        op3_mix_sources,
        op4_line_crf_quality,
        op5_de_bruijn_substrings,
        op6_suffix_intervals,
        op7_nnpu_toxicity,
        op8_certified_rules,
        op9_simhash_bk_trees,
        op10_word_crf_language,
        op11_prefix_trie,
        op12_chunked_bpe,
        op13_importance_median,
    )
    return {f.__name__: f for f in chosen}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.ORACLE_SQL,
        "op8_certified_rules": rules.ORACLE_SQL,
        "op11_prefix_trie": prefixes.ORACLE_SQL,
        "op13_importance_median": resample.ORACLE_SQL,
    }
