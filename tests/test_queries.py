"""Registered queries against their SQL. A quick selection on the smallest tables; ``ORACLE=all`` runs every one."""

import os

import pytest

import __spark_entry__ as entrypoint
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = (
    "scan_items eligible_items page_items edit_items wardrobe_diagnostics style_scores recommend_for_item find_duplicates item_conflicts "
    "outfit_plausibility outfit_colour_summary best_layer structural_validity item_split_pairs item_disjoint_stats split_leakage "
    "category_distribution image_stats running_counts classification_metrics group_regions parse_llm_json rank_outfit stream_category_counts"
).split()
NAMES = list(entrypoint.oracle_sql()) if os.environ.get("ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry_is_consistent():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry(spark):
    df = entrypoint.entry(spark)
    assert df.count() > 0 and "item_ids" in df.columns
