"""The stored item table: only parts with changed items are rewritten, results equal the snapshot functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from garderobe.operators.item_table import ItemTable

ITEM = "wardrobe_id long, item_id string, category string, label string, style string, style_scores array<double>, review_status string"


def rows_of(df):
    return {(r["wardrobe_id"], r["item_id"]): r for r in df.collect()}


def files(table):
    found = table._raw().select("_part", F.input_file_name().alias("file")).distinct().collect()
    return {(r["_part"], r["file"]) for r in found}


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(w, f"i{n}", "top", f"l{n}", "casual", [1.0, 0.0], "auto") for w in (1, 2, 3, None) for n in range(40)]
    rows += [(9, f"h{n}", "top", "hot", None, None, "auto") for n in range(400)]
    return ItemTable.create(spark.createDataFrame(rows, ITEM), str(tmp_path / "t"), buckets=4, slices=4)


def test_layout_spreads_a_hot_wardrobe_and_prunes(spark, table):
    assert table.read().count() == 560
    hot = table._raw().filter("wardrobe_id = 9").groupBy("_part").count().collect()
    assert len(hot) == 4 and max(r["count"] for r in hot) < 200
    assert table.wardrobe(9).count() == 400 and table.wardrobe(None).count() == 40 and table.wardrobe(77).count() == 0
    plan = table.wardrobe(9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan
    again = ItemTable(spark, table.path.removesuffix("/items"))
    assert (again.buckets, again.slices) == (4, 4)


def test_update_rewrites_only_the_parts_of_changed_items(spark, table):
    before, old = files(table), rows_of(table.read())
    changes = [(2, "i5", "new", None), (None, "i6", "lone", "formal"), (2, "gone", "x", None)]
    table.update(spark.createDataFrame(changes, "wardrobe_id long, item_id string, label string, style string"))
    after, new = files(table), rows_of(table.read())
    touched = {r[0] for r in spark.createDataFrame(changes, "w long, i string, l string, s string").select(table.part(F.col("w"), F.col("i"))).collect()}
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
    assert {f for f in before if f[0] not in touched}
    assert {k for k in old if old[k] != new[k]} == {(2, "i5"), (None, "i6")} and set(old) == set(new)
    assert new[(2, "i5")]["label"] == "new" and new[(2, "i5")]["style"] == "casual"
    assert new[(1, "i5")]["label"] == "l5"  # the same id in another wardrobe


def test_update_without_wardrobe_reaches_every_item_of_the_id(spark, table):
    table.update(spark.createDataFrame([("i7", "seven")], "item_id string, label string"))
    new = rows_of(table.read())
    assert [new[(w, "i7")]["label"] for w in (1, 2, 3)] == ["seven"] * 3
    assert len(new) == 560


def test_repeated_changes_of_an_item(spark, table):
    changes = [(1, "i1", "b", None, 1), (1, "i1", "a", None, 2), (1, "i1", None, "formal", 0)]
    schema = "wardrobe_id long, item_id string, label string, style string, at int"
    table.update(spark.createDataFrame(changes, schema), order="at")
    got = rows_of(table.read())
    assert (got[(1, "i1")]["label"], got[(1, "i1")]["style"]) == ("a", "formal") and len(got) == 560
    table.update(spark.createDataFrame(changes, schema).drop("at"))
    assert rows_of(table.read())[(1, "i1")]["label"] == "b"


def test_edit_confirms_and_renames(spark, table):
    table.edit(spark.createDataFrame([(3, "i2", "shoes", None, None)], "wardrobe_id long, item_id string, category string, style string, label string"))
    got = rows_of(table.read())[(3, "i2")]
    assert (got["category"], got["label"], got["review_status"]) == ("shoes", "shoes", "confirmed")


def test_delete_empties_whole_parts_and_counts(spark, table):
    before = files(table)
    assert table.delete(table.read().filter("wardrobe_id = 9")) == 400
    assert table.read().filter("wardrobe_id = 9").count() == 0 and table.read().count() == 160
    assert table.delete(spark.createDataFrame([("i0",), ("none",), (None,)], "item_id string")) == 4
    assert table.delete(spark.createDataFrame([(None, "i1"), (None, None), (4, "i1")], "wardrobe_id long, item_id string")) == 1
    assert table.read().count() == 155
    kept = files(table)
    assert table.delete(spark.createDataFrame([], "item_id string")) == 0 and files(table) == kept != before


def test_insert_appends_and_refuses_known_ids(spark, table):
    before = files(table)
    fresh = [(1, "n1", "top", "a", None, None, "auto"), (5, "n1", "top", "b", None, None, "auto")]
    table.insert(spark.createDataFrame(fresh, ITEM))
    assert files(table) > before and table.read().count() == 562
    mixed = [(1, "n1", "top", "c", None, None, "auto"), (1, "n2", "top", "d", None, None, "auto"),
             (1, "n2", "top", "d", None, None, "auto"), (1, None, "top", "e", None, None, "auto")]
    stored = files(table)
    for bad in ([mixed[0]], [mixed[1], mixed[2]], [mixed[3]]):
        with pytest.raises(Exception, match="already exists"):
            table.insert(spark.createDataFrame(bad, ITEM))
    assert files(table) == stored
    table.insert(spark.createDataFrame(mixed, ITEM), strict=False)
    got = rows_of(table.read())
    assert len(got) == 563 and got[(1, "n1")]["label"] == "a" and got[(1, "n2")]["label"] == "d"


def test_empty_table_and_growing_buckets(spark, tmp_path, monkeypatch):
    from garderobe.operators import item_table

    empty = ItemTable.create(spark.createDataFrame([], ITEM), str(tmp_path / "e"))
    assert (empty.buckets, empty.slices) == (1, 8)
    monkeypatch.setattr(item_table, "ITEMS_PER_PART", 10)
    rows = [(n, f"i{n}", "top", None, None, None, "auto") for n in range(161)]
    assert ItemTable.create(spark.createDataFrame(rows, ITEM), str(tmp_path / "g")).buckets == 3
