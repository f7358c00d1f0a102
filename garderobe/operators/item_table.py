"""A stored item table whose changes rewrite only the parts that hold changed items.

An item's part follows from hashes of its wardrobe and of its id, so a wardrobe has ``slices`` parts and a very large one
is spread over all of them. Inserts append files. Updates, edits and deletions read the parts of the named items and
replace these with Spark's dynamic partition overwrite; the files of every other part stay as they are. A rewritten part
carries one marker row, so that a part whose items are all gone is replaced as well.

An item is named by (wardrobe_id, item_id). Change tables without ``wardrobe_id`` are located by a join on the ids. A null
wardrobe is a wardrobe like any other; an item without an id is refused by ``insert`` and never changed. The table has one
writer at a time, and DataFrames read before a change must be read again after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.operators import wardrobe
from garderobe.session import cut_lineage

KEY = ("wardrobe_id", "item_id")
ITEMS_PER_PART = 500_000


def same_item(a: str, b: str) -> Column:
    return F.col(f"{a}.wardrobe_id").eqNullSafe(F.col(f"{b}.wardrobe_id")) & (F.col(f"{a}.item_id") == F.col(f"{b}.item_id"))


def one_per_item(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row per named item: each field takes its last value by ``order``, without one its largest; null says nothing."""
    fields = [c for c in rows.columns if c not in (*KEY, order)]

    def last(c: str) -> Column:
        return F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))

    named = rows.filter(F.col("item_id").isNotNull())
    return named.groupBy(*KEY).agg(*[last(c).alias(c) for c in fields]) if fields else named.select(*KEY).distinct()


class ItemTable:
    """``create`` stores a table, the constructor opens one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = f"{path}/items"
        layout = spark.read.json(f"{path}/layout").first()
        self.buckets, self.slices = layout["buckets"], layout["slices"]

    @classmethod
    def create(cls, items: DataFrame, path: str, buckets: int | None = None, slices: int = 8) -> ItemTable:
        """Store ``items``; without ``buckets`` their number grows with the rows (``ITEMS_PER_PART`` in each part)."""
        spark = items.sparkSession
        if buckets is None:
            buckets = max(1, -(-items.count() // (ITEMS_PER_PART * slices)))
        layout = spark.createDataFrame([(buckets, slices)], "buckets int, slices int")
        layout.coalesce(1).write.json(f"{path}/layout")
        table = cls(spark, path)
        marker = spark.createDataFrame([(0, True)], "_part int, _marker boolean")  # an empty table has columns, too
        rows = table._placed(items.withColumn("_marker", F.lit(False))).unionByName(marker, allowMissingColumns=True)
        rows.repartition("_part").write.partitionBy("_part").parquet(table.path)
        return table

    # -------------------------------------------------------------- reading
    def part(self, wardrobe_id: Column, item_id: Column) -> Column:
        bucket = F.pmod(F.xxhash64(wardrobe_id), F.lit(self.buckets))
        return (bucket * self.slices + F.pmod(F.xxhash64(item_id), F.lit(self.slices))).cast("int")

    def _raw(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._raw().filter(~F.col("_marker")).drop("_marker", "_part")

    def wardrobe(self, wardrobe_id) -> DataFrame:
        """One wardrobe; only its ``slices`` parts are listed and read."""
        raw = self._raw()
        value = F.lit(wardrobe_id).cast(raw.schema["wardrobe_id"].dataType)
        bucket = F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")
        own = (F.col("_part") >= bucket * self.slices) & (F.col("_part") < (bucket + 1) * self.slices)
        kept = raw.filter(own).filter(F.col("wardrobe_id").eqNullSafe(value) & ~F.col("_marker"))
        return kept.drop("_marker", "_part")

    # -------------------------------------------------------------- changes
    def insert(self, new: DataFrame, strict: bool = True) -> None:
        """Append items. An id that the wardrobe has, or that comes twice, or is null, is an error before anything is
        stored; when not ``strict`` the stored item, or one of equals by the least hash of its fields, stays."""
        columns = self.read().columns
        row = F.struct(*columns)
        one = new.groupBy(*KEY).agg(F.min_by(row, F.xxhash64(row)).alias("_row"), F.count(F.lit(1)).alias("_times"))
        one = cut_lineage(one)
        known = self._in(self._parts(one)).select(*KEY, F.lit(True).alias("_known")).alias("k")
        marked = (
            one.alias("n")
            .join(known, same_item("n", "k"), "left")
            .select("n.*", F.coalesce("k._known", F.lit(False)).alias("_known"))
        )
        bad = F.col("_known") | F.col("item_id").isNull() | (F.col("_times") > 1)
        if strict:
            message = F.concat(F.lit("Item "), F.coalesce(F.col("item_id").cast("string"), F.lit("without id")), F.lit(" already exists"))
            kept = marked.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        else:
            kept = marked.filter(~F.col("_known") & F.col("item_id").isNotNull())
        added = kept.select("_row.*").withColumn("_marker", F.lit(False))
        self._placed(added).repartition("_part").write.partitionBy("_part").mode("append").parquet(self.path)

    def update(self, changes: DataFrame, order: str | None = None) -> None:
        """Overwrite the given fields of the named items; null leaves a field as it is."""
        changes = one_per_item(self._located(changes), order)
        self._replace(changes, lambda old, own: self._keyed(old, own, wardrobe.update_items))

    def edit(self, edits: DataFrame, order: str | None = None) -> None:
        """User edits (category, style, label) with the rules of ``wardrobe.edit_items``."""
        edits = one_per_item(self._located(edits), order)
        self._replace(edits, lambda old, own: self._keyed(old, own, wardrobe.edit_items))

    def delete(self, ids: DataFrame) -> int:
        """Remove the named items and say how many there were."""
        ids = cut_lineage(one_per_item(self._located(ids.select(*[c for c in KEY if c in ids.columns]))))
        gone = self._in(self._parts(ids)).alias("o").join(ids.alias("i"), same_item("o", "i"), "left_semi").count()
        if gone:
            self._replace(ids, lambda old, own: old.alias("o").join(own.alias("i"), same_item("o", "i"), "left_anti"))
        return gone

    # -------------------------------------------------------------- parts
    def _located(self, changes: DataFrame) -> DataFrame:
        if "wardrobe_id" in changes.columns:
            return changes
        return changes.join(self.read().select(*KEY), "item_id")

    def _parts(self, keys: DataFrame) -> list[int]:
        """The parts of the named items: at most buckets times slices numbers."""
        return [r[0] for r in keys.select(self.part(*map(F.col, KEY))).distinct().collect()]

    def _in(self, parts: list[int]) -> DataFrame:
        return self._raw().filter(F.col("_part").isin(parts) & ~F.col("_marker"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", self.part(*map(F.col, KEY)))

    @staticmethod
    def _keyed(old: DataFrame, own: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Apply a change that names items by ``item_id`` alone, with the whole key in its place."""
        whole = F.struct(*KEY)
        kept = old.withColumn("_id", F.col("item_id")).withColumn("item_id", whole)
        changed = change(kept, own.withColumn("item_id", whole).drop("wardrobe_id"))
        return changed.withColumn("item_id", F.col("_id")).drop("_id")

    def _replace(self, keys: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        keys = cut_lineage(keys)
        parts = self._parts(keys)
        if not parts:
            return
        old = self._in(parts).drop("_part")
        changed = self._placed(change(old, keys).select(*old.columns))
        markers = self.spark.createDataFrame([(p, True) for p in parts], "_part int, _marker boolean")
        whole = cut_lineage(changed.unionByName(markers, allowMissingColumns=True).repartition("_part"))
        whole.write.partitionBy("_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
