"""Places in an order that is cut into ranges, and the query that ranks every candidate."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from garderobe.operators import spread
from garderobe.registry import load


@pytest.mark.parametrize("rows", (200_000, 7))
def test_places_equal_one_window(spark, monkeypatch, rows):
    """Ties, rows without a score and without a key; with small ranges a key is cut."""
    monkeypatch.setattr(spread, "RANGE_ROWS", rows)
    data = [(None if i % 9 == 0 else i % 2, None if i % 10 == 7 else (i * 7 % 23) / 4, f"t{i:03d}") for i in range(150)]
    df = spark.createDataFrame(data, "k long, score double, tie string")
    order = Window.partitionBy("k").orderBy(F.col("score").desc(), "tie")
    want = sorted(map(str, df.withColumn("at", F.row_number().over(order).cast("bigint")).collect()))
    assert sorted(map(str, spread.places(df, ["k"], "score", ["tie"], "at").collect())) == want


def test_a_very_large_group_gets_few_blocks(spark, monkeypatch):
    """Every row is copied for every block, so 300 rows at 2 a block are not 150 blocks; no pair is lost."""
    monkeypatch.setattr(spread, "BLOCK_ROWS", 2)
    rows = spark.range(300).selectExpr("id % 1 as k", "cast(id as string) as item_id").unionByName(spark.range(3).selectExpr("1L as k", "cast(id as string) as item_id"))
    met = spread.pair_join(rows, rows, ["k"], ["item_id"], lambda a, b: a("item_id") < b("item_id"), select=lambda a, b: [a("item_id").alias("a"), b("item_id").alias("b")])
    counts = {r.k: (r.n, r.blocks) for r in met.groupBy("k").agg(F.countDistinct("a", "b").alias("n"), F.countDistinct("_bi").alias("blocks")).collect()}
    assert counts[0][0] == met.filter("k = 0").count() == 300 * 299 // 2 and counts[0][1] == 19
    assert counts[1][0] == 3


def tables(folder, n=24):
    """One wardrobe of ``n`` garments of three slots, and the seven vectors that styles need."""
    rng = np.random.default_rng(1)
    ids = sorted({*range(7), *range(0, 20 * n, 20)})
    vectors = rng.normal(size=(len(ids), 64)) + 1.0
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    pd.DataFrame({"vec_id": np.array(ids, dtype="int64"), "embedding": [list(x) for x in vectors.astype("float32")]}).to_parquet(f"{folder}/embeddings.parquet")
    kinds = ["STANDARD", "MEDIUM", "SMALL"]
    parts = {"p_partkey": np.array(ids, dtype="int64"), "p_name": [f"part {i}" for i in ids], "p_type": [kinds[i // 20 % 3] for i in ids], "p_size": np.array([i % 7 * 10 + 5 for i in ids])}
    pd.DataFrame(parts).to_parquet(f"{folder}/part.parquet")


def test_every_candidate_is_ranked(spark, tmp_path):
    tables(tmp_path)
    queries, sql = load()
    found = queries["rank_candidates"](spark, str(tmp_path)).filter("wardrobe_id = 0").orderBy("position").collect()
    strong = queries["quality_threshold"](spark, str(tmp_path)).filter("wardrobe_id = 0")
    assert len(found) == strong.count() > 20
    assert [r.position for r in found] == list(range(1, len(found) + 1))
    assert all(x["rank"] >= y["rank"] for x, y in zip(found, found[1:]))
    assert {r.members for r in found} == {r.members for r in strong.collect()}
    assert "position <=" not in sql["rank_candidates"]
