"""Arrivals with state: likely duplicates are found among the vectors that Spark's state store holds, not by reading the
table again for every batch."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from garderobe import vocab as v
from garderobe.streaming.ingest import work_path

KEYS = ["wardrobe_id", "category"]
#: Leading components of a vector that place it in the grid of cells; each component triples the copies of a probe.
AXES = 2
#: Comparisons in one block of a matrix product.
BLOCK = 4_000_000
HELD = "ats array<string>, ids array<string>, dim int, vectors binary"
FOUND = "wardrobe_id long, category string, item_id string, at string, n long, first string"


def cell_width(cosine: float = v.DUPLICATE_COSINE) -> float:
    """Unit vectors with this cosine are no further apart in any component; norms may be off by 2 %."""
    return math.sqrt(2 * 1.02**2 - 2 * cosine + 1e-6)


def cells(embedding: Column, width: float, axes: int = AXES) -> Column:
    """The cell of a vector and the cells around it: structs of (cell, whether it is the vector's own)."""
    own = [F.floor(F.coalesce(F.get(embedding, F.lit(i)), F.lit(0.0)).cast("double") / width) for i in range(axes)]
    around = []
    for steps in product((-1, 0, 1), repeat=axes):
        name = F.concat_ws(":", *[(c + s).cast("string") for c, s in zip(own, steps)])
        around.append(F.struct(name.alias("cell"), F.lit(all(s == 0 for s in steps)).alias("own")))
    return F.array(*around)


def _twins(probe: pd.DataFrame, ats: list[str], ids: list[str], held: np.ndarray, old: int, cosine: float) -> list[tuple[int, str | None]]:
    """Per probe how many held vectors are near it and the first of them; of those that came with the same batch (behind
    ``old``) only earlier items count."""
    mine = np.stack(probe["embedding"].to_list()).astype(np.float64)
    marks = [f"{a}|{i}" for a, i in zip(ats, ids)]
    out = []
    step = max(1, BLOCK // max(1, len(held)))
    for first in range(0, len(mine), step):
        near = mine[first : first + step] @ held.T >= cosine
        for row, (at, item) in enumerate(zip(probe["at"].iloc[first : first + step], probe["item_id"].iloc[first : first + step])):
            own = f"{at}|{item}"
            hits = [marks[j] for j in np.flatnonzero(near[row]) if j < old or marks[j] < own]
            out.append((len(hits), min(hits, default=None)))
    return out


def watch(cosine: float):
    """The function of a state group, a cell of one wardrobe and category: holds the vectors that lie in it."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        blank = rows["embedding"].isna()
        ats, ids, dim, blob = state.get if state.exists else ([], [], 0, b"")
        ats, ids, held = list(ats), list(ids), np.frombuffer(blob, np.float64).reshape(len(ats), -1) if len(ats) else None
        old = len(ats)
        new = rows[rows["own"] & ~blank].sort_values(["at", "item_id"])
        if len(new):
            added = np.stack(new["embedding"].to_list()).astype(np.float64)
            held = added if held is None else np.concatenate([held, added])
            ats, ids = ats + new["at"].tolist(), ids + new["item_id"].tolist()
            state.update((ats, ids, held.shape[1], held.tobytes()))
        asked = rows[~blank]
        found = _twins(asked, ats, ids, held, old, cosine) if held is not None and len(asked) else [(0, None)] * len(asked)
        out = pd.DataFrame({"wardrobe_id": key[0], "category": key[1], "item_id": asked["item_id"], "at": asked["at"], "n": [n for n, _ in found], "first": [f for _, f in found]})
        none = rows[blank]
        yield pd.concat([out, pd.DataFrame({"wardrobe_id": key[0], "category": key[1], "item_id": none["item_id"], "at": none["at"], "n": 0, "first": None})], ignore_index=True).astype({"n": "int64", "first": "object"})

    return run


def stream_arrivals(stream: DataFrame, spark: SparkSession, name: str = "arrivals", cosine: float = v.DUPLICATE_COSINE, axes: int = AXES) -> str:
    """Flag (never drop) likely duplicates of ``stream`` (wardrobe_id, category, item_id, created_at, embedding) among all
    items that came before; returns the path of the flags.

    An item's vector is kept in the state of its cell and looked up in the cells around it, which hold every vector that
    can be near. A cell of one wardrobe and category is one state, so a large wardrobe is spread over its cells and a batch
    reads the states it touches alone. Items of one batch count in order of (created_at, item_id): items that arrive in
    this order get the same flags however the stream is cut. What a wardrobe holds already has to arrive first. A batch is
    written to its own folder, so one that runs again replaces itself; an item without a vector has no duplicates.
    """
    path = work_path(spark, name)
    width = cell_width(cosine)
    rows = stream.select("wardrobe_id", "category", "item_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "embedding")
    rows = rows.withColumn("c", F.explode(F.when(F.col("embedding").isNotNull(), cells(F.col("embedding"), width, axes)).otherwise(F.array(F.struct(F.lit("").alias("cell"), F.lit(True).alias("own"))))))
    rows = rows.select("wardrobe_id", "category", "item_id", "at", "embedding", "c.cell", "c.own")
    found = rows.groupBy(*KEYS, "cell").applyInPandasWithState(watch(cosine), FOUND, HELD, "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> None:
        flags = batch.groupBy(*KEYS, "item_id", "at").agg(F.sum("n").alias("possible_duplicates"), F.min("first").alias("first"))
        flags = flags.withColumn("possible_duplicate_of", F.expr("substring(first, 28)")).drop("first", "at")
        flags.write.mode("overwrite").parquet(f"{path}/flags/batch={number}")

    query = found.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/flags"
