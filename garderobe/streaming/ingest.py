"""Structured Streaming forms of the arrival loop: ingest with duplicate flags, re-delivery, live counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.operators.duplicates import flag_duplicates, flag_earlier
from garderobe.session import cut_lineage, ensure_checkpoint_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the cluster's checkpoints, so that every executor can reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream_dedup(stream: DataFrame, time: str = "ts", key: str = "id", delay: str = "1 hour") -> DataFrame:
    """Drop a record delivered again within ``delay``; state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_category_counts(stream: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Arrivals and review backlog per tumbling window and category, emitted once a window is closed."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width), "category")
        .agg(F.count(F.lit(1)).alias("n_items"), F.count_if("needs_review").alias("n_review"))
        .select(F.col("window.start").alias("start"), "category", "n_items", "n_review")
    )


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Process what is available, append it to a Parquet table and read that back."""
    path = work_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def stream_ingest(stream: DataFrame, stored: DataFrame, spark: SparkSession, name: str = "items") -> str:
    """Append arriving items to a table, flagging (never dropping) likely duplicates of the items before them.

    The table starts with ``stored``. An item is compared with what is stored and with the earlier items of its batch,
    in order of (created_at, item_id): for items that arrive in this order the flags don't depend on how the stream is
    cut. A batch is written to its own folder, so a batch that is run again after a failure replaces itself. Returns
    the table path.
    """
    path = work_path(spark, name)
    blank = stored.withColumn("possible_duplicates", F.lit(0).cast("bigint")).withColumn("possible_duplicate_of", F.lit(None).cast("string"))
    blank.write.parquet(f"{path}/data/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{path}/data").filter(F.col("batch") < number).drop("batch")
        batch = cut_lineage(batch)
        flagged = flag_duplicates(batch, before.select(*batch.columns))
        flagged = flagged.join(flag_earlier(batch), ["wardrobe_id", "category", "item_id"], "left")
        flagged = flagged.withColumn("possible_duplicates", F.col("possible_duplicates") + F.coalesce("earlier", F.lit(0)))
        flagged = flagged.withColumn("possible_duplicate_of", F.least("first_twin", "first_earlier")["item_id"])
        flagged.select(*before.columns).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/data"
