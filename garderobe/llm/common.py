"""What several text operators share: reading tables, written intermediate tables, word rules, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.session import ensure_checkpoint_dir

#: A word: a run without ASCII white space. Python's ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_array(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Stash:
    """Tables written as Parquet to the folder in ``spark.checkpoint.dir``: they survive lost executors and cut the plan."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.top = f"{spark.sparkContext.getCheckpointDir()}/stash-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.top}/{self.count:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that this object wrote, once nothing lazy refers to it."""
        jvm, own = self.spark._jvm, self.top.rsplit("/", 1)[-1]
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if own in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` as one struct ``row`` beside the ``columns`` that a step reads, so that no other name can clash;
    ``select("row.*")`` gives the columns back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """Connected components of ``edges`` (a, b) by alternating large and small stars, until nothing changes.

    Returns (node, root) for every node that has a smaller one in its component; the root is the smallest node.
    Minima are combined before the shuffle and the joins are plain equi-joins, so a hub is split like any skewed key.
    """

    def pairs(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def sign(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stash.keep(pairs(edges))
    seen = sign(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = stash.keep(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stash.keep(pairs(small.unionByName(low.select("a", F.col("m").alias("b")))))
        stash.drop(large)
        stash.drop(now)
        now, before, seen = after, seen, sign(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
