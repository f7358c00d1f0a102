"""Mixing sources to target weights: words per source, repetition rates, floor(rate) copies plus one seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.llm.common import packed, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
EXACT = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size, weight, target and rate.

    Sources in code-point order (null last) take the weights in turn and share the total size. A target stops at
    ``most`` times the size of its source; what is above goes to the others by weight. With the sources ordered by
    cap / weight the stopped ones are a prefix, so the level follows from running sums over one row per source.
    Sizes are compared as exact decimals. A source without words has target 0 and rate 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    slot = (turn - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (slot + 1).cast("int")).cast(EXACT)
    per = per.select("source", "source_size", turn.alias("turn"), weight.alias("w"), (F.col("source_size") * most).cast(EXACT).alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(EXACT)
    per = per.select(
        "*",
        F.sum(F.col("source_size").cast(EXACT)).over(everything).cast(EXACT).alias("total"),
        F.coalesce(F.sum("cap").over(before), none).cast(EXACT).alias("cap_before"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), none)).cast(EXACT).alias("w_left"),
    )
    stopped = (F.col("total") - F.col("cap_before")).cast("double") * F.col("w").cast("double") > F.col("cap").cast("double") * F.col("w_left").cast("double")
    per = per.withColumn("stopped", stopped)
    per = per.select(
        "*",
        F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(none)).over(everything).cast("double").alias("given"),
        F.sum(F.when(~F.col("stopped"), F.col("w")).otherwise(none)).over(everything).cast("double").alias("w_open"),
    )
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise((F.col("total").cast("double") - F.col("given")) * F.col("w").cast("double") / F.col("w_open"))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", F.col("w").cast("int").alias("weight"), "target", rate.alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the key: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def drawn_by(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mix_key``: the id, if it stands in one row. Rows that share an id, and all without one, have the
    MD5 of their text and their number among rows of equal id, source and text besides, so that each draws for itself.
    Those rows alone are numbered, apart in each input partition and shifted by the partitions before."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("mix_shared"), F.lit(True).alias("mix_hot"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if shared.isEmpty():
        return docs.withColumn("mix_key", own)
    marked = docs.withColumn("mix_part", F.spark_partition_id()).join(shared, F.col("doc_id").eqNullSafe(F.col("mix_shared")), "left").drop("mix_shared")
    single = marked.where("mix_hot is null").select(*[F.col(f"`{c}`") for c in docs.columns], own.alias("mix_key"))
    several = marked.where("mix_hot").withColumn("mix_text", F.coalesce(F.md5("text"), F.lit(""))).withColumn("mix_own", own)
    keys = ["mix_own", "mix_text", "mix_source_key"]
    several = several.withColumn("mix_source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    counts = several.groupBy(*keys, "mix_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "mix_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("mix_shift"))
    several = several.withColumn("mix_place", F.row_number().over(Window.partitionBy(*keys, "mix_part").orderBy(F.lit(0)))).join(shifts, [*keys, "mix_part"])
    number = (F.col("mix_place") + F.col("mix_shift")).cast("string")
    several = several.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat_ws(":", "mix_own", "mix_text", number).alias("mix_key"))
    return single.unionByName(several)


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies: how often each row goes into the mix.

    Null text has size 0, a null source is a source of its own, rows that share an id (or have none) draw each for
    itself, see ``drawn_by``. The join with the targets is an equi-join on the source: Spark broadcasts it when the table
    of sources is small and splits skewed keys otherwise. Other columns pass through unchanged; an empty table gives an
    empty result.
    """
    sized = docs.withColumn("mix_size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col("mix_size").alias("size")), weights, most)
    targets = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"))
    whole = F.floor("mix_rate")
    extra = F.when(draw(F.col("mix_key"), seed) < F.col("mix_rate") - whole, 1).otherwise(0)
    keyed = drawn_by(sized)
    joined = keyed.join(targets, keyed["source"].eqNullSafe(targets["mix_source"]), "left")
    return joined.withColumn("mix_copies", (whole + extra).cast("long")).drop("mix_source", "mix_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its count says, with the columns of ``docs``."""
    counted = mix_counts(packed(docs, "doc_id", "text", "source"), **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))
    return counted.select("row", times.alias("turn")).select("row.*")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The digest of the registered query."""
    out = mix_counts(docs.select("doc_id", "text", "source"))
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, '') || CASE WHEN doc_id IS NULL OR count(*) OVER (PARTITION BY doc_id) > 1
      THEN ':' || coalesce(md5(text), '') || ':' || row_number() OVER (PARTITION BY doc_id, text, source) ELSE '' END AS mix_key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), turns AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn FROM per
), weighed AS (
  SELECT *, (CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::HUGEINT AS w, (3 * source_size)::HUGEINT AS cap FROM turns
), sums AS (
  SELECT *, sum(source_size::HUGEINT) OVER () AS total,
    coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / w::DOUBLE, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, (total - cap_before)::DOUBLE * w::DOUBLE > cap::DOUBLE * w_left::DOUBLE AS stopped FROM sums
), opened AS (
  SELECT *, sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ()::DOUBLE AS given, sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ()::DOUBLE AS w_open FROM flagged
), targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap::DOUBLE ELSE (total::DOUBLE - given) * w::DOUBLE / w_open END AS target FROM opened
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(r.rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || d.mix_key), 1, 13))::BIGINT / {float(16**13)} < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
