"""Tools that keep hot groups from landing in one task: blocked pair joins and distributed numbering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions.lookup import hash_int
from garderobe.session import cut_lineage, written

BLOCK_ROWS = 512
#: A row is copied once for every block of the other side: beyond this many blocks they get larger, up to so many times.
FEW_BLOCKS = 4
LARGER = 8
SALTS = 16
#: Rows of a key that one task sorts, about.
RANGE_ROWS = 200_000


def _bucket(uid: Sequence[str], n: Column) -> Column:
    return F.pmod(F.xxhash64(*uid), n.cast("bigint")).cast("int")


def pair_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    uid: Sequence[str],
    on: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    block_rows: int | None = None,
    select: Callable[[Callable[[str], Column], Callable[[str], Column]], list[Column]] | None = None,
) -> DataFrame:
    """Theta join inside equal ``keys`` that never puts a large group into one task.

    A group of more than ``block_rows`` rows is cut into blocks by a hash of ``uid``; each pair of blocks is
    its own join key, so a group of n rows is spread over (n / block_rows)^2 equal tasks. Small groups keep
    one block and cost nothing extra; without a large group no row is tagged with blocks. Unless ``block_rows`` is given,
    blocks of very large groups hold ``LARGER`` times as many rows, since a row travels once for each block that it meets. ``on`` is evaluated inside the join: pairs that fail it are never
    emitted. The result keeps ``keys`` plus ``_bi``/``_bj`` (the block pair), so a following aggregate or
    window by (keys, _bi, _bj, ...) reuses the join's partitioning.
    """
    keys, uid = list(keys), list(uid)
    if left is right:
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl")).withColumn("_nr", F.col("_nl"))
    else:
        tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
            right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
        )
        sizes = tagged.groupBy(*keys).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))

    def cut(n: str, rows: int) -> Column:
        return F.ceil(F.col(n) / F.lit(rows)).cast("int")

    def count(n: str) -> Column:
        if block_rows is not None:
            return cut(n, block_rows)
        return F.least(cut(n, BLOCK_ROWS), F.greatest(F.lit(FEW_BLOCKS), cut(n, LARGER * BLOCK_ROWS)))

    least = BLOCK_ROWS if block_rows is None else block_rows
    blocks = [count(n).alias(b) for n, b in (("_nl", "_na"), ("_nr", "_nb"))]
    hot = (
        sizes.filter((F.col("_nl") > least) | (F.col("_nr") > least))
        .select(*keys, *blocks)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    hot = cut_lineage(hot)  # read by both sides
    none_hot = hot.limit(1).count() == 0
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        if none_hot:
            return df.withColumn(mine, F.lit(0)).withColumn(theirs, F.lit(0))
        salted = df.withColumn("_salt", _bucket(uid, F.lit(SALTS))).join(hot, [*keys, "_salt"], "left")
        return (
            salted.withColumn(mine, _bucket(uid, F.greatest(F.coalesce(own, F.lit(1)), F.lit(1))))
            .withColumn(
                theirs,
                F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1)),
            )
            .drop("_salt", "_na", "_nb")
            # A given number of tasks: few bytes make many pairs, so tasks must not be merged by bytes.
            .repartition(parts, *keys, "_bi", "_bj")
        )

    a = spread(left, F.col("_na"), F.col("_nb"), "_bi", "_bj").alias("a")
    b = spread(right, F.col("_nb"), F.col("_na"), "_bj", "_bi").alias("b")
    at, bt = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = None
    for k in [*keys, "_bi", "_bj"]:
        eq = at(k) == bt(k)
        same = eq if same is None else same & eq
    joined = a.join(b, same & on(at, bt))
    if select is None:
        return joined
    return joined.select(*[at(k).alias(k) for k in [*keys, "_bi", "_bj"]], *select(at, bt))


def hash_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that sorts by a 64-bit hash of them first: texts that begin alike compare slowly."""
    keys = list(keys)
    a, b = (df.withColumn("_k", F.xxhash64(*keys)) for df in (left, right))
    return a.join(b, ["_k", *keys], how).drop("_k")


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, uid: Sequence[str], buckets: int = 64
) -> DataFrame:
    """1-based row number per ``keys`` in (hash bucket, ``order``) sequence, without a one-task window.

    Each (keys, bucket) is numbered on its own and shifted by the sizes of the earlier buckets; only the
    bucket sizes (``buckets`` rows per key) meet in one place. The numbering is dense and deterministic.
    """
    keys = list(keys)
    bucket = F.pmod(hash_int(F.concat_ws("|", *uid)), F.lit(buckets)).cast("int")
    parts = df.withColumn("_bucket", bucket)
    return number_buckets(parts, keys, "_bucket", order, name).drop("_bucket")


def number_buckets(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], name: str
) -> DataFrame:
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    own = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    if keys:
        both = own.join(shift, [*keys, bucket])
    else:
        both = own.join(shift, bucket)
    return both.withColumn(name, F.col("_rn").cast("bigint") + F.col("_shift")).drop("_rn", "_shift")


def places(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[Column | str], name: str) -> DataFrame:
    """1-based place of every row per ``keys``, highest ``score`` first and equal ones by ``ties``; no score comes last.

    A key with many rows is cut at quantiles of its scores, and each range is numbered on its own and shifted by the
    sizes of the higher ones: rows travel once, and no key is one task.
    """
    keys = list(keys)
    df = written(df)
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n = -(-most // RANGE_ROWS)
    order = [F.col(score).desc(), *ties]
    if n <= 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))

    def same(other: str) -> Column:
        equal = F.lit(True)
        for k in keys:
            equal = equal & F.col(f"rows.{k}").eqNullSafe(F.col(f"{other}.{k}"))
        return equal

    marks = F.percentile_approx(score, [i / n for i in range(1, n)], max(10_000, 10 * n))
    cuts = written(df.groupBy(*keys).agg(marks.alias("_cuts")))
    ranged = df.alias("rows").join(cuts.alias("cuts"), same("cuts")).select("rows.*", "_cuts")
    higher = F.size(F.filter("_cuts", lambda c: c > F.col(score)))
    ranged = ranged.withColumn("_range", F.when(F.col(score).isNull(), F.lit(n)).otherwise(higher)).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    shift = written(sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    both = own.alias("rows").join(shift.alias("shift"), same("shift") & (F.col("rows._range") == F.col("shift._range")))
    return both.select(*[f"rows.{c}" for c in df.columns], (F.col("_own") + F.col("_shift")).alias(name))
