"""Importance resampling towards a target text: hashed word runs, gains held in one array, and the best noisy weights
found by a weighted median of medians over partitions."""

from __future__ import annotations

import math
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.llm.common import Stash, raw

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: So many keys may be sorted on the driver to end the search.
FEW = 1024
#: Rows of a sorted range of the drawn documents.
RANGE_ROWS = 1_000_000

KEY = ["k_score", "k_null", "k_id", "k_features", "k_row"]
#: A-Z become a-z; digits, a-z and all bytes of other characters stay; the rest separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_hashes(data: bytes, piece: int = PIECE):
    """CRC-32 of every word and of every two neighbouring words joined by a blank: pairs (words, runs of two) of arrays,
    one for each stretch of about ``piece`` bytes, so that a long text never becomes one list of words."""
    clean, start, lead = data.translate(WORD_BYTES), 0, None
    while start < len(clean):
        end = clean.find(b" ", start + piece) if start + piece < len(clean) else -1
        end = len(clean) if end < 0 else end
        words = clean[start:end].split()
        start = end
        if not words:
            continue
        single = list(map(crc32, words))
        leads = list(map(crc32, repeat(b" "), single))  # the CRC of "word " goes on with the next word
        double = list(map(crc32, words[1:], leads))
        if lead is not None:
            double.append(crc32(words[0], lead))
        lead = leads[-1]
        yield np.array(single, np.int64), np.array(double, np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of the column ``text`` fall into each bucket; a task sends one row for a bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for both in feature_hashes(raw(text.as_py())):
                    for hashes in both:
                        total += np.bincount(hashes % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    parts = texts.select("text").mapInArrow(count, "bucket int, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the source, rounded down."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number fixed by the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features, 0 without any. The array
    of gains has a fixed length, so it goes to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches):
        table = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = features = total = 0
                for both in feature_hashes(raw(text.as_py())):
                    words += len(both[0])
                    for hashes in both:
                        features += len(hashes)
                        total += int(table[hashes % len(table)].sum())
                rows.append((words, features, total // features if features else 0))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def _before(columns: list[np.ndarray], key: tuple) -> np.ndarray:
    """Which rows come before ``key``, column by column."""
    less, same = np.zeros(len(columns[0]), bool), np.ones(len(columns[0]), bool)
    for c, k in zip(columns, key, strict=True):
        less |= same & (c < k)
        same &= c == k
    return less


def _middle(columns: list[np.ndarray]) -> list[int | None]:
    n = len(columns[0])
    at = np.lexsort(columns[::-1])[(n - 1) // 2] if n else None
    return [None if at is None else int(c[at]) for c in columns]


def _split(keys: DataFrame, pivot: tuple | None) -> list:
    """One row for each partition of ``keys``: rows and median key before and behind ``pivot`` (all rows are behind
    None). A partition is one split of a table of five numbers a row, so its keys fit in memory."""
    names = [f"{side}{i}" for side in ("low", "high") for i in range(len(KEY))]

    def run(batches):
        held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in KEY] for batch in batches]
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * len(KEY)
        low = np.zeros(len(columns[0]), bool) if pivot is None else _before(columns, pivot)
        equal = np.ones(len(columns[0]), bool)
        for c, k in zip(columns, pivot or (), strict=False):
            equal &= c == k
        high = ~low if pivot is None else ~low & ~equal
        row = [int(low.sum()), int(high.sum()), *_middle([c[low] for c in columns]), *_middle([c[high] for c in columns])]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["n_low", "n_high", *names])

    return keys.select(*KEY).mapInArrow(run, ", ".join(f"{c} long" for c in ["n_low", "n_high", *names])).collect()


def _weighted_median(parts: list, side: str) -> tuple | None:
    """Of the partitions' medians the one at which half of the remaining rows is reached: at least a quarter of all
    remaining rows lie on either side of it."""
    medians = sorted((tuple(r[f"{side}{i}"] for i in range(len(KEY))), r[f"n_{side}"]) for r in parts if r[f"n_{side}"])
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    return None


def key_struct() -> Column:
    return F.struct(*KEY)


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEY, key, strict=True)])


def cutoff(keys: DataFrame, stash: Stash, want: int, few: int = FEW) -> tuple | None:
    """The ``want``-th smallest key of ``keys``, whose keys all differ; None if there are fewer or ``want`` is 0.

    Every round takes one job: partitions count their remaining rows on both sides of the last pivot and name the
    median of each side; the side without the answer goes, at least a quarter of the rows. Remaining rows are written
    anew whenever they are an eighth of what the last table held, so all rounds together read a few times the input.
    """
    pivot, low, high = None, None, None
    parts = _split(keys, None)
    left = held = sum(r["n_high"] for r in parts)
    if not 0 < want <= left:
        return None
    side = "high"
    while True:
        inside = keys if low is None else keys.where(key_struct() > _literal(low))
        inside = inside if high is None else inside.where(key_struct() < _literal(high))
        if left <= few:
            return sorted(tuple(r) for r in inside.select(*KEY).collect())[want - 1]
        if left * 8 <= held:
            keys, held, low, high = stash.keep(inside.select(*KEY)), left, None, None
            inside = keys
        pivot = _weighted_median(parts, side)
        parts = _split(inside, pivot)
        below = sum(r["n_low"] for r in parts)
        if want == below + 1:
            return pivot
        if want <= below:
            side, left, high = "low", below, pivot
        else:
            side, left, low = "high", left - below - 1, pivot
            want -= below + 1


def ranked(drawn: DataFrame, stash: Stash, rows: int) -> DataFrame:
    """``drawn`` with its ``rank`` by key: ranges are sorted on their own, and each starts where those before it end."""
    parts = max(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    placed = drawn.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id())
    placed = stash.keep(placed).withColumn("part", F.shiftright("at", 33)).withColumn("place", F.expr("at & ((1L << 33) - 1)"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place") + 1)  # a row for each range


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank 1, 2, ... for the drawn ones.

    Of the rows with ``least_words`` words or more, floor(percent * rows / 100) with the highest scores are drawn, which
    is drawing without replacement by the importance weights, as the scores carry Gumbel noise. Ties go to the smaller
    doc_id (null last), then to fewer features; what is still equal has equal rows in the result. Null and empty texts
    have no features and weight 0; a null id draws its noise as the empty text; rows of one id share their noise. An
    empty target leaves only the smoothing; an empty ``docs`` gives no rows. Other columns are not read. The weighed
    rows are written once, so that the search and the result see the same rows.
    """
    stash = Stash(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stash.keep(scored.withColumn("k_row", F.monotonically_increasing_id()))
    keyed = scored.select(
        "*",
        (-F.col("score")).alias("k_score"),
        F.col("doc_id").isNull().cast("long").alias("k_null"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("k_id"),
        F.col("n_features").alias("k_features"),
    )
    able = keyed.where(F.col("n_words") >= least_words)
    want = percent * able.count() // 100
    last = cutoff(able.select(*KEY), stash, want)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return keyed.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = (F.col("n_words") >= least_words) & (key_struct() <= _literal(last))
    drawn = ranked(keyed.where(chosen), stash, want).select(*columns, "rank")
    return drawn.unionByName(keyed.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The digest of the registered query."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::INT, 2))::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1))))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = rf"""
WITH texts AS (
  SELECT 's' AS side, row_number() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
  SELECT side, n, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), runs AS (
  SELECT side, n, unnest(w) AS f FROM worded
  UNION ALL SELECT side, n, unnest(list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) FROM worded
), counted AS (
  SELECT side, n, f, count(*) AS times FROM runs GROUP BY side, n, f
), hashed AS (
  SELECT f, (xor({_CRC}, 4294967295::UBIGINT) % {BUCKETS})::INT AS bucket FROM (SELECT DISTINCT f FROM counted)
), placed AS (
  SELECT side, n, bucket, sum(times)::BIGINT AS times FROM counted JOIN hashed USING (f) GROUP BY side, n, bucket
), totals AS (
  SELECT b.range::INT AS bucket, coalesce(sum(times) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(times) FILTER (side = 't'), 0)::BIGINT AS t
  FROM range({BUCKETS}) b LEFT JOIN placed p ON p.bucket = b.range GROUP BY b.range
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + {BUCKETS}) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM totals
), summed AS (
  SELECT n, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS total FROM placed JOIN gained USING (bucket) WHERE side = 's' GROUP BY n
), scored AS (
  SELECT d.n, d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM worded d LEFT JOIN summed s ON s.n = d.n WHERE d.side = 's'
), able AS (
  SELECT n, row_number() OVER (ORDER BY weight + noise DESC, doc_id ASC NULLS LAST, n_features) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT s.doc_id, s.n_features, s.weight, s.weight + s.noise AS score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank
FROM scored s LEFT JOIN able a USING (n)
"""
