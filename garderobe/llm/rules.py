"""Quality rules whose cut-offs are certified on labelled documents: DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.llm.common import BLANKS, Stash, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A document fails a rule when its value is above the cut-off.
RULES = ("symbol_share", "exclaim_share", "capital_share", "dup_line_share", "repeat_share")
CUTS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7)
#: Of good documents at most ALPHA may be rejected in a stratum, over all rules together, with confidence 1 - DELTA
#: over all tests together.
ALPHA = 0.05
DELTA = 0.05


def _count_of(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each whole text (null: an empty one).

    Repeated word windows are found by 64-bit hashes within a text; a text without any is recognised by the number
    of distinct hashes, the others sort their hashes with positions and look at both neighbours.
    """
    out = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_w", F.transform(word_array(F.col("_t")), lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("_g", F.expr(f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) ELSE array() END"))
    out = out.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (h, i) -> struct(h AS h, i AS i))) END"))
    out = out.withColumn("_p", F.expr("CASE WHEN _s IS NOT NULL THEN array_sort(transform(filter(_s, (x, i) -> coalesce(get(_s, i - 1).h = x.h, false) OR coalesce(get(_s, i + 1).h = x.h, false)), x -> x.i)) END"))
    repeated = F.expr(f"CASE WHEN _p IS NULL THEN 0L ELSE aggregate(transform(_p, (p, i) -> least({WINDOW}, coalesce(get(_p, i + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x) END")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, BLANKS + " ", "") != "")
    out = out.withColumn("n_repeat_words", repeated).withColumn("_l", lines)
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.translate("_t", BLANKS + "\n ", "")).cast("long").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_l").cast("long").alias("n_lines"),
        _count_of(F.col("_t"), "!").alias("n_exclaims"),
        _count_of(F.col("_t"), CAPITALS).alias("n_capitals"),
    )


def _share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")


def with_rules(measured: DataFrame) -> DataFrame:
    return measured.select(
        "*",
        _share("n_symbols", "word_chars").alias("symbol_share"),
        _share("n_exclaims", "word_chars").alias("exclaim_share"),
        _share("n_capitals", "word_chars").alias("capital_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at probability p, exact: terms follow from each other, as logarithms so that none is lost.

    At k >= n p it is 1 for our purpose (never below 0.5 less a term), so the sum has fewer than n p terms.
    """
    first = n.cast("double") * F.lit(log(1 - p))
    odds = log(p / (1 - p))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds)
        return F.struct(term.alias("t"), (acc["s"] + F.exp(term)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda acc: acc["s"]))


def certified_cuts(judged: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cut): the lowest cut-off of each rule that is certified in its stratum; none, no row.

    ``judged`` has stratum and rule columns of good documents. For every stratum, rule and cut-off of the fixed grid
    the number k of n good documents above it is tested: a chance of alpha / rules or more is refuted when
    P(Bin(n, alpha / rules) <= k) <= delta / tests (Bonferroni over all strata, rules and cut-offs).
    """
    counts = [F.sum(F.when(F.col(r) > c, 1).otherwise(0)).cast("long").alias(f"{r}_{i}") for r in RULES for i, c in enumerate(CUTS)]
    per = judged.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    tests = per.agg((F.count("*") * len(RULES) * len(CUTS)).alias("tests"))
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(CUTS)])
    cells = per.select("stratum", "n", F.explode(cells).alias("x")).select("stratum", "n", "x.*")
    risk = binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES))
    passed = cells.crossJoin(F.broadcast(tests)).where(risk <= F.lit(delta) / F.col("tests"))  # one row on the right
    return passed.groupBy("stratum", "rule").agg(F.min("cut").alias("cut"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, stash: Stash | None = None) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row: the base rules, then the certified cut-offs of its stratum.

    Good documents are those with ``labels.quality`` 1 that pass the base rules; an id with different labels is left
    out of the test, an id labelled twice alike counts once. A null stratum is a stratum of its own; without enough
    labels nothing is certified and only the base rules reject. Null and empty texts have no words and fail the
    base rules; repeated rows stay; an empty table gives no rows.
    """
    stash = stash or Stash(docs.sparkSession)
    measured = measures(docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"))).drop("text")
    measured = stash.keep(with_rules(measured))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 AND high = 1").select("doc_id")
    judged = measured.where("NOT base_failed").join(good, "doc_id", "left_semi")
    cuts = certified_cuts(judged, alpha, delta)
    wide = cuts.groupBy(F.col("stratum").alias("of_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])
    out = measured.join(wide, measured["stratum"].eqNullSafe(wide["of_stratum"]), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def _sql() -> str:
    share = {
        "symbol_share": "n_symbols::DOUBLE / greatest(word_chars, 1)",
        "exclaim_share": "n_exclaims::DOUBLE / greatest(word_chars, 1)",
        "capital_share": "n_capitals::DOUBLE / greatest(word_chars, 1)",
        "dup_line_share": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
        "repeat_share": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
    }
    p = ALPHA / len(RULES)
    rules = " UNION ALL ".join(f"SELECT lang, doc_id, '{r}' AS rule, {r} AS v FROM judged" for r in RULES)
    over = " OR ".join(f"coalesce(s.{r} > (SELECT cut FROM cuts c WHERE c.rule = '{r}' AND c.lang IS NOT DISTINCT FROM s.lang), false)" for r in RULES)
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT rid, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_exclaims, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM base LEFT JOIN covered c USING (rid) LEFT JOIN lines l USING (rid)
), s AS (
  SELECT *, {", ".join(f"{e} AS {r}" for r, e in share.items())}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), good AS (
  SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1
), judged AS (
  SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
), cells AS (
  SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (v > cut) AS k FROM ({rules}) CROSS JOIN (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in CUTS)}]) AS cut) GROUP BY ALL
), risks AS (
  SELECT *, count(*) OVER () AS tests, CASE WHEN k >= n * {p!r}::DOUBLE THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}::DOUBLE) + (n - i) * ln(1 - {p!r}::DOUBLE))) FROM unnest(range(0, k + 1)) AS u(i)) END AS risk FROM cells
), cuts AS (
  SELECT lang, rule, min(cut) AS cut FROM risks WHERE risk <= {DELTA!r}::DOUBLE / tests GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM s
"""


ORACLE_SQL = _sql()
