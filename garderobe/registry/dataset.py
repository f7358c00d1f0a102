"""Pair-dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.operators import dataset as d
from garderobe.plans import bindings as b
from garderobe.registry.base import register
from garderobe.registry.common import CATEGORIES, OUTFITS, VECTORS
from garderobe.registry.wardrobe import r6

BASE_CTE = (
    f"{OUTFITS}, {CATEGORIES}, sizes AS (SELECT split, set_id, count(*) AS size FROM outfit_items GROUP BY 1, 2), "
    "members AS (SELECT o.*, size FROM outfit_items o JOIN sizes USING (split, set_id) WHERE size >= 2), "
    "positives AS (SELECT a.split, a.set_id, a.item_id AS item_a, b.item_id AS item_b FROM members a JOIN members b "
    "ON a.split = b.split AND a.set_id = b.set_id AND a.ord < b.ord)"
)


def hx(text: str, digits: int = 8) -> str:
    return f"('0x' || substr(sha1({text}), 1, {digits}))::BIGINT"


def draw(tag: str) -> str:
    return hx(f"'42:{tag}:' || split || ':' || slot || ':' || attempt", 15)


# Dense numbers as the Spark side gives them: by sha1 bucket of the identity, then by the sort key.
NUMBERED = (
    f", pos_idx AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {hx('set_id || chr(124) || item_a')} % 64, set_id, "
    "item_a, item_b) AS idx FROM positives), n_pos AS (SELECT split, count(*) AS n_pos FROM positives GROUP BY 1), "
    f"outs AS (SELECT split, set_id, size, row_number() OVER (PARTITION BY split ORDER BY {hx('set_id::VARCHAR')} % 64, set_id) - 1 "
    "AS oidx FROM sizes WHERE size >= 2), n_out AS (SELECT split, count(*) AS n_out FROM outs GROUP BY 1), "
    "inside AS (SELECT split, set_id, item_id, row_number() OVER (PARTITION BY split, set_id ORDER BY ord) AS pos FROM members), "
    "pool AS (SELECT m.split, m.set_id, m.item_id, coalesce(category, 'unknown') AS category FROM members m LEFT JOIN item_cats "
    "USING (item_id)), n_pool AS (SELECT split, category, count(*) AS n_pool FROM pool GROUP BY 1, 2), "
    f"pool_idx AS (SELECT *, row_number() OVER (PARTITION BY split, category ORDER BY {hx('item_id || chr(124) || set_id')} % 64, "
    "item_id, set_id) - 1 AS pidx FROM pool), "
    "observed AS (SELECT DISTINCT split, least(item_a, item_b) AS lo, greatest(item_a, item_b) AS hi FROM positives), "
    "slots AS (SELECT split, n_pos, idx - 1 AS slot, idx - 1 < floor(n_pos * 0.5::DOUBLE) AS hard FROM pos_idx JOIN n_pos USING (split)), "
    "tries AS (SELECT s.*, n_out FROM (SELECT *, unnest(range(0, {attempts})) AS attempt FROM slots) s JOIN n_out USING (split))"
)
RANDOM = (
    f", r0 AS (SELECT *, {draw('oa')} % n_out AS ia FROM tries WHERE NOT hard), "
    f"r1 AS (SELECT *, (ia + 1 + {draw('ob')} % (n_out - 1)) % n_out AS ib FROM r0), "
    f"r2 AS (SELECT r1.split, slot, attempt, a.set_id AS set_a, b.set_id AS set_b, {draw('pa').replace('split', 'r1.split')} % a.size "
    f"+ 1 AS pa, {draw('pb').replace('split', 'r1.split')} % b.size + 1 AS pb FROM r1 JOIN outs a ON a.split = r1.split AND a.oidx = ia "
    "JOIN outs b ON b.split = r1.split AND b.oidx = ib), "
    "rnd AS (SELECT r2.split, slot, attempt, set_a, a.item_id AS item_a, b.item_id AS item_b FROM r2 JOIN inside a ON a.split = r2.split "
    "AND a.set_id = set_a AND a.pos = pa JOIN inside b ON b.split = r2.split AND b.set_id = set_b AND b.pos = pb)"
)
HARD = (
    f", h0 AS (SELECT *, {draw('base')} % n_pos + 1 AS base FROM tries WHERE hard), "
    "h1 AS (SELECT h0.split, slot, attempt, item_a, item_b AS was, coalesce(category, 'unknown') AS category FROM h0 JOIN pos_idx p "
    "ON p.split = h0.split AND p.idx = base LEFT JOIN item_cats c ON c.item_id = p.item_b), "
    f"h2 AS (SELECT h1.*, {draw('swap').replace('split', 'h1.split')} % n_pool AS pidx FROM h1 JOIN n_pool ON n_pool.split = h1.split AND "
    "n_pool.category = h1.category WHERE n_pool > 1), "
    "hrd AS (SELECT h2.split, slot, attempt, item_a, was, x.item_id AS item_b FROM h2 JOIN pool_idx x ON x.split = h2.split AND "
    "x.category = h2.category AND x.pidx = h2.pidx)"
)
UNSEEN = (
    "item_a <> item_b AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.split = q.split AND o.lo = least(item_a, item_b) "
    "AND o.hi = greatest(item_a, item_b))"
)
FIRST = "row_number() OVER (PARTITION BY split, slot ORDER BY attempt) AS rn"
NEGATIVES = (
    "WITH "
    + BASE_CTE
    + NUMBERED.replace("{attempts}", "20")
    + RANDOM
    + HARD
    + f", ok AS (SELECT split, slot, attempt, item_a, item_b, 'random_negative' AS kind FROM rnd q WHERE {UNSEEN} AND NOT EXISTS "
    "(SELECT 1 FROM members m WHERE m.split = q.split AND m.set_id = set_a AND m.item_id = item_b) UNION ALL "
    f"SELECT split, slot, attempt, item_a, item_b, 'hard_negative' FROM hrd q WHERE {UNSEEN}), "
    f"negatives AS (SELECT split, slot, item_a, item_b, kind FROM (SELECT *, {FIRST} FROM ok) WHERE rn = 1)"
)


def sampler(spark, sf):
    return d.PairSampler(b.outfit_items(spark, sf), b.item_categories(spark, sf))


PER_SPLIT = "count(*) AS n, count(DISTINCT item_a) AS n_a, count(DISTINCT item_b) AS n_b"


@register(
    "positive_pairs", f"WITH {BASE_CTE} SELECT split, set_id, item_a, item_b FROM positives"
)
def _positive(spark, sf):
    return d.positive_pairs(b.outfit_items(spark, sf)).select("split", "set_id", "item_a", "item_b")


def _negatives(spark, sf, kind):
    return sampler(spark, sf).negatives().filter(F.col("kind") == kind).select("split", "slot", "item_a", "item_b")


@register("random_negatives", NEGATIVES + " SELECT split, slot, item_a, item_b FROM negatives WHERE kind = 'random_negative'")
def _random(spark, sf):
    return _negatives(spark, sf, "random_negative")


@register("hard_negatives", NEGATIVES + " SELECT split, slot, item_a, item_b FROM negatives WHERE kind = 'hard_negative'")
def _hard(spark, sf):
    return _negatives(spark, sf, "hard_negative")


@register(
    "negatives_unfilled",
    NEGATIVES + ", wanted AS (SELECT split, slot, CASE WHEN hard THEN 'hard_negative' ELSE 'random_negative' END AS kind FROM slots) "
    "SELECT w.split, w.kind, count(*) AS wanted, count(*) - count(n.slot) AS unfilled FROM wanted w LEFT JOIN negatives n USING (split, slot) GROUP BY 1, 2",
)
def _unfilled(spark, sf):
    draws = sampler(spark, sf)
    drawn = draws.negatives().groupBy("split", "kind").agg(F.count(F.lit(1)).alias("drawn"))
    both = drawn.join(draws.unfilled(), ["split", "kind"], "full").fillna(0, ["drawn", "unfilled"])
    return both.select("split", "kind", (F.col("drawn") + F.col("unfilled")).alias("wanted"), "unfilled")


@register(
    "legacy_negatives",
    "WITH "
    + BASE_CTE
    + NUMBERED.replace("{attempts}", "20")
    + RANDOM
    + HARD
    + ", ok AS (SELECT split, slot, attempt, item_a, item_b, 'random_negative' AS kind FROM rnd UNION ALL SELECT split, slot, attempt, "
    f"item_a, item_b, 'hard_negative' FROM hrd WHERE item_b <> was), n AS (SELECT * FROM (SELECT *, {FIRST} FROM ok) WHERE rn = 1) "
    f"SELECT split, kind, {PER_SPLIT} FROM n GROUP BY ALL",
)
def _legacy(spark, sf):
    return (
        sampler(spark, sf)
        .negatives(check=False)
        .groupBy("split", "kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("item_a").alias("n_a"),
            F.countDistinct("item_b").alias("n_b"),
        )
    )


TYPED = NEGATIVES + (
    ", typed AS (SELECT split, item_a, item_b, 1 AS label, 'observed_positive' AS kind FROM positives UNION ALL "
    "SELECT split, item_a, item_b, 0, kind FROM negatives)"
)
ITEMS_OF = "(SELECT unnest([item_a, item_b]) FROM {t} WHERE split = '{s}')"
DISJOINT = (
    ", va AS (SELECT * FROM typed WHERE split = 'valid' AND item_a NOT IN (FROM ti) AND item_b NOT IN (FROM ti)), "
    "vi AS (SELECT DISTINCT unnest([item_a, item_b]) AS i FROM va), "
    "te AS (SELECT * FROM typed WHERE split = 'test' AND item_a NOT IN (FROM ti) AND item_b NOT IN (FROM ti) "
    "AND item_a NOT IN (FROM vi) AND item_b NOT IN (FROM vi)), "
    "disjoint AS (FROM (SELECT * FROM typed WHERE split = 'train') UNION ALL FROM va UNION ALL FROM te)"
)
TI = ", ti AS (SELECT DISTINCT unnest([item_a, item_b]) AS i FROM typed WHERE split = 'train')"


def stats_sql(t: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (kind = '{k}') AS kind_{k}" for k in v.PAIR_KINDS)
    return (
        f"SELECT split, count(*) FILTER (label = 1) AS positive_pairs, count(*) FILTER (label = 0) AS negative_pairs, {kinds}, "
        f"any_value(items) AS items FROM {t} JOIN (SELECT split, count(DISTINCT i) AS items FROM (SELECT split, "
        f"unnest([item_a, item_b]) AS i FROM {t}) GROUP BY 1) USING (split) GROUP BY split"
    )


@register("split_stats", TYPED + " " + stats_sql("typed"))
def _stats(spark, sf):
    return d.split_stats(sampler(spark, sf).typed_pairs(), written=True)


@register(
    "typed_pairs",
    TYPED + " SELECT split, kind, label, count(*) AS n, count(DISTINCT item_a || chr(32) || item_b) AS n_distinct FROM typed GROUP BY ALL",
)
def _typed(spark, sf):
    return (
        sampler(spark, sf)
        .typed_pairs()
        .groupBy("split", "kind", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.concat_ws(" ", "item_a", "item_b")).alias("n_distinct"))
    )


@register(
    "item_disjoint_filter",
    TYPED
    + TI
    + DISJOINT
    + " SELECT split, count(*) AS pairs, (SELECT count(*) FROM disjoint d WHERE d.split = t.split) AS kept, "
    "count(*) - (SELECT count(*) FROM disjoint d WHERE d.split = t.split) AS dropped FROM typed t GROUP BY split",
)
def _disjoint(spark, sf):
    return d.disjoint_report(sampler(spark, sf).typed_pairs(), written=True)


@register("item_disjoint_stats", TYPED + TI + DISJOINT + " " + stats_sql("disjoint"))
def _disjoint_stats(spark, sf):
    return d.split_stats(d.item_disjoint_filter(sampler(spark, sf).typed_pairs(), written=True))


@register(
    "unseen_item_check",
    TYPED + TI + DISJOINT + " SELECT count(*) AS test_items_seen_in_training FROM (SELECT DISTINCT unnest([item_a, item_b]) AS i "
    "FROM disjoint WHERE split = 'test') WHERE i IN (FROM ti)",
)
def _unseen(spark, sf):
    return d.unseen_item_check(d.item_disjoint_filter(sampler(spark, sf).typed_pairs(), written=True))


def csv_pairs(spark, sf):
    """User-labelled pairs: the part and the supplier of a line, labelled by its return flag."""
    line = b.table(spark, sf, "lineitem")
    return line.select(
        F.concat(F.lit("p"), "l_partkey").alias("item_a"),
        F.concat(F.lit("s"), "l_suppkey").alias("item_b"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.when(F.col("l_linenumber") == 1, "train").when(F.col("l_linenumber") == 2, "test").alias("split"),
    )


CSV = (
    "csv AS (SELECT 'p' || l_partkey AS item_a, 's' || l_suppkey AS item_b, (l_returnflag = 'R')::INT AS label, "
    "CASE l_linenumber WHEN 1 THEN 'train' WHEN 2 THEN 'test' END AS split FROM lineitem), "
    f"h AS (SELECT *, {hx(chr(39) + '42:' + chr(39) + ' || item_a')} / 4294967295.0::DOUBLE AS ua, "
    f"{hx(chr(39) + '42:' + chr(39) + ' || item_b')} / 4294967295.0::DOUBLE AS ub FROM csv), "
    "sp AS (SELECT *, CASE WHEN ua < 0.1 THEN 'test' WHEN ua < 0.2 THEN 'valid' ELSE 'train' END AS sa, "
    "CASE WHEN ub < 0.1 THEN 'test' WHEN ub < 0.2 THEN 'valid' ELSE 'train' END AS sb FROM h), "
    "final AS (SELECT *, coalesce(split, CASE WHEN sa = sb THEN sa END) AS final_split FROM sp)"
)


@register(
    "item_split_pairs",
    f"WITH {CSV} SELECT coalesce(final_split, 'dropped') AS final_split, split IS NOT NULL AS explicit, count(*) AS n, "
    "sum(label)::BIGINT AS positives FROM final GROUP BY ALL",
)
def _split(spark, sf):
    return (
        d.item_split_pairs(csv_pairs(spark, sf))
        .groupBy(F.coalesce("final_split", F.lit("dropped")).alias("final_split"), F.col("split").isNotNull().alias("explicit"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    )


@register(
    "label_kinds",
    f"WITH {CSV} SELECT CASE WHEN label = 1 THEN 'labelled_positive' ELSE 'labelled_negative' END AS kind, count(*) AS n FROM csv GROUP BY 1",
)
def _kinds(spark, sf):
    return d.label_kinds(csv_pairs(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Duplicate groups stand for equal images: parts of one name; items of size 13 are unreadable.
CANON = (
    ", ids AS (SELECT item_id, p_name, p_size FROM part JOIN (SELECT item_id, str_split(replace(item_id, 'p', '_'), '_')[-1]::BIGINT AS "
    "p_partkey FROM item_cats) USING (p_partkey)), canon AS (SELECT item_id, min(item_id) OVER (PARTITION BY p_name) AS canonical_id "
    "FROM ids), bad AS (SELECT item_id FROM ids WHERE p_size = 13)"
)


def canonical_tables(spark, sf):
    part = b.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    key = F.regexp_extract("item_id", r"(\d+)$", 1).cast("bigint")
    ids = b.item_categories(spark, sf).select("item_id", key.alias("p_partkey")).join(part, "p_partkey")
    smallest = ids.groupBy("p_name").agg(F.min("item_id").alias("canonical_id"))
    return ids.join(smallest, "p_name").select("item_id", "canonical_id"), ids.filter(F.col("p_size") == 13).select("item_id")


@register(
    "apply_canonical",
    TYPED + CANON + ", c AS (SELECT t.split, a.canonical_id AS item_a, b.canonical_id AS item_b FROM typed t JOIN canon a ON "
    "a.item_id = t.item_a JOIN canon b ON b.item_id = t.item_b) SELECT split, item_a, item_b, count(*) AS n FROM c WHERE item_a <> item_b "
    "AND item_a NOT IN (FROM bad) AND item_b NOT IN (FROM bad) GROUP BY ALL",
)
def _canonical(spark, sf):
    canon, bad = canonical_tables(spark, sf)
    pairs = sampler(spark, sf).typed_pairs().select("split", "item_a", "item_b")
    return d.apply_canonical(pairs, canon, bad).groupBy("split", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fake_outfits",
    "WITH " + BASE_CTE + ", known AS (SELECT m.*, coalesce(category, 'unknown') AS category FROM members m LEFT JOIN item_cats USING (item_id)), "
    f"pool AS (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY {hx('item_id')} % 64, item_id) - 1 AS idx, "
    "count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, item_id FROM known)), "
    "n AS (SELECT DISTINCT category, n FROM pool) SELECT k.split, k.set_id, k.item_id AS real_id, p.item_id FROM "
    f"(SELECT known.*, {hx(chr(39) + '42:fake:' + chr(39) + ' || split || chr(58) || set_id || chr(58) || item_id', 15)} % n AS idx FROM known JOIN n "
    "USING (category)) k JOIN pool p ON p.category = k.category AND p.idx = k.idx",
)
def _fake(spark, sf):
    members = d.usable_outfits(b.outfit_items(spark, sf))
    return d.fake_outfits(members, b.item_categories(spark, sf)).select("split", "set_id", "real_id", "item_id")


@register(
    "prepare_outfits",
    f"WITH {OUTFITS}, {CATEGORIES}, keep AS (SELECT * FROM outfit_items WHERE item_id IN (SELECT item_id FROM item_cats WHERE category "
    "<> 'accessory')), s AS (SELECT split, set_id, count(*) AS size FROM keep GROUP BY ALL HAVING count(*) >= 2), "
    "k AS (SELECT keep.*, row_number() OVER (PARTITION BY split, set_id ORDER BY ord) AS pos FROM keep JOIN s USING (split, set_id)) "
    "SELECT split, count(DISTINCT set_id) AS raw_outfits, count(*) AS raw_items, (SELECT count(DISTINCT set_id) FROM k WHERE "
    "k.split = o.split) AS retained_outfits, (SELECT count(*) FROM k WHERE k.split = o.split) AS retained_items, "
    "(SELECT sum(pos)::BIGINT FROM k WHERE k.split = o.split) AS sum_pos FROM outfit_items o GROUP BY split",
)
def _prepare(spark, sf):
    usable = b.item_categories(spark, sf).filter(F.col("category") != "accessory")
    members, counts = d.prepare_outfits(b.outfit_items(spark, sf), usable)
    return counts.join(members.groupBy("split").agg(F.sum("pos").alias("sum_pos")), "split")


@register(
    "pair_embeddings",
    TYPED + f", {VECTORS} SELECT split, count(*) AS n, round(avg(list_dot_product(a.vector, b.vector)), 6) AS mean_cosine "
    "FROM typed p JOIN item_vecs a ON a.item_id = p.item_a JOIN item_vecs b ON b.item_id = p.item_b GROUP BY 1",
)
def _embedded(spark, sf):
    from garderobe.functions.vectors import dot

    pairs = sampler(spark, sf).typed_pairs().select("split", "item_a", "item_b")
    both = d.pair_embeddings(pairs, b.item_vectors(spark, sf), b.ENCODER_DIM)
    return (
        both.withColumn("cosine", dot("va", "vb"))
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cosine"), "mean_cosine"))
    )


@register(
    "missing_embedding_rate",
    TYPED + f", {VECTORS}, m AS (SELECT p.*, item_a NOT IN (SELECT item_id FROM item_vecs) OR item_b NOT IN (SELECT item_id FROM "
    "item_vecs) AS lacking FROM typed p) SELECT split, count(*) AS pairs, count(*) FILTER (lacking) AS missing, "
    "round(avg(lacking::INT), 6) AS missing_rate, avg(lacking::INT) > 0.05 AS over_limit FROM m GROUP BY 1",
)
def _missing(spark, sf):
    pairs = sampler(spark, sf).typed_pairs().select("split", "item_a", "item_b")
    out = d.missing_embedding_rate(pairs, b.item_vectors(spark, sf), b.ENCODER_DIM)
    return out.withColumn("missing_rate", F.round("missing_rate", 6))
