"""Pair, duplicate and conflict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import vectors
from garderobe.operators import duplicates as d
from garderobe.operators import pairs as p
from garderobe.operators import wardrobe as w
from garderobe.plans import bindings as b
from garderobe.registry.base import register
from garderobe.registry.common import NEUTRAL_SQL, case_map, sql_list, with_items
from garderobe.registry.wardrobe import DIM, MODEL, r6

BASE = v.PAIR_MODELS["baseline"]


def usable(spark, sf):
    return w.eligible_items(b.items(spark, sf), MODEL, DIM).filter(F.col("reason").isNull())


_SLOT_PAIRS = {"+".join(sorted(k)): s for k, s in v.SLOT_PAIR_SCORE.items()}
_M = BASE
_HUE = lambda c: case_map(c, v.HUES)


def light_sql(h: str) -> str:
    return (
        f"(0.2126 * (('0x' || substr({h}, 2, 2))::INT / 255.0::DOUBLE) + 0.7152 * (('0x' || substr({h}, 4, 2))::INT / "
        f"255.0::DOUBLE) + 0.0722 * (('0x' || substr({h}, 6, 2))::INT / 255.0::DOUBLE))"
    )


def contribution_sql(i: int, value: str) -> str:
    return f"{_M['coef'][i]!r}::DOUBLE * ((coalesce({value}, {_M['impute'][i]!r}) - {_M['mean'][i]!r}) / {_M['scale'][i]!r})"


def pairs_sql(source: str = "items", key: str = "wardrobe_id", condition: str = "a.seq < b.seq") -> str:
    """CTEs pair_raw and pairs: features, relation, contributions, score and conflict of item pairs."""
    dist = f"abs({_HUE('a.color')} - {_HUE('b.color')})"
    return f"""
    pair_raw AS (
      SELECT a.{key} AS {key}, a.item_id AS ia, b.item_id AS ib, a.seq AS sa, b.seq AS sb, a.category AS ca, b.category AS cb,
        a.color AS cola, b.color AS colb, {light_sql("a.hex")} AS la, {light_sql("b.hex")} AS lb,
        least({dist}, 360 - {dist}) AS hd,
        CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN list_dot_product(a.vec, b.vec) END AS clip_cos,
        list_sum(list_transform(range(1, 8), lambda i: sqrt(a.style_scores[i] * b.style_scores[i]))) AS style_sim,
        CASE WHEN a.category = b.category THEN 0.0 ELSE
          coalesce({case_map("concat_ws('+', least(a.category, b.category), greatest(a.category, b.category))", _SLOT_PAIRS)}, 0.5)
          END::DOUBLE AS category,
        a.source_image = b.source_image AND (
          greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
          )::DOUBLE / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) -
          greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
          ) >= 0.5 AS one_region
      FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND {condition}),
    pair_rel AS (
      SELECT *, CASE
        WHEN cola IN {NEUTRAL_SQL} AND colb IN {NEUTRAL_SQL} THEN CASE WHEN abs(la - lb) >= 0.3 THEN 'neutral_contrast'
          WHEN cola = colb THEN 'tone_on_tone' ELSE 'low_contrast_neutrals' END
        WHEN cola IN {NEUTRAL_SQL} OR colb IN {NEUTRAL_SQL} THEN 'accent_with_neutral'
        WHEN cola = colb THEN CASE WHEN abs(la - lb) >= 0.2 THEN 'monochrome' ELSE 'tone_on_tone' END
        WHEN hd <= 45 THEN 'analogous' WHEN hd BETWEEN 150 AND 210 THEN 'complementary' ELSE 'conflicting' END AS relation,
        {contribution_sql(0, "clip_cos")} AS c_clip_cos, {contribution_sql(1, "style_sim")} AS c_style_sim,
        {contribution_sql(2, "category")} AS c_category, coalesce(clip_cos >= 0.97, false) OR one_region AS conflict
      FROM pair_raw),
    pairs AS (
      SELECT *, {case_map("relation", v.RELATION_SCORE)}::DOUBLE AS colour,
        1 / (1 + exp(-(c_clip_cos + c_style_sim + c_category + {_M["intercept"]!r}))) AS p FROM pair_rel)"""


OK_ITEMS = "ok_items AS (SELECT * FROM items WHERE reason IS NULL)"
NEVER = sql_list(["+".join(sorted(k)) for k, s in v.SLOT_PAIR_SCORE.items() if s <= 0])


@register(
    "pair_scores",
    with_items(
        f", {OK_ITEMS}, {pairs_sql('ok_items')} SELECT wardrobe_id, concat_ws('+', least(ca, cb), greatest(ca, cb)) AS slots, "
        "count(*) AS n_pairs, count(*) FILTER (conflict) AS n_conflicts, "
        + ", ".join(f"round(avg({f}), 6) AS mean_{f}" for f in ("clip_cos", "style_sim", "colour", "category", "p"))
        + ", "
        + ", ".join(f"round(avg(c_{f}), 6) AS mean_c_{f}" for f in BASE["features"])
        + ", round(max(p), 6) AS best_p FROM pairs WHERE ca <> cb GROUP BY ALL"
    ),
)
def _pair_scores(spark, sf):
    out = p.pair_summary(usable(spark, sf), BASE)
    return out.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _recommend(sql_k: str, context: str = "") -> str:
    shift = "0.1 * ((xa + xb) / 2 - 0.5)" if context else "0"
    ctx = f"{context} AS x" if context else "NULL AS x"
    return with_items(
        f", ok_items AS (SELECT *, {ctx} FROM items WHERE reason IS NULL), "
        f"{pairs_sql('ok_items', condition='a.seq <> b.seq AND a.category <> b.category')}, "
        f"x AS (SELECT item_id, x FROM ok_items), r AS (SELECT pairs.*, p + {shift} AS score FROM pairs "
        "JOIN (SELECT item_id AS ia, x AS xa FROM x) USING (ia) JOIN (SELECT item_id AS ib, x AS xb FROM x) USING (ib) "
        f"WHERE NOT conflict AND concat_ws('+', least(ca, cb), greatest(ca, cb)) NOT IN {NEVER}) "
        "SELECT wardrobe_id, ia AS anchor, ib AS partner, position, round(score, 6) AS score, round(p, 6) AS plausibility, "
        "round(clip_cos, 6) AS clip_cos, round(colour, 6) AS colour FROM (SELECT *, row_number() OVER (PARTITION BY ia "
        f"ORDER BY score DESC, sb) AS position FROM r) {sql_k}"
    )


def _recommended(df):
    return df.select(
        "wardrobe_id", "anchor", "partner", "position", *[r6(c, c) for c in ("score", "plausibility", "clip_cos", "colour")]
    )


@register("recommend_for_item", _recommend("WHERE position <= 5"))
def _recommend_top(spark, sf):
    return _recommended(p.recommend_for_item(usable(spark, sf), BASE, k=5))


_CTX_SQL = "least(1.0, style_scores[3] / list_max(style_scores))"


@register("recommend_for_item_in_context", _recommend("WHERE position <= 3", _CTX_SQL))
def _recommend_context(spark, sf):
    return _recommended(p.recommend_for_item(usable(spark, sf), BASE, k=3, style_name="formal"))


@register(
    "recommendation_message",
    with_items(
        "SELECT item_id, CASE WHEN reason IS NOT NULL THEN 'This item cannot be used yet: ' || reason || '.' END AS message "
        "FROM items UNION ALL SELECT 'it' || p_partkey, 'That item no longer exists.' FROM part WHERE p_partkey NOT IN "
        "(SELECT vec_id FROM embeddings)"
    ),
)
def _message(spark, sf):
    judged = w.eligible_items(b.items(spark, sf), MODEL, DIM)
    top = p.recommend_for_item(judged.filter(F.col("reason").isNull()), BASE, k=1)
    asked = b.table(spark, sf, "part").select(F.concat(F.lit("it"), "p_partkey").alias("item_id"))
    return p.recommendation_message(judged, top, asked)


def _twins(keys: str) -> str:
    return (
        f"twins AS (SELECT a.wardrobe_id, a.category, a.item_id, a.seq, b.seq AS other FROM item_base a JOIN item_base b "
        f"ON {keys} AND a.seq <> b.seq AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL "
        "AND list_dot_product(a.vec, b.vec) >= {t})"
    )


BOTH_KEYS = "a.wardrobe_id = b.wardrobe_id AND a.category = b.category"


@register(
    "find_duplicates",
    with_items(
        f", {_twins(BOTH_KEYS).format(t=0.97)} SELECT wardrobe_id, category, item_id, count(*) AS n_duplicates, "
        "'it' || min(other) FILTER (other < seq) AS duplicate_of FROM twins GROUP BY ALL"
    ).replace("GROUP BY ALL", "GROUP BY wardrobe_id, category, item_id"),
)
def _find(spark, sf):
    return d.find_duplicates(b.item_base(spark, sf))


@register(
    "find_duplicates_loose",
    with_items(
        f", {_twins('a.wardrobe_id = b.wardrobe_id').format(t=0.2)} SELECT wardrobe_id, item_id, count(*) AS n_duplicates, "
        "'it' || min(other) FILTER (other < seq) AS duplicate_of FROM twins GROUP BY wardrobe_id, item_id"
    ),
)
def _find_loose(spark, sf):
    return d.find_duplicates(b.item_base(spark, sf), ["wardrobe_id"], 0.2)


@register(
    "flag_duplicates",
    with_items(
        f", {_twins(BOTH_KEYS).format(t=0.97)}, half AS (SELECT item_id, count(*) AS n, min(other) AS first FROM twins "
        "WHERE seq % 2 = 1 AND other % 2 = 0 GROUP BY 1) SELECT i.item_id, coalesce(n, 0)::BIGINT AS possible_duplicates, "
        "'it' || first AS possible_duplicate_of FROM item_base i LEFT JOIN half USING (item_id) WHERE seq % 2 = 1"
    ),
)
def _flag(spark, sf):
    items = b.item_base(spark, sf)
    new, stored = items.filter(F.col("seq") % 2 == 1), items.filter(F.col("seq") % 2 == 0)
    return d.flag_duplicates(new, stored).select("item_id", "possible_duplicates", "possible_duplicate_of")


@register(
    "duplicate_groups",
    with_items(
        f", RECURSIVE_MARK {_twins('a.wardrobe_id = b.wardrobe_id').format(t=0.25)}, "
        "reach AS (SELECT wardrobe_id, seq AS node, other AS peer FROM twins UNION SELECT r.wardrobe_id, r.node, t.other "
        "FROM reach r JOIN twins t ON t.seq = r.peer) "
        "SELECT i.wardrobe_id, i.item_id, 'it' || coalesce(least(i.seq, min(r.peer)), i.seq) AS group_id FROM item_base i "
        "LEFT JOIN reach r ON r.node = i.seq GROUP BY i.wardrobe_id, i.item_id, i.seq"
    )
    .replace("RECURSIVE_MARK ", "")
    .replace("WITH ", "WITH RECURSIVE ", 1),
)
def _groups(spark, sf):
    return d.duplicate_groups(b.item_base(spark, sf), ["wardrobe_id"], 0.25).select("wardrobe_id", "item_id", "group_id")


LSH_BITS, LSH_TABLES, VERSIONS, SHAKE = 10, 12, 4, 0.03


def shaken(spark, sf):
    """Four versions of every item with a vector, each moved a little, so that near vectors are not equal ones."""
    k = F.col("version")
    moved = F.transform(
        "embedding",
        lambda x, i: x.cast("double") + ((F.col("seq") * 31 + k * 57 + i * (k * 3 + 17)) % 11 - 5) / F.lit(5.0) * F.lit(SHAKE),
    )
    versions = b.item_base(spark, sf).filter(F.col("embedding").isNotNull()).withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))))
    named = versions.withColumn("item_id", F.concat_ws("_", "item_id", "version")).withColumn("_moved", moved)
    return named.withColumn("embedding", vectors.l2_normalize(F.col("_moved"))).drop("_moved")


SHAKEN = (
    f", moved AS (SELECT wardrobe_id, category, created_at, item_id || '_' || version AS item_id, list_transform(vec, lambda x, i: x + "
    f"((seq * 31 + version * 57 + (i - 1) * (version * 3 + 17)) % 11 - 5) / 5.0::DOUBLE * {SHAKE}::DOUBLE) AS m FROM (SELECT *, unnest(range({VERSIONS})) AS version "
    "FROM item_base WHERE embedding IS NOT NULL)), shaken AS (SELECT * EXCLUDE (m), list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS u FROM moved), "
    "exact AS (SELECT a.wardrobe_id, a.category, a.item_id AS a, b.item_id AS b, list_dot_product(a.u, b.u) AS cosine FROM shaken a JOIN shaken b ON "
    "a.wardrobe_id = b.wardrobe_id AND a.category = b.category AND (a.created_at, a.item_id) < (b.created_at, b.item_id) WHERE list_dot_product(a.u, b.u) >= 0.97), "
    f"planes AS (SELECT p, list(1.0::DOUBLE - 2 * (('0x' || substr(sha1('42:plane:' || p || ':' || i), 1, 8))::BIGINT % 2) ORDER BY i) AS plane FROM range({LSH_BITS * LSH_TABLES}) x(p), "
    f"range({DIM}) y(i) GROUP BY p), codes AS (SELECT item_id, p // {LSH_BITS} AS tbl, sum(CASE WHEN list_dot_product(u, plane) >= 0 THEN 1 << (p % {LSH_BITS})::INT ELSE 0 END) AS code "
    "FROM shaken, planes GROUP BY ALL), found AS (SELECT * FROM exact e WHERE EXISTS (SELECT 1 FROM codes x JOIN codes y ON x.tbl = y.tbl AND x.code = y.code "
    "WHERE x.item_id = e.a AND y.item_id = e.b))"
)


@register("lsh_duplicates", with_items(f"{SHAKEN} SELECT wardrobe_id, category, a, b, round(cosine, 6) AS cosine, 1::BIGINT AS n_pairs FROM found"))
def _lsh(spark, sf):
    found = d.lsh_duplicates(shaken(spark, sf), bits=LSH_BITS, tables=LSH_TABLES)
    return found.withColumn("cosine", F.round("cosine", 6))


@register(
    "lsh_recall",
    with_items(
        f"{SHAKEN} SELECT (SELECT count(*) FROM exact) AS n_exact, (SELECT count(*) FROM found) AS n_found, 0::BIGINT AS n_wrong, "
        "(SELECT count(*) FROM found) >= 0.9 * (SELECT count(*) FROM exact) AS recall_at_least_90"
    ),
)
def _lsh_recall(spark, sf):
    """The approximate pairs against the exact ones: how many there are, how many are found, how many are no pairs."""
    items, keys = shaken(spark, sf), ["wardrobe_id", "category"]
    reps = d.distinct_vectors(items, keys)
    exact = d.near_vectors(reps, reps, keys, v.DUPLICATE_COSINE, ordered=True).select(*keys, F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.lit(1).alias("real"))
    found = d.lsh_duplicates(items, bits=LSH_BITS, tables=LSH_TABLES).select(*keys, "a", "b", F.lit(1).alias("seen"))
    counts = exact.join(found, [*keys, "a", "b"], "full").agg(
        F.count("real").alias("n_exact"), F.count_if(F.col("real").isNotNull() & F.col("seen").isNotNull()).alias("n_found"), F.count_if(F.col("real").isNull()).alias("n_wrong")
    )
    return counts.withColumn("recall_at_least_90", F.col("n_found") >= 0.9 * F.col("n_exact"))


@register(
    "item_conflicts",
    with_items(
        f", {_twins('a.wardrobe_id = b.wardrobe_id').format(t=0.97)}, {pairs_sql('items', condition='a.seq <> b.seq')}, "
        "i AS (SELECT wardrobe_id, item_id, count(*) AS n FROM twins GROUP BY 1, 2), "
        "r AS (SELECT wardrobe_id, ia AS item_id, count(*) AS n FROM pairs WHERE one_region GROUP BY 1, 2) "
        "SELECT wardrobe_id, item_id, coalesce(i.n, 0)::BIGINT AS same_image, coalesce(r.n, 0)::BIGINT AS same_region "
        "FROM i FULL JOIN r USING (wardrobe_id, item_id)"
    ),
)
def _conflicts(spark, sf):
    return d.item_conflicts(b.item_base(spark, sf))


# ------------------------------------------------------------------ given outfits: items of one wardrobe by p_size % 7
def given_outfits(spark, sf):
    return usable(spark, sf).withColumn("outfit_id", F.concat_ws("_", "wardrobe_id", F.col("p_size") % 7))


GIVEN = "given AS (SELECT *, wardrobe_id || '_' || (p_size % 7) AS outfit_id FROM items WHERE reason IS NULL)"


@register(
    "outfit_plausibility",
    with_items(
        f", {GIVEN}, {pairs_sql('given', 'outfit_id')}, w AS (SELECT *, CASE WHEN ca = 'accessory' OR cb = 'accessory' "
        "THEN 0.5::DOUBLE ELSE 1.0 END AS w FROM pairs) SELECT outfit_id, round(sum(w * p) / sum(w), 6) AS plausibility, "
        "round(avg(p), 6) AS mean_pair_score, round(avg(clip_cos), 6) AS visual_similarity, round(avg(style_sim), 6) AS style, "
        "round(avg(colour), 6) AS colour, round(avg(category), 6) AS category, "
        + ", ".join(f"round(avg(c_{f}), 6) AS c_{f}" for f in BASE["features"])
        + " FROM w GROUP BY outfit_id"
    ),
)
def _plausibility(spark, sf):
    scored = p.pair_scores(p.member_pairs(given_outfits(spark, sf), ["outfit_id"]), BASE)
    out = p.outfit_scores(scored, ["outfit_id"], BASE["features"])
    return out.select("outfit_id", *[r6(c, c) for c in out.columns if c != "outfit_id"])


@register(
    "outfit_colour_summary",
    with_items(
        f", {GIVEN}, {pairs_sql('given', 'outfit_id')}, h AS (SELECT outfit_id, avg(colour) AS mean, min(colour) AS low, "
        f"arg_min({case_map('relation', v.RELATION_TEXT)} || ' (' || cola || ' + ' || colb || ')', (colour, sa, sb)) AS worst "
        "FROM pairs GROUP BY 1), q AS (SELECT outfit_id, "
        f"coalesce(list(DISTINCT color ORDER BY color) FILTER (color NOT IN {NEUTRAL_SQL}), []) AS acc, "
        f"coalesce(list(DISTINCT color ORDER BY color) FILTER (color IN {NEUTRAL_SQL}), []) AS neu FROM given GROUP BY 1), "
        "t AS (SELECT *, array_to_string(acc, ' and ') AS aa, array_to_string(acc, ', ') AS ac, array_to_string(neu, ', ') AS ne "
        "FROM h JOIN q USING (outfit_id)) SELECT outfit_id, round(greatest(0, least(1, CASE WHEN len(acc) > 2 THEN mean - 0.1 * "
        "(len(acc) - 2) ELSE mean END)), 6) AS colour_score, CASE WHEN len(acc) > 2 THEN 'Busy palette: ' || len(acc) || "
        "' accent colours (' || ac || ')' WHEN len(acc) = 0 THEN 'Neutral palette (' || ne || CASE WHEN mean < 0.6 THEN "
        "') with little light/dark contrast' ELSE ')' END WHEN len(neu) > 0 THEN upper(aa[1]) || lower(aa[2:]) || "
        "' balanced by neutrals (' || ne || ')' ELSE 'Colour story: ' || ac END || CASE WHEN low < 0.5 THEN '; note ' || worst "
        "ELSE '' END AS colour_reason FROM t"
    ),
)
def _colour_summary(spark, sf):
    given = given_outfits(spark, sf)
    scored = p.pair_scores(p.member_pairs(given, ["outfit_id"]), BASE)
    out = p.colour_summary(given, scored, ["outfit_id"])
    return out.select("outfit_id", r6("colour_score", "colour_score"), "colour_reason")


@register(
    "colour_relations",
    with_items(
        f", {pairs_sql('items', condition='a.seq < b.seq')} SELECT relation, {case_map('relation', v.RELATION_TEXT)} AS text, "
        "colour, count(*) AS n FROM pairs GROUP BY ALL"
    ),
)
def _relations(spark, sf):
    from garderobe.functions.lookup import lookup

    inputs = p.pair_inputs(b.items(spark, sf))
    pairs = p.pair_features(p.item_pairs(inputs, inputs, ["wardrobe_id"], p.earlier))
    return pairs.groupBy("relation", lookup(v.RELATION_TEXT, F.col("relation")).alias("text"), "colour").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "item_pairs",
    with_items(
        f", {pairs_sql('items', condition='a.seq < b.seq')} SELECT wardrobe_id, count(*) AS n_pairs, "
        "round(min(clip_cos), 6) AS min_cos, round(max(clip_cos), 6) AS max_cos, count(*) FILTER (conflict) AS n_conflicts "
        "FROM pairs GROUP BY 1"
    ),
)
def _item_pairs(spark, sf):
    inputs = p.pair_inputs(b.items(spark, sf))
    pairs = p.pair_features(p.item_pairs(inputs, inputs, ["wardrobe_id"], p.earlier))
    return pairs.groupBy("wardrobe_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        r6(F.min("clip_cos"), "min_cos"),
        r6(F.max("clip_cos"), "max_cos"),
        F.count_if("conflict").alias("n_conflicts"),
    )
