"""Tag-ranking queries. Parts become tagged items; a wardrobe is a run of 30 part keys, an outfit a run of 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions.lookup import inline_array, lookup
from garderobe.operators import tags as t
from garderobe.plans import bindings as b
from garderobe.registry.base import register
from garderobe.registry.common import case_map, quoted
from garderobe.registry.wardrobe import r6

# --- Fixed values: tag vocabulary of the test binding ---------------------------------------------
TYPE_CATEGORY = {"STANDARD": "tops", "MEDIUM": "bottoms", "SMALL": "shoes", "LARGE": "all-body", "ECONOMY": "jewellery"}
TINTS = ("Grey", "red", "Maroon", " blue", "ivory", "green", "", "teal")
TAGS = ("Boho", "Minimal", "casual", "corporate", "floral", "sporty")
PLACES = ("office", "campus", "dinner", "club", "weekend")
SEASONS = ("summer", "winter", "spring", "autumn")
FABRICS = ("wool", "linen", "unknown", "suede")
FORMAL = ("casual", "smart-casual", "formal", "unknown")


def tagged(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda words, i: F.get(inline_array(words), (i % len(words)).cast("int"))
    return b.table(spark, sf, "part").select(
        F.floor(k / 30).cast("bigint").alias("wardrobe_id"),
        F.concat(F.lit("t"), k).alias("item_id"),
        F.coalesce(lookup(TYPE_CATEGORY, F.col("p_type")), F.lit("bags")).alias("category"),
        F.col("p_name").alias("title"),
        F.lit("unknown").alias("garment_type"),
        F.lit("plain").alias("pattern"),
        pick(FABRICS, size).alias("material"),
        F.lit("loose").alias("fit"),
        pick(FORMAL, size).alias("formality"),
        F.array(pick(TINTS, size), pick(TINTS, k)).alias("colors"),
        F.array(pick(TAGS, size), pick(TAGS, k)).alias("style_tags"),
        F.when(size % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(SEASONS, size))).alias("season"),
        F.array(pick(PLACES, size)).alias("occasion"),
        F.col("p_retailprice").alias("price"),
        k.alias("p_partkey"),
    )


def price_score(x, y):
    """Stands in for a learned pair model: closer prices score higher."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(x["price"] - y["price"]))


def _arr(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def _pick(words, i: str) -> str:
    return f"{_arr(words)}[{i} % {len(words)} + 1]"


def _any(words, col: str) -> str:
    return f"len(list_intersect({col}, {_arr(words)}))"


TAGGED = (
    f"tg AS (SELECT p_partkey // 30 AS wardrobe_id, p_partkey // 4 AS outfit_id, p_partkey, 't' || p_partkey AS item_id, {case_map('p_type', TYPE_CATEGORY, chr(39) + 'bags' + chr(39))} "
    f"AS category, p_name AS title, {_pick(FABRICS, 'p_size')} AS material, {_pick(FORMAL, 'p_size')} AS formality, list_distinct(list_transform(list_filter("
    f"list_transform([{_pick(TINTS, 'p_size')}, {_pick(TINTS, 'p_partkey')}], lambda c: lower(trim(c))), lambda c: c <> ''), lambda c: coalesce("
    f"{case_map('c', v.TAG_COLOUR_ALIASES)}, c))) AS colours, list_transform([{_pick(TINTS, 'p_size')}, {_pick(TINTS, 'p_partkey')}], lambda c: lower(trim(c))) AS raw_colours, "
    f"list_distinct([lower({_pick(TAGS, 'p_size')}), lower({_pick(TAGS, 'p_partkey')})]) AS tags, CASE WHEN p_size % 3 = 0 THEN [] ELSE [{_pick(SEASONS, 'p_size')}] END AS season, "
    f"[{_pick(PLACES, 'p_size')}] AS occasion, p_retailprice AS price FROM part), "
    "tf AS (SELECT *, list_distinct(list_filter(list_concat(['plain', material, 'loose', formality], tags, occasion, season, raw_colours), lambda w: w NOT IN ('', 'unknown'))) AS "
    "feats FROM tg), "
    f"tm AS (SELECT *, CASE WHEN {_any(v.OCCASION_WORDS['work'], 'occasion')} > 0 THEN 1.0 WHEN formality IN ('smart-casual', 'formal') THEN 0.95 ELSE 0.2 END::DOUBLE AS occ, "
    f"CASE WHEN {_any(v.AESTHETIC_EXCLUDES['boho'], 'tags')} > 0 THEN 0.05 WHEN {_any(v.AESTHETIC_WORDS['boho'], 'tags')} > 0 THEN 1.0 WHEN "
    f"{_any(v.AESTHETIC_WORDS['boho'], 'feats')} >= 2 THEN 0.85 WHEN {_any(v.AESTHETIC_WORDS['boho'], 'feats')} = 1 THEN 0.65 ELSE 0.15 END::DOUBLE AS aest, "
    f"CASE WHEN {_any(v.WEATHER_CLASH['hot'], 'feats')} > 0 THEN 0.1 WHEN {_any(v.WEATHER_SEASONS['hot'], 'season')} > 0 THEN 1.0 WHEN len(season) = 0 THEN 0.55 ELSE 0.2 END::DOUBLE AS wx FROM tf), "
    "ti AS (SELECT *, (occ + aest + wx) / 3 AS match FROM tm)"
)
PAIRED = (
    ", tp AS (SELECT a.outfit_id, CASE WHEN len(a.colours) > 0 AND len(b.colours) > 0 THEN CASE WHEN list_has_any(a.colours, b.colours) THEN 1.0 WHEN list_has_any(a.colours, "
    f"{_arr(v.TAG_NEUTRALS)}) OR list_has_any(b.colours, {_arr(v.TAG_NEUTRALS)}) THEN 0.72 ELSE 0.5 END END::DOUBLE AS col, least(1.0, len(list_intersect(a.tags, b.tags)) / "
    "2.0::DOUBLE) AS sty, 1 / (1 + abs(a.price - b.price)) AS ml FROM ti a JOIN ti b ON a.outfit_id = b.outfit_id AND a.p_partkey < b.p_partkey), "
    f"c AS (SELECT outfit_id, avg(match) FILTER (category IN {str(v.TAG_CORE)}) AS core, avg(match) FILTER (category NOT IN {str(v.TAG_CORE)}) AS acc FROM ti GROUP BY 1), "
    "s AS (SELECT c.outfit_id, coalesce(avg(ml), 0) AS compatibility, coalesce(avg(col), 0.5) AS color_coherence, coalesce(0.5 + 0.5 * avg(sty), 0.5) AS style_coherence, "
    "CASE WHEN any_value(core) IS NULL THEN any_value(acc) WHEN any_value(acc) IS NULL THEN any_value(core) ELSE 0.85 * any_value(core) + 0.15 * any_value(acc) END AS "
    "constraint_match FROM c LEFT JOIN tp USING (outfit_id) GROUP BY 1)"
)
REQUEST = {"occasion": "work", "aesthetic": "boho", "weather": "hot"}


@register("normalized_colors", f"WITH {TAGGED} SELECT item_id, array_to_string(list_sort(colours), ',') AS colours FROM tg")
def _colors(spark, sf):
    return tagged(spark, sf).select(
        "item_id", F.array_join(F.array_sort(t.normalized_colors(F.col("colors"))), ",").alias("colours")
    )


@register("item_request_match", f"WITH {TAGGED} SELECT item_id, round(match, 6) AS match, round(wx, 6) AS weather FROM ti")
def _match(spark, sf):
    return tagged(spark, sf).select(
        "item_id", r6(t.item_request_match(**REQUEST), "match"), r6(t.item_request_match(weather="hot"), "weather")
    )


def given(spark, sf):
    items = tagged(spark, sf).withColumn("m", t.member(**REQUEST, extra=("price",)))
    row = F.sort_array(F.collect_list(F.struct("p_partkey", "m")))
    out = items.groupBy(F.floor(F.col("p_partkey") / 4).cast("bigint").alias("outfit_id")).agg(row.alias("r"))
    return out.select("outfit_id", F.transform("r", lambda x: x["m"]).alias("members"))


@register(
    "rank_outfit",
    f"WITH {TAGGED}{PAIRED} SELECT outfit_id, round(compatibility, 6) AS compatibility, round(color_coherence, 6) AS color_coherence, round(style_coherence, 6) AS style_coherence, "
    "round(constraint_match, 6) AS constraint_match, round(0.55 * compatibility + 0.1 * color_coherence + 0.1 * style_coherence + 0.25 * constraint_match, 6) AS rank_score FROM s",
)
def _rank(spark, sf):
    out = t.rank_outfit(given(spark, sf), price_score, True)
    cols = ("compatibility", "color_coherence", "style_coherence", "constraint_match", "rank_score")
    return out.select("outfit_id", *[r6(c, c) for c in cols])


@register(
    "template_explanation",
    f"WITH {TAGGED}{PAIRED}, n AS (SELECT outfit_id, string_agg(title, ', ' ORDER BY p_partkey) AS names FROM tg GROUP BY 1) SELECT outfit_id, "
    "'The compatibility model scored this outfit ' || round(compatibility::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR || '/1.0. The visual attribute layer found color coherence of ' || "
    "round(color_coherence::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR || ' and style coherence of ' || round(style_coherence::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR || '. Items used: ' || names || '.' AS explanation FROM s JOIN n USING (outfit_id)",
)
def _explain(spark, sf):
    out = t.rank_outfit(given(spark, sf), price_score, True)
    return out.select("outfit_id", t.template_explanation().alias("explanation"))


def _pool(alias: str, cat: str) -> str:
    return f"(SELECT wardrobe_id, item_id FROM tg WHERE category = '{cat}') {alias}"


def _enumerated() -> str:
    parts = []
    for tpl in v.TAG_TEMPLATES:
        joins = _pool("a0", tpl[0]) + "".join(f" JOIN {_pool(f'a{i}', c)} USING (wardrobe_id)" for i, c in enumerate(tpl) if i)
        parts.append(f"SELECT wardrobe_id, '{'+'.join(tpl)}' AS template, count(*) AS n FROM {joins} GROUP BY 1")
    return " UNION ALL ".join(parts)


@register("legacy_candidates", f"WITH {TAGGED}, e AS ({_enumerated()}) SELECT wardrobe_id, template, n FROM e")
def _candidates(spark, sf):
    out = t.legacy_candidates(tagged(spark, sf))
    return out.groupBy("wardrobe_id", "template").agg(F.count(F.lit(1)).alias("n"))


def _ranked_sql() -> str:
    """CTE r: every combination with its rank score; pairs in member order, as the Spark side adds them."""
    parts = []
    for tpl in v.TAG_TEMPLATES:
        n = len(tpl)
        pairs = [(f"a{i}", f"a{j}") for i in range(n) for j in range(i + 1, n)]
        ml = ", ".join(f"1 / (1 + abs({x}.price - {y}.price))" for x, y in pairs)
        col = ", ".join(
            f"CASE WHEN len({x}.colours) > 0 AND len({y}.colours) > 0 THEN CASE WHEN list_has_any({x}.colours, {y}.colours) THEN 1.0 WHEN "
            f"list_has_any({x}.colours, {_arr(v.TAG_NEUTRALS)}) OR list_has_any({y}.colours, {_arr(v.TAG_NEUTRALS)}) THEN 0.72 ELSE 0.5 END END::DOUBLE"
            for x, y in pairs
        )
        sty = ", ".join(f"least(1.0, len(list_intersect({x}.tags, {y}.tags)) / 2.0::DOUBLE)" for x, y in pairs)
        core = ", ".join(f"a{i}.match" for i, c in enumerate(tpl) if c in v.TAG_CORE)
        extra = ", ".join(f"a{i}.match" for i, c in enumerate(tpl) if c not in v.TAG_CORE)
        con = f"0.85 * list_avg([{core}]) + 0.15 * list_avg([{extra}])" if extra else f"list_avg([{core}])"
        source = f"(SELECT * FROM ti WHERE category = '{tpl[0]}') a0" + "".join(
            f" JOIN (SELECT * FROM ti WHERE category = '{c}') a{i} USING (wardrobe_id)" for i, c in enumerate(tpl) if i
        )
        parts.append(
            f"SELECT wardrobe_id, '{'+'.join(tpl)}' AS template, '{'+'.join(sorted(set(tpl)))}' AS signature, [{', '.join(f'a{i}.item_id' for i in range(n))}] AS ids, "
            f"list_avg([{ml}]) AS ml, coalesce(list_avg(list_filter([{col}], lambda x: x IS NOT NULL)), 0.5) AS col, 0.5 + 0.5 * list_avg([{sty}]) AS sty, {con} AS con FROM {source}"
        )
    return "q AS (" + " UNION ALL ".join(parts) + "), r AS (SELECT *, 0.55 * ml + 0.1 * col + 0.1 * sty + 0.25 * con AS s FROM q WHERE con >= 0.5)"


def _shown(df):
    ids = F.array_join(F.transform("members", lambda m: m["item_id"]), ",")
    return df.select("wardrobe_id", "choice", "position", "signature", ids.alias("items"), r6("rank_score", "rank_score"))


@register(
    "diversified_by_signature",
    f"WITH {TAGGED}, {_ranked_sql()}, p AS (SELECT *, row_number() OVER (PARTITION BY wardrobe_id ORDER BY round(s, 12) DESC, template, ids) AS position FROM r), "
    "f AS (SELECT *, (row_number() OVER (PARTITION BY wardrobe_id, signature ORDER BY position) > 1)::INT AS later FROM p WHERE position <= 250), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY wardrobe_id ORDER BY later, position) AS choice FROM f) SELECT wardrobe_id, choice, position, signature, "
    "array_to_string(ids, ',') AS items, round(s, 6) AS rank_score FROM c WHERE choice <= 3",
)
def _diverse(spark, sf):
    cands = t.legacy_candidates(tagged(spark, sf), **REQUEST, extra=("price",))
    return _shown(t.diversified_by_signature(t.rank_candidates(cands, price_score, 250, requested=True), 3))


@register(
    "two_piece_ranking",
    f"WITH {TAGGED}, c AS (SELECT a.wardrobe_id, a.item_id || ',' || b.item_id AS items, 1 / (1 + abs(a.price - b.price)) AS ml, CASE WHEN len(a.colours) > 0 AND len(b.colours) > "
    f"0 THEN CASE WHEN list_has_any(a.colours, b.colours) THEN 1.0 WHEN list_has_any(a.colours, {_arr(v.TAG_NEUTRALS)}) OR list_has_any(b.colours, {_arr(v.TAG_NEUTRALS)}) THEN 0.72 "
    "ELSE 0.5 END ELSE 0.5 END::DOUBLE AS col, 0.5 + 0.5 * least(1.0, len(list_intersect(a.tags, b.tags)) / 2.0::DOUBLE) AS sty, (a.match + b.match) / 2 AS m, a.item_id AS ai, b.item_id "
    "AS bi FROM ti a JOIN ti b ON a.wardrobe_id = b.wardrobe_id AND a.category = 'all-body' AND b.category = 'shoes'), r AS (SELECT *, 0.55 * ml + 0.1 * col + 0.1 * sty + 0.25 * m AS s "
    "FROM c WHERE m >= 0.5), p AS (SELECT *, row_number() OVER (PARTITION BY wardrobe_id ORDER BY round(s, 12) DESC, ai, bi) AS position FROM r) SELECT wardrobe_id, items, position, "
    "round(s, 6) AS rank_score FROM p WHERE position <= 10",
)
def _two(spark, sf):
    cands = t.legacy_candidates(tagged(spark, sf), **REQUEST, accessories=False, extra=("price",))
    only = cands.filter(F.col("template") == "all-body+shoes")
    ranked = t.rank_candidates(only, price_score, 10, requested=True)
    ids = F.array_join(F.transform("members", lambda m: m["item_id"]), ",")
    return ranked.select("wardrobe_id", ids.alias("items"), "position", r6("rank_score", "rank_score"))
