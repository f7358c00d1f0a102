"""Outfit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.operators import bounds
from garderobe.operators import outfits as o
from garderobe.operators import wardrobe as w
from garderobe.plans import bindings as b
from garderobe.plans.generate import generate_outfits
from garderobe.plans.requests import generate_for_requests
from garderobe.registry.base import register
from garderobe.registry.common import case_map, with_items
from garderobe.registry.pairs import BASE, GIVEN, given_outfits, pairs_sql, usable
from garderobe.registry.wardrobe import DIM, MODEL, r6
from garderobe.session import written

CUT = 0.1  # the bundled cut-off was fitted on real photos; random test vectors score far lower


def ids(c: str):
    return F.array_join(F.transform(c, lambda g: g["item_id"]), ",")


def pool_of(spark, sf, **options):
    return o.outfit_pool(usable(spark, sf), **options)


CTX = (
    "CASE WHEN style_scores IS NOT NULL THEN least(1.0, style_scores[3] / list_max(style_scores)) END"  # formal
)
POOL = "pool AS (SELECT *, NULL::VARCHAR AS forced FROM items WHERE reason IS NULL)"


def core_sql(pool: str = POOL, ctx: str = "NULL::DOUBLE") -> str:
    return f""", {pool}, {pairs_sql("pool", condition="a.seq <> b.seq")},
    px AS (SELECT *, {ctx} AS ctx FROM pool),
    core AS (
      SELECT t.wardrobe_id, 'top+bottom+shoes' AS template, t.item_id AS m1, b.item_id AS m2, s.item_id AS m3,
        t.seq AS s1, b.seq AS s2, s.seq AS s3, p1.p + p2.p + p3.p AS total, 3.0::DOUBLE AS weight,
        (coalesce(t.ctx, 0) + coalesce(b.ctx, 0) + coalesce(s.ctx, 0)) / nullif((t.ctx IS NOT NULL)::INT +
          (b.ctx IS NOT NULL)::INT + (s.ctx IS NOT NULL)::INT, 0) AS ctx
      FROM px t JOIN px b ON b.wardrobe_id = t.wardrobe_id AND b.category = 'bottom'
      JOIN px s ON s.wardrobe_id = t.wardrobe_id AND s.category = 'shoes'
      JOIN pairs p1 ON p1.ia = t.item_id AND p1.ib = b.item_id AND NOT p1.conflict
      JOIN pairs p2 ON p2.ia = t.item_id AND p2.ib = s.item_id AND NOT p2.conflict
      JOIN pairs p3 ON p3.ia = b.item_id AND p3.ib = s.item_id AND NOT p3.conflict WHERE t.category = 'top'
      UNION ALL
      SELECT t.wardrobe_id, 'one_piece+shoes', t.item_id, NULL, s.item_id, t.seq, NULL, s.seq, p1.p, 1.0::DOUBLE,
        (coalesce(t.ctx, 0) + coalesce(s.ctx, 0)) / nullif((t.ctx IS NOT NULL)::INT + (s.ctx IS NOT NULL)::INT, 0)
      FROM px t JOIN px s ON s.wardrobe_id = t.wardrobe_id AND s.category = 'shoes'
      JOIN pairs p1 ON p1.ia = t.item_id AND p1.ib = s.item_id AND NOT p1.conflict WHERE t.category = 'one_piece')"""


def layer_sql(name: str, source: str, layer: str, weight: str, extra: str = "", forced: str = "false") -> str:
    """CTE ``name``: ``source`` plus column ``layer`` (item or null), its sequence, and the new total and weight."""
    outer_join = "LEFT JOIN pairs p4 ON p4.ia = c.outerwear AND p4.ib = l.item_id" if extra else ""
    outer_add = " + coalesce(p4.p, 0)" if extra else ""
    outer_ok = "AND (c.outerwear IS NULL OR NOT p4.conflict)" if extra else ""
    count = "(2 + (c.m2 IS NOT NULL)::INT" + (" + (c.outerwear IS NOT NULL)::INT" if extra else "") + ")"
    return f"""{name}_all AS (
      SELECT c.m1, c.m2, c.m3, l.item_id AS li, l.seq AS ls, p1.p + coalesce(p2.p, 0) + p3.p{outer_add} AS add
      FROM {source} c JOIN pool l ON l.wardrobe_id = c.wardrobe_id AND l.category = '{layer}'
      JOIN pairs p1 ON p1.ia = c.m1 AND p1.ib = l.item_id AND NOT p1.conflict
      LEFT JOIN pairs p2 ON p2.ia = c.m2 AND p2.ib = l.item_id
      JOIN pairs p3 ON p3.ia = c.m3 AND p3.ib = l.item_id AND NOT p3.conflict {outer_join}
      WHERE (c.m2 IS NULL OR NOT p2.conflict) {outer_ok}),
    {name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m1, m2, m3 ORDER BY add DESC, ls) AS rn
      FROM {name}_all) WHERE rn = 1),
    {name} AS (
      SELECT * EXCLUDE (take, li, ls, add, cnt, total, weight), CASE WHEN take THEN li END AS {layer},
        CASE WHEN take THEN ls END AS {layer}_seq, CASE WHEN take THEN total + {weight} * add ELSE total END AS total,
        CASE WHEN take THEN weight + {weight} * cnt ELSE weight END AS weight
      FROM (SELECT c.*, b.li, b.ls, b.add, {count} AS cnt, b.li IS NOT NULL AND ({forced} OR
          (c.total + {weight} * b.add) / (c.weight + {weight} * {count}) >= c.total / c.weight) AS take
        FROM {source} c LEFT JOIN {name}_best b ON b.m1 = c.m1 AND b.m2 IS NOT DISTINCT FROM c.m2 AND b.m3 = c.m3)
      WHERE NOT ({forced}) OR li IS NOT NULL)"""


def candidates_sql(pool: str = POOL, ctx: str = "NULL::DOUBLE") -> str:
    return (
        core_sql(pool, ctx)
        + ", "
        + layer_sql("l1", "core", "outerwear", "1.0::DOUBLE")
        + ", "
        + layer_sql("l2", "l1", "accessory", "0.5::DOUBLE", extra="o")
        + """, cand AS (SELECT *, total / weight AS score, total / weight + coalesce(0.1::DOUBLE * (ctx - 0.5), 0) AS rank,
      concat_ws(',', m1, m2, m3, outerwear, accessory) AS members,
      list_filter([s1, s2, s3, outerwear_seq, accessory_seq], lambda x: x IS NOT NULL) AS key FROM l2)"""
    )


@register(
    "core_combinations",
    with_items(
        core_sql()
        + " SELECT wardrobe_id, template, concat_ws(',', m1, m2, m3) AS members, round(total, 6) AS total, weight FROM core"
    ),
)
def _core(spark, sf):
    core = o.core_of(pool_of(spark, sf), BASE)
    return core.select(
        "wardrobe_id", "template", ids(F.array_compact(F.array("m1", "m2", "m3"))).alias("members"), r6("total", "total"), "weight"
    )


@register(
    "validity_antijoin",
    with_items(
        core_sql()
        + ", n AS (SELECT wardrobe_id, count(*) FILTER (category = 'top') * count(*) FILTER (category = 'bottom') * "
        "count(*) FILTER (category = 'shoes') + count(*) FILTER (category = 'one_piece') * count(*) FILTER (category = 'shoes') "
        "AS combos FROM pool GROUP BY 1), k AS (SELECT wardrobe_id, count(*) AS valid FROM core GROUP BY 1) "
        "SELECT wardrobe_id, combos::BIGINT AS combinations, coalesce(valid, 0)::BIGINT AS valid, "
        "(combos - coalesce(valid, 0))::BIGINT AS rejected FROM n LEFT JOIN k USING (wardrobe_id) WHERE combos > 0"
    ),
)
def _antijoin(spark, sf):
    pool = pool_of(spark, sf)
    plans = o.templates_for(o.pool_sizes(pool)).groupBy("wardrobe_id").agg(F.sum("total").cast("bigint").alias("combinations"))
    valid = o.core_counts(o.core_scores(pool, BASE))
    return (
        plans.join(valid, "wardrobe_id", "left")
        .fillna(0, ["valid"])
        .withColumn("rejected", F.col("combinations") - F.col("valid"))
    )


def _rows(df):
    return df.select("wardrobe_id", "template", ids("members").alias("members"), r6("score", "score"), r6("rank", "rank"))


@register(
    "best_layer",
    with_items(candidates_sql() + " SELECT wardrobe_id, template, members, round(score, 6) AS score, round(rank, 6) AS rank FROM cand"),
)
def _layers(spark, sf):
    return _rows(o.build_candidates(pool_of(spark, sf), BASE)[0])


@register(
    "quality_threshold",
    with_items(
        candidates_sql(ctx=CTX) + f" SELECT wardrobe_id, template, members, round(score, 6) AS score, round(rank, 6) AS rank FROM cand "
        f"WHERE score >= {CUT}"
    ),
)
def _threshold(spark, sf):
    return _rows(o.quality_threshold(o.build_candidates(pool_of(spark, sf, style_name="formal"), BASE)[0], CUT))


@register(
    "rank_candidates",
    with_items(
        candidates_sql(ctx=CTX) + f" SELECT wardrobe_id, members, position, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY wardrobe_id ORDER BY rank DESC, key) AS position FROM cand WHERE score >= {CUT})"
    ),
)
def _ranked(spark, sf):
    cands = o.build_candidates(pool_of(spark, sf, style_name="formal"), BASE)[0]
    # What names and orders a candidate, so that no more of it travels to its place.
    worn = F.transform("members", lambda g: F.struct(g["created_at"].alias("created_at"), g["item_id"].alias("item_id")))
    strong = o.quality_threshold(cands, CUT).select("wardrobe_id", worn.alias("members"), "rank")
    ranked = o.rank_candidates(strong)
    return ranked.select("wardrobe_id", ids("members").alias("members"), "position", r6("rank", "rank"))


@register(
    "best_candidates",
    with_items(
        candidates_sql(ctx=CTX) + " SELECT wardrobe_id, members, position, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER "
        "(PARTITION BY wardrobe_id ORDER BY rank DESC, key) AS position FROM cand) WHERE position <= 10"
    ),
)
def _best_candidates(spark, sf):
    out = bounds.best_candidates(pool_of(spark, sf, style_name="formal"), BASE, 10).ranked
    return out.select("wardrobe_id", ids("members").alias("members"), "position", r6("rank", "rank"))


FORCED = (
    "want AS (SELECT wardrobe_id, max(seq) AS want FROM items WHERE reason IS NULL AND category = 'outerwear' GROUP BY 1), "
    "pool AS (SELECT i.*, CASE WHEN want IS NOT NULL THEN 'outerwear' END AS forced FROM items i LEFT JOIN want USING "
    "(wardrobe_id) WHERE reason IS NULL AND category <> 'accessory' AND (category <> 'outerwear' OR seq = want))"
)


@register(
    "required_item",
    with_items(
        core_sql(FORCED) + ", f AS (SELECT c.*, w.want IS NOT NULL AS must FROM core c LEFT JOIN want w USING (wardrobe_id)), "
        + layer_sql("l1", "f", "outerwear", "1.0::DOUBLE", forced="must")
        + " SELECT wardrobe_id, template, concat_ws(',', m1, m2, m3, outerwear) AS members, round(total / weight, 6) AS score FROM l1"
    ),
)
def _required(spark, sf):
    items = usable(spark, sf)
    wanted = (
        items.filter(F.col("category") == "outerwear")
        .groupBy("wardrobe_id")
        .agg(F.max_by("item_id", "seq").alias("item_id"))
    )
    pool = o.outfit_pool(items, required=wanted)
    cands = o.build_candidates(pool, BASE, include_outerwear=False, include_accessory=False)[0]
    return cands.select("wardrobe_id", "template", ids("members").alias("members"), r6("score", "score"))


@register(
    "prune_pools",
    with_items(
        f", {POOL}, {pairs_sql('pool', condition='a.seq <> b.seq')}, n AS (SELECT wardrobe_id, count(*) FILTER (category = 'top') "
        "* count(*) FILTER (category = 'bottom') * count(*) FILTER (category = 'shoes') AS total FROM pool GROUP BY 1), "
        "c AS (SELECT p.* FROM pool p JOIN n USING (wardrobe_id) WHERE category IN ('top', 'bottom', 'shoes') AND total > 0), "
        "s AS (SELECT ia, max(p) AS strength FROM pairs WHERE ca <> cb AND ca IN ('top', 'bottom', 'shoes') AND cb IN ('top', "
        "'bottom', 'shoes') GROUP BY 1) SELECT wardrobe_id, category, item_id FROM (SELECT c.*, n.total, row_number() OVER "
        "(PARTITION BY c.wardrobe_id, category ORDER BY strength DESC, seq) AS rn FROM c JOIN n USING (wardrobe_id) "
        "JOIN s ON s.ia = c.item_id) WHERE total <= 30 OR rn <= 3"
    ),
)
def _prune(spark, sf):
    kept, _ = o.prune_pools(pool_of(spark, sf), BASE, "top+bottom+shoes", limit=30)
    return kept.select("wardrobe_id", "category", "item_id")


OWN_GROUPS = "gg AS (SELECT seq, seq AS g FROM pool)"
COPY_GROUPS = (
    "gg AS (SELECT a.seq, min(b.seq) AS g FROM pool a JOIN pool b ON a.wardrobe_id = b.wardrobe_id AND a.category = b.category AND "
    "(a.seq = b.seq OR list_dot_product(a.vec, b.vec) >= 0.97) GROUP BY a.seq)"
)


def diverse_sql(k: int, groups: str = OWN_GROUPS) -> str:
    """CTEs strong, c1 .. ck and chosen: the greedy selection, written out choice by choice."""
    ids = "list_distinct(list_filter([{}], lambda x: x IS NOT NULL))"
    seqs = ("s1", "s2", "s3", "outerwear_seq", "accessory_seq")
    joins = " ".join(f"LEFT JOIN gg g{i} ON g{i}.seq = c.{q}" for i, q in enumerate(seqs))
    out = (
        f", strong AS (SELECT * FROM cand WHERE score >= {CUT}), {groups}, d0 AS (SELECT c.*, {ids.format('g0.g, g1.g, g2.g')} AS core_g, "
        f"{ids.format('g0.g, g1.g, g2.g, g3.g, g4.g')} AS look_g FROM strong c {joins})"
    )

    def overlap(column: str, other: str) -> str:
        return f"len(list_intersect(d0.{column}, {other}.{column}))::DOUBLE / greatest(len(d0.{column}), len({other}.{column}))"

    for n in range(1, k + 1):
        before = [f"c{i}" for i in range(1, n)]
        joined = "".join(f" JOIN {c} ON {c}.wardrobe_id = d0.wardrobe_id AND {c}.key <> d0.key AND {overlap('core_g', c)} <= 0.5 + 1e-9" for c in before)
        worst = f"greatest({', '.join(overlap('look_g', c) for c in before)})" if before else "0"
        out += (
            f", c{n} AS (SELECT * EXCLUDE (rn) FROM (SELECT d0.*, row_number() OVER (PARTITION BY d0.wardrobe_id ORDER BY d0.rank - 0.6::DOUBLE * {worst} DESC, "
            f"d0.rank DESC, d0.key) AS rn FROM d0{joined}) WHERE rn = 1)"
        )
    return out + ", chosen AS (" + " UNION ALL ".join(f"SELECT *, {n} AS choice FROM c{n}" for n in range(1, k + 1)) + ")"


SHOWN = (
    candidates_sql() + diverse_sql(3) + ", worn AS (SELECT wardrobe_id, unnest(str_split(members, ',')) AS item_id FROM strong), "
    "shown AS (SELECT wardrobe_id, choice, unnest(str_split(members, ',')) AS item_id FROM chosen)"
)


@register(
    "exposure",
    with_items(
        SHOWN + " SELECT p.wardrobe_id, p.item_id, p.category, (SELECT count(*) FROM worn w WHERE w.item_id = p.item_id) AS "
        "in_strong_candidates, (SELECT count(*) FROM shown s WHERE s.item_id = p.item_id) AS selected FROM pool p"
    ),
)
def _exposure(spark, sf):
    pool = pool_of(spark, sf)
    strong = written(o.quality_threshold(o.build_candidates(pool, BASE)[0], CUT))
    return o.exposure(pool, strong, o.diverse_topk(strong, 3)).select(
        "wardrobe_id", "item_id", "category", "in_strong_candidates", "selected"
    )


@register(
    "funnel",
    with_items(
        SHOWN + ", n AS (SELECT wardrobe_id, count(*) FILTER (category = 'top') AS t, count(*) FILTER (category = 'bottom') AS b, "
        "count(*) FILTER (category = 'shoes') AS s, count(*) FILTER (category = 'one_piece') AS d, count(*) FILTER "
        "(category = 'outerwear') AS o, count(*) FILTER (category = 'accessory') AS a FROM pool GROUP BY 1) "
        "SELECT i.wardrobe_id, count(*) AS wardrobe_items, count(*) FILTER (reason IS NULL) AS eligible_items, "
        "coalesce(any_value((t * b * s + d * s) * (o + 1) * (a + 1)), 0)::BIGINT AS structural_combinations, "
        "coalesce(any_value(t * b * s + d * s), 0)::BIGINT AS core_combinations, "
        "(SELECT count(*) FROM cand c WHERE c.wardrobe_id = i.wardrobe_id) AS candidates_scored, "
        "(SELECT count(*) FROM strong c WHERE c.wardrobe_id = i.wardrobe_id) AS above_threshold, "
        "(SELECT count(DISTINCT choice) FROM shown c WHERE c.wardrobe_id = i.wardrobe_id) AS returned, "
        "(SELECT count(DISTINCT item_id) FROM shown c WHERE c.wardrobe_id = i.wardrobe_id) AS unique_items_in_results, "
        "coalesce(any_value(t * b * s + d * s), 0)::BIGINT - (SELECT count(*) FROM cand c WHERE c.wardrobe_id = i.wardrobe_id) AS rejected_by_validity "
        "FROM items i LEFT JOIN n USING (wardrobe_id) GROUP BY i.wardrobe_id"
    ),
)
def _funnel(spark, sf):
    judged = w.eligible_items(b.items(spark, sf), MODEL, DIM)
    pool = o.outfit_pool(judged.filter(F.col("reason").isNull()))
    cands, core, _ = o.build_candidates(pool, BASE)
    cands = written(cands)
    chosen = o.diverse_topk(o.quality_threshold(cands, CUT), 3)
    return o.funnel(judged, pool, cands, core, chosen, CUT)


@register(
    "shortage_message",
    with_items(
        ", few AS (SELECT item_id, category, seq % 100 AS wardrobe_id FROM items WHERE reason IS NULL), "
        + "n AS (SELECT wardrobe_id, "
        + ", ".join(f"count(*) FILTER (category = '{s}') AS n_{s}" for s in v.SLOTS)
        + " FROM few GROUP BY 1), h AS (SELECT *, coalesce(nullif(concat_ws(', ', "
        + ", ".join(f"CASE WHEN n_{s} > 0 THEN n_{s} || ' {v.SLOT_NAMES[s].lower()}' END" for s in sorted(v.SLOTS))
        + "), ''), 'nothing usable') AS owned FROM n) SELECT wardrobe_id, CASE WHEN n_shoes = 0 THEN 'Every outfit needs shoes, "
        "and there are no usable shoes in your wardrobe. Usable items: ' || owned || '.' WHEN NOT (n_top > 0 AND n_bottom > 0 "
        "OR n_one_piece > 0) THEN 'Not enough items for an outfit: add at least one top and one bottom, or a dress/one-piece, "
        "plus shoes. Usable items: ' || owned || '.' END AS message FROM h"
    ),
)
def _shortage(spark, sf):
    small = usable(spark, sf).withColumn("wardrobe_id", F.col("seq") % 100)
    sizes = o.pool_sizes(small.withColumn("forced", F.lit(None).cast("string")))
    return o.shortage_message(sizes).select("wardrobe_id", "message")


GIVEN_ALL = "given AS (SELECT *, wardrobe_id || '_' || (p_size % 7) AS outfit_id FROM items)"


@register(
    "structural_validity",
    with_items(
        f", {GIVEN_ALL}, {pairs_sql('given', 'outfit_id')}, l AS (SELECT item_id, label FROM items), "
        "h AS (SELECT outfit_id, bool_or(category = 'top') AS t, bool_or(category = 'bottom') AS b, "
        "bool_or(category = 'one_piece') AS d, bool_or(category = 'shoes') AS s FROM given GROUP BY 1) "
        "SELECT DISTINCT outfit_id, 1 AS stage, label || ' (' || category || ') is not eligible: ' || reason AS why FROM given "
        "WHERE reason IS NOT NULL UNION ALL SELECT outfit_id, 2, 'contains ' || count(*) || ' items of the same type (' || "
        f"lower({case_map('category', v.SLOT_NAMES)}) || ')' FROM given GROUP BY outfit_id, category HAVING count(*) > 1 "
        "UNION ALL SELECT outfit_id, 3, 'a dress/one-piece cannot be worn with a separate top or bottom' FROM h WHERE d AND (t OR b) "
        "UNION ALL SELECT outfit_id, 4, CASE WHEN t THEN 'a top needs a bottom (or use a dress/one-piece)' WHEN b THEN "
        "'a bottom needs a top (or use a dress/one-piece)' ELSE 'no main garment: needs a top + bottom or a dress/one-piece' END "
        "FROM h WHERE NOT (d OR (t AND b)) UNION ALL SELECT outfit_id, 5, 'no shoes' FROM h WHERE NOT s "
        "UNION ALL SELECT DISTINCT outfit_id, 6, 'two items are the same garment (same photo region or identical image)' FROM pairs "
        "WHERE conflict UNION ALL SELECT DISTINCT outfit_id, 7, x.label || ' and ' || y.label || ' are the same region of the same "
        "photo' FROM pairs JOIN l x ON x.item_id = ia JOIN l y ON y.item_id = ib WHERE one_region"
    ),
)
def _validity(spark, sf):
    judged = w.eligible_items(b.items(spark, sf), MODEL, DIM)
    given = judged.withColumn("outfit_id", F.concat_ws("_", "wardrobe_id", F.col("p_size") % 7))
    return o.structural_validity(given, ["outfit_id"])


@register(
    "structure_text",
    with_items(
        f", {GIVEN} SELECT outfit_id, 'Valid ' || array_to_string(list_transform(list_filter("
        f"['top', 'bottom', 'one_piece', 'shoes', 'outerwear', 'accessory'], lambda s: list_contains(list(category), s)), "
        f"lambda s: lower({case_map('s', v.SLOT_NAMES)})), ' + ') || ' structure' AS structure FROM given GROUP BY outfit_id"
    ),
)
def _structure(spark, sf):
    slots = given_outfits(spark, sf).groupBy("outfit_id").agg(F.collect_set("category").alias("slots"))
    return slots.select("outfit_id", o.structure_text(F.col("slots")).alias("structure"))


def _job(spark, sf, **options):
    return generate_outfits(b.items(spark, sf), MODEL, DIM, BASE, threshold=CUT, **options)


DATE = (
    "CASE WHEN style_scores IS NOT NULL THEN list_sum(list_transform(range(1, 8), lambda i: style_scores[i] * "
    f"{list(v.OCCASION_AFFINITY['date'])}[i])) / list_sum(style_scores) END"
)


@register(
    "generate_outfits",
    with_items(
        candidates_sql(ctx=DATE) + diverse_sql(5, COPY_GROUPS) + " SELECT wardrobe_id, choice, template, members AS item_ids, round(score, 6) AS score, "
        "round(rank, 6) AS rank, round(ctx, 6) AS context FROM chosen"
    ),
)
def _generate(spark, sf):
    out = _job(spark, sf, k=5, occasion="date").chosen
    return out.select(
        "wardrobe_id", "choice", "template", ids("members").alias("item_ids"), r6("score", "score"), r6("rank", "rank"), r6("context", "context")
    )


@register("explain_outfits")
def _explained(spark, sf):
    return _job(spark, sf, k=5, occasion="date").explained


@register(
    "diverse_topk",
    with_items(
        candidates_sql() + diverse_sql(8, COPY_GROUPS) + " SELECT wardrobe_id, choice, template, members, round(score, 6) AS score, round(rank, 6) AS rank FROM chosen"
    ),
)
def _diverse(spark, sf):
    job = _job(spark, sf, k=8)
    return job.chosen.select("wardrobe_id", "choice", "template", ids("members").alias("members"), r6("score", "score"), r6("rank", "rank"))


@register("outfit_json")
def _json(spark, sf):
    job = _job(spark, sf, k=3)
    return o.outfit_json(job.explained, job.judged)


def _message_sql(k: int) -> str:
    """The funnel of the whole job with its sentence, recomputed from candidates and the written-out selection."""
    counts = ", ".join(f"count(*) FILTER (category = '{x}') AS n_{x}" for x in v.SLOTS)
    owned = ", ".join(f"CASE WHEN n_{x} > 0 THEN n_{x} || ' {v.SLOT_NAMES[x].lower()}' END" for x in sorted(v.SLOTS))
    core = "(n_top * n_bottom * n_shoes + n_one_piece * n_shoes)"
    return (
        candidates_sql()
        + diverse_sql(k, COPY_GROUPS)
        + f", n AS (SELECT wardrobe_id, {counts} FROM pool GROUP BY 1), i AS (SELECT wardrobe_id, count(*) AS wardrobe_items, count(*) FILTER (reason IS NULL) AS eligible_items "
        "FROM items GROUP BY 1), sc AS (SELECT wardrobe_id, count(*) AS candidates_scored FROM cand GROUP BY 1), st AS (SELECT wardrobe_id, count(*) AS above_threshold FROM strong "
        "GROUP BY 1), sh AS (SELECT wardrobe_id, count(DISTINCT choice) AS returned, count(DISTINCT item_id) AS unique_items_in_results FROM (SELECT wardrobe_id, choice, "
        "unnest(str_split(members, ',')) AS item_id FROM chosen) GROUP BY 1), f AS (SELECT i.*, "
        f"coalesce({core} * (n_outerwear + 1) * (n_accessory + 1), 0)::BIGINT AS structural_combinations, coalesce({core}, 0)::BIGINT AS core_combinations, "
        "coalesce(candidates_scored, 0) AS candidates_scored, coalesce(above_threshold, 0) AS above_threshold, coalesce(returned, 0) AS returned, coalesce(unique_items_in_results, 0) "
        f"AS unique_items_in_results, n.* EXCLUDE (wardrobe_id), coalesce(nullif(concat_ws(', ', {owned}), ''), 'nothing usable') AS owned FROM i LEFT JOIN n USING (wardrobe_id) "
        "LEFT JOIN sc USING (wardrobe_id) LEFT JOIN st USING (wardrobe_id) LEFT JOIN sh USING (wardrobe_id)) SELECT wardrobe_id, wardrobe_items, eligible_items, "
        "structural_combinations, core_combinations, candidates_scored, above_threshold, returned, unique_items_in_results, core_combinations - candidates_scored AS "
        "rejected_by_validity, CASE WHEN eligible_items = 0 THEN 'No wardrobe item is currently usable for outfits (see the excluded items).' WHEN n_shoes = 0 THEN "
        "'Every outfit needs shoes, and there are no usable shoes in your wardrobe. Usable items: ' || owned || '.' WHEN NOT (n_top > 0 AND n_bottom > 0 OR n_one_piece > 0) THEN "
        "'Not enough items for an outfit: add at least one top and one bottom, or a dress/one-piece, plus shoes. Usable items: ' || owned || '.' WHEN candidates_scored = 0 THEN "
        "'Valid outfit structures exist, but every combination was rejected by the validity rules (the same garment twice or conflicting items).' WHEN returned = 0 THEN "
        f"candidates_scored || ' valid combinations were scored, but none reached the quality threshold ({CUT:.2f}). Add more items or review flagged ones.' WHEN returned < {k} THEN "
        f"returned || ' strong outfit(s) found from your current wardrobe (you asked for {k}).' || CASE WHEN above_threshold > returned THEN ' ' || (above_threshold - returned) || "
        "' other strong combination(s) were too similar to these to add variety.' ELSE '' END END AS message FROM f"
    )


@register("result_message", with_items(_message_sql(8)))
def _messages(spark, sf):
    return _job(spark, sf, k=8).messages


REQUIRED_TOP = (
    "want AS (SELECT wardrobe_id, max(seq) AS want FROM items WHERE reason IS NULL AND category = 'top' GROUP BY 1), "
    "pool AS (SELECT i.*, 'top' AS forced FROM items i JOIN want USING (wardrobe_id) WHERE reason IS NULL AND category <> 'one_piece' AND (category <> 'top' OR seq = want))"
)
BARE = (
    ", cand AS (SELECT *, NULL::VARCHAR AS outerwear, NULL::VARCHAR AS accessory, NULL::BIGINT AS outerwear_seq, NULL::BIGINT AS accessory_seq, total / weight AS score, "
    "total / weight AS rank, concat_ws(',', m1, m2, m3) AS members, list_filter([s1, s2, s3], lambda x: x IS NOT NULL) AS key FROM core)"
)
ASKED = (("formal", 3, candidates_sql(ctx=CTX)), ("around", 2, candidates_sql(REQUIRED_TOP, DATE)), ("bare", 4, core_sql() + BARE))


def _asked_sql(name: str, k: int, sql: str) -> str:
    shown = f" SELECT '{name}:' || wardrobe_id AS request_id, choice, template, members, round(score, 6) AS score, round(rank, 6) AS rank FROM chosen"
    return f"(SELECT * FROM ({with_items(sql + diverse_sql(k, COPY_GROUPS) + shown)}))"


def asked_for(spark, sf):
    """Three requests for every wardrobe: a style, one garment for an occasion, and no layers."""
    top = usable(spark, sf).filter(F.col("category") == "top").groupBy("wardrobe_id").agg(F.max_by("item_id", "seq").alias("top"))
    rows = b.items(spark, sf).select("wardrobe_id").distinct().join(top, "wardrobe_id", "left")
    none = F.lit(None).cast("string")

    def wish(name, k, style, occasion, required, layers):
        return F.struct(
            F.concat_ws(":", F.lit(name), "wardrobe_id").alias("request_id"), F.lit(k).alias("k"), style.alias("style"), occasion.alias("occasion"),
            required.alias("required_item"), F.lit(layers).alias("include_outerwear"), F.lit(layers).alias("include_accessory"),
        )

    wishes = F.array(
        wish("formal", 3, F.lit("formal"), none, none, True),
        wish("around", 2, none, F.lit("date"), F.coalesce("top", F.lit("none")), True),
        wish("bare", 4, none, none, none, False),
    )
    return rows.select("wardrobe_id", F.explode(wishes).alias("w")).select("wardrobe_id", "w.*")


@register("generate_for_requests", " UNION ALL ".join(_asked_sql(*a) for a in ASKED))
def _requests(spark, sf):
    job = generate_for_requests(b.items(spark, sf), asked_for(spark, sf), MODEL, DIM, BASE, threshold=CUT)
    return job.chosen.select("request_id", "choice", "template", ids("members").alias("members"), r6("score", "score"), r6("rank", "rank"))


COUNTED = (
    "SELECT '{name}:' || i.wardrobe_id AS request_id, coalesce(any_value(n), 0) AS candidates_scored, coalesce(any_value(s), 0) AS above_threshold, coalesce(any_value(r), 0) AS returned "
    "FROM items i LEFT JOIN (SELECT wardrobe_id, count(*) AS n, count(*) FILTER (score >= {cut}) AS s FROM cand GROUP BY 1) c USING (wardrobe_id) "
    "LEFT JOIN (SELECT wardrobe_id, count(*) AS r FROM chosen GROUP BY 1) h USING (wardrobe_id) GROUP BY i.wardrobe_id"
)


@register(
    "request_answers",
    " UNION ALL ".join(f"(SELECT * FROM ({with_items(sql + diverse_sql(k, COPY_GROUPS) + ' ' + COUNTED.format(name=name, cut=CUT))}))" for name, k, sql in ASKED),
)
def _answers(spark, sf):
    job = generate_for_requests(b.items(spark, sf), asked_for(spark, sf), MODEL, DIM, BASE, threshold=CUT)
    return job.answers.select("request_id", "candidates_scored", "above_threshold", "returned")
