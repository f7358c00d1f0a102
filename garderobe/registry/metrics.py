"""Metric queries. ``scored`` rows come from order lines; pair metrics from the pair dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import scores as s
from garderobe.functions.lookup import hash_unit
from garderobe.functions.vectors import dot
from garderobe.operators import dataset as d
from garderobe.operators import metrics as m
from garderobe.operators import pairs as pr
from garderobe.operators import resampling as rs
from garderobe.plans import bindings as b
from garderobe.plans import fit
from garderobe.registry.base import register
from garderobe.registry.common import VECTORS, with_items
from garderobe.registry.dataset import BASE_CTE, TYPED, hx, sampler
from garderobe.registry.pairs import BASE, pairs_sql, usable
from garderobe.registry.wardrobe import r6
from garderobe.session import cut_lineage

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def scored(spark, sf):
    price = F.col("l_extendedprice")
    label = (F.col("l_quantity") > 25).cast("int")
    return b.table(spark, sf, "lineitem").select(
        *KEY,
        label.alias("label"),
        F.round(price / (price + 30000.0), 4).alias("score"),
        F.round(F.col("l_discount") * 10, 1).alias("other"),
        F.col("l_returnflag").alias("grp"),
        F.when(label == 1, "observed_positive")
        .when(F.col("l_linestatus") == "O", "hard_negative")
        .otherwise("random_negative")
        .alias("kind"),
    )


SCORED = (
    "scored AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity > 25)::INT AS label, "
    "round(l_extendedprice / (l_extendedprice + 30000.0::DOUBLE), 4) AS score, round(l_discount * 10, 1) AS other, l_returnflag AS grp, "
    "CASE WHEN l_quantity > 25 THEN 'observed_positive' WHEN l_linestatus = 'O' THEN 'hard_negative' ELSE 'random_negative' END AS kind "
    "FROM lineitem)"
)


def curve_sql(source: str, keys: str = "", weight: str = "1") -> str:
    """CTE ``curve``: running counts per key and distinct score of ``source``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return (
        f"g AS (SELECT {k}score, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos, "
        f"sum(CASE WHEN label = 1 THEN 0 ELSE {weight} END)::DOUBLE AS neg FROM {source} GROUP BY {k}score), "
        f"curve AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp, "
        f"sum(pos) OVER ({part}) AS positives, sum(neg) OVER ({part}) AS negatives FROM g)"
    )


AUC = "sum(neg * (tp - pos + pos / 2)) / nullif(max(positives) * max(negatives), 0)"
AP = "sum(pos / nullif(positives, 0) * tp / (tp + fp))"
F1 = "2 * (tp / (tp + fp)) * (tp / positives) / greatest(tp / (tp + fp) + tp / positives, 1e-12)"


@register(
    "running_counts",
    f"WITH {SCORED}, {curve_sql('scored', 'grp')} SELECT grp, score, pos, neg, tp, fp, positives, negatives FROM curve",
)
def _running(spark, sf):
    return m.running_counts(scored(spark, sf), ["grp"])


@register(
    "roc_auc",
    f"WITH {SCORED}, {curve_sql('scored')} SELECT max(positives)::BIGINT AS positives, max(negatives)::BIGINT AS negatives, "
    f"round({AUC}, 6) AS roc_auc FROM curve",
)
def _auc(spark, sf):
    return m.roc_auc(scored(spark, sf)).withColumn("roc_auc", F.round("roc_auc", 6))


@register(
    "average_precision", f"WITH {SCORED}, {curve_sql('scored', 'grp')} SELECT grp, round({AP}, 6) AS pr_auc FROM curve GROUP BY grp"
)
def _ap(spark, sf):
    out = m.ranking_metrics(m.running_counts(scored(spark, sf), ["grp"]), ["grp"])
    return out.select("grp", r6("pr_auc", "pr_auc"))


@register(
    "best_f1_threshold",
    f"WITH {SCORED}, {curve_sql('scored', 'grp')}, f AS (SELECT grp, score, round({F1}, 12) AS f1 FROM curve) SELECT grp, "
    "round(arg_max(score, (f1, -score)), 6) AS best_f1_threshold, round(max(f1), 6) AS best_f1 FROM f GROUP BY grp",
)
def _best_f1(spark, sf):
    out = m.ranking_metrics(m.running_counts(scored(spark, sf), ["grp"]), ["grp"])
    return out.select("grp", r6("best_f1_threshold", "best_f1_threshold"), r6("best_f1", "best_f1"))


@register(
    "threshold_sweep",
    f"WITH {SCORED}, {curve_sql('scored')}, f AS (SELECT score, tp / positives AS tpr, fp / negatives AS fpr FROM curve) SELECT "
    "round(arg_max(score, (round(tpr - fpr, 12), -score)), 6) AS cut, round(arg_max(tpr, (round(tpr - fpr, 12), -score)), 6) AS cut_tpr, "
    "round(arg_max(fpr, (round(tpr - fpr, 12), -score)), 6) AS cut_fpr FROM f",
)
def _sweep(spark, sf):
    out = m.ranking_metrics(m.running_counts(scored(spark, sf)))
    return out.select(*[r6(c, c) for c in ("cut", "cut_tpr", "cut_fpr")])


@register(
    "classification_metrics",
    f"WITH {SCORED}, c AS (SELECT grp, count(*) AS n, sum(label)::BIGINT AS positives, avg(label) AS rate, count(*) FILTER (score >= 0.5 AND "
    "label = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, "
    "avg((score - label) * (score - label)) AS brier FROM scored GROUP BY grp) SELECT grp, n, positives, round(rate, 6) AS positive_rate, "
    "round((tp + (n - positives - fp)) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, "
    "round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, "
    "round(brier, 6) AS brier FROM c",
)
def _classify(spark, sf):
    out = m.classification_metrics(scored(spark, sf), ["grp"])
    return out.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes])


EDGES = " + ".join(f"(score >= {i * 0.1!r})::INT" for i in range(1, 10))


@register(
    "calibration_error",
    f"WITH {SCORED}, e AS (SELECT grp, {EDGES} AS bin, count(*) AS n, avg(label) AS hit, avg(score) AS mean FROM scored GROUP BY ALL) "
    "SELECT grp, round(sum(n * abs(hit - mean)) / sum(n), 6) AS ece FROM e GROUP BY grp",
)
def _ece(spark, sf):
    return m.calibration_error(scored(spark, sf), ["grp"]).withColumn("ece", F.round("ece", 6))


@register(
    "auc_by_group",
    f"WITH {SCORED}, {curve_sql('scored', 'grp')} SELECT grp, max(positives)::BIGINT AS positives, max(negatives)::BIGINT AS negatives, "
    f"round({AUC}, 6) AS roc_auc FROM curve GROUP BY grp HAVING max(positives) >= 30 AND max(negatives) >= 30",
)
def _by_group(spark, sf):
    return m.auc_by_group(scored(spark, sf), "grp").withColumn("roc_auc", F.round("roc_auc", 6))


KINDS = ("hard_negative", "random_negative")


@register(
    "auc_vs_kind",
    f"WITH {SCORED}, part AS (SELECT s.*, k.against FROM scored s JOIN (VALUES {', '.join(f"('{k}')" for k in KINDS)}) k(against) "
    f"ON s.label = 1 OR s.kind = k.against), {curve_sql('part', 'against')} SELECT against, max(positives)::BIGINT AS positives, "
    f"max(negatives)::BIGINT AS negatives, round({AUC}, 6) AS roc_auc FROM curve GROUP BY 1",
)
def _vs_kind(spark, sf):
    rows = scored(spark, sf)
    each = [m.auc_vs_kind(rows, k).withColumn("against", F.lit(k)) for k in KINDS]
    return each[0].unionByName(each[1]).withColumn("roc_auc", F.round("roc_auc", 6))


def _cuts_sql(u: str) -> str:
    return " + ".join(f"({u} >= {c!r}::DOUBLE)::INT" for c in m.poisson_cuts())


ROW = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"


def boot_sql(b_: int, seed: int = 0) -> str:
    return (
        f"{SCORED}, long AS (SELECT *, 'score' AS scorer FROM (SELECT * EXCLUDE (other) FROM scored) UNION ALL SELECT * EXCLUDE (score, other, "
        "grp, kind), other AS score, grp, kind, 'other' FROM scored), "
        f"hashed AS (SELECT scorer, grp, label, score, {hx(f'{chr(39)}{seed}:{chr(39)} || {ROW}')} % {m.PRIME} AS h FROM long), "
        f"reps AS (SELECT scorer, grp, label, score, replicate, ((h * (1 + (replicate * 1103515245 + 12345) % {m.PRIME - 1}) + (replicate * 69069 + 362437) % {m.PRIME}) "
        f"% {m.PRIME}) / {float(m.PRIME)!r}::DOUBLE AS u FROM (SELECT *, unnest(range(1, {b_ + 1})) AS replicate FROM hashed)), "
        f"weighted AS (SELECT *, {_cuts_sql('u')} AS w FROM reps WHERE u >= {m.poisson_cuts()[0]!r}::DOUBLE), "
        + curve_sql("(SELECT * FROM weighted WHERE w > 0)", "scorer, replicate", "w")
        + f", vals AS (SELECT scorer, replicate, {AUC} AS roc_auc, {AP} AS pr_auc FROM curve GROUP BY ALL)"
    ).replace(
        "SELECT * EXCLUDE (score, other, grp, kind), other AS score, grp, kind, 'other' FROM scored",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, other AS score, grp, kind, 'other' FROM scored",
    )


@register(
    "bootstrap_ci",
    f"WITH {boot_sql(500)} SELECT scorer, count(*) AS replicates, "
    + ", ".join(
        f"round(quantile_cont({c}, {q}), 6) AS {c}_{t}" for c in ("roc_auc", "pr_auc") for t, q in (("low", 0.025), ("high", 0.975))
    )
    + " FROM vals GROUP BY scorer",
)
def _boot(spark, sf):
    out = m.bootstrap_ci(scored(spark, sf), KEY, ["score", "other"])
    return out.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes])


@register(
    "paired_bootstrap_auc_diff",
    f"WITH {boot_sql(500)}, df AS (SELECT replicate, sum(CASE scorer WHEN 'score' THEN roc_auc ELSE -roc_auc END) AS d FROM vals GROUP BY 1), "
    + curve_sql("long", "scorer").replace("g AS", "g2 AS").replace("FROM g)", "FROM g2)").replace("curve AS", "curve2 AS")
    + f", pt AS (SELECT scorer, {AUC} AS a FROM curve2 GROUP BY scorer) SELECT round(sum(CASE scorer WHEN 'score' THEN a ELSE -a END), 6) AS "
    "difference, (SELECT round(quantile_cont(d, 0.025), 6) FROM df) AS ci95_low, (SELECT round(quantile_cont(d, 0.975), 6) FROM df) AS ci95_high, "
    "(SELECT quantile_cont(d, 0.025) > 0 FROM df) AS beats FROM pt",
)
def _paired(spark, sf):
    out = m.paired_bootstrap_auc_diff(scored(spark, sf), KEY, "score", "other")
    return out.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes])


@register(
    "bootstrap_brier_f1",
    f"WITH {boot_sql(500).split(', weighted AS')[0]}, weighted AS (SELECT grp, label, score, replicate, {_cuts_sql('u')} AS w FROM reps WHERE scorer = 'score'), "
    "vals AS (SELECT grp, replicate, sum(w * (score - label) * (score - label)) / sum(w) AS brier, "
    "coalesce(2 * sum(w * (score >= 0.5 AND label = 1)::INT)::DOUBLE / nullif(sum(w * ((score >= 0.5)::INT + label)), 0), 0) AS f1 "
    "FROM weighted GROUP BY ALL HAVING sum(w) > 0) SELECT grp, count(*) AS replicates, "
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{t}" for c in ("brier", "f1") for t, q in (("low", 0.025), ("high", 0.975)))
    + " FROM vals GROUP BY grp",
)
def _boot_sums(spark, sf):
    out = rs.bootstrap_intervals(scored(spark, sf), KEY, {"brier": rs.brier(), "f1": rs.f1()}, ["grp"])
    return out.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes])


# ------------------------------------------------------------------ pairs with vectors
def embedded_pairs(spark, sf):
    """Typed test pairs with cosine, slots, and a hash score standing for a random scorer."""
    pairs = sampler(spark, sf).typed_pairs()
    both = d.pair_embeddings(pairs, b.item_vectors(spark, sf), b.ENCODER_DIM).withColumn("cosine", dot("va", "vb")).drop("va", "vb")
    cats = b.item_categories(spark, sf)
    for c, slot in (("item_a", "slot_a"), ("item_b", "slot_b")):
        both = both.join(cats.select(F.col("item_id").alias(c), F.col("category").alias(slot)), c, "left")
    return both.withColumn(
        "heuristic", s.heuristic_score(F.col("cosine"), F.col("slot_a"), F.col("slot_b"))
    ).withColumn("random", hash_unit(F.concat_ws(":", F.lit("42"), "item_a", "item_b")))


_PAIR = {"+".join(sorted(k)): x for k, x in v.SLOT_PAIR_SCORE.items()}


def _slot_score(a: str, c: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {x}" for k, x in _PAIR.items())
    return f"(CASE WHEN {a} = {c} THEN 0.0 ELSE CASE concat_ws('+', least({a}, {c}), greatest({a}, {c})) {arms} ELSE 0.5 END END)::DOUBLE"


EMBEDDED = TYPED + (
    f", {VECTORS}, emb AS (SELECT t.*, list_dot_product(x.vector, y.vector) AS cosine, ca.category AS slot_a, cb.category AS slot_b, "
    f"{hx(chr(39) + '42:' + chr(39) + ' || item_a || chr(58) || item_b')} / 4294967295.0::DOUBLE AS random FROM typed t JOIN item_vecs x ON "
    "x.item_id = item_a JOIN item_vecs y ON y.item_id = item_b LEFT JOIN item_cats ca ON ca.item_id = item_a LEFT JOIN item_cats cb ON "
    f"cb.item_id = item_b), h AS (SELECT *, (0.35 * greatest(0, least(1, (cosine - 0.45) / 0.45)) + 0.15 * {_slot_score('slot_a', 'slot_b')}) "
    "/ 0.5::DOUBLE AS heuristic FROM emb)"
)


@register(
    "heuristic_score",
    EMBEDDED + " SELECT split, kind, count(*) AS n, round(avg(cosine), 6) AS cosine, round(avg(heuristic), 6) AS heuristic FROM h GROUP BY ALL",
)
def _heuristic(spark, sf):
    return (
        embedded_pairs(spark, sf)
        .groupBy("split", "kind")
        .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cosine"), "cosine"), r6(F.avg("heuristic"), "heuristic"))
    )


@register(
    "baseline_comparison",
    EMBEDDED
    + ", long AS (SELECT 'random' AS scorer, label, random AS score FROM h UNION ALL SELECT 'cosine', label, round(cosine, 9) FROM h UNION ALL "
    f"SELECT 'heuristic', label, round(heuristic, 9) FROM h), {curve_sql('long', 'scorer')}, t AS (SELECT scorer, max(positives)::BIGINT AS "
    f"positives, max(negatives)::BIGINT AS negatives, {AUC} AS roc_auc, {AP} AS pr_auc FROM curve GROUP BY scorer) SELECT scorer, positives, "
    "negatives, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, scorer = (SELECT arg_max(scorer, roc_auc) FROM t WHERE scorer <> "
    "'random') AS strongest FROM t",
)
def _baselines(spark, sf):
    pairs = embedded_pairs(spark, sf).withColumn("cosine", F.round("cosine", 9)).withColumn("heuristic", F.round("heuristic", 9))
    out = m.baseline_comparison(cut_lineage(pairs), ["random", "cosine", "heuristic"])
    return out.withColumn("roc_auc", F.round("roc_auc", 6)).withColumn("pr_auc", F.round("pr_auc", 6))


@register(
    "evaluate_pairs",
    EMBEDDED
    + ", e AS (SELECT split, label, round((cosine + 1) / 2, 9) AS score FROM h), c AS (SELECT split, count(*) AS n, sum(label)::BIGINT AS positives, "
    "count(*) FILTER (score >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 "
    f"AND label = 1) AS fn, avg((score - label) * (score - label)) AS brier FROM e GROUP BY split), {curve_sql('e', 'split')}, "
    f"a AS (SELECT split, {AUC} AS roc_auc FROM curve GROUP BY split), miss AS (SELECT split, count(*) AS total FROM typed GROUP BY 1) "
    "SELECT split, n, positives, round(roc_auc, 6) AS roc_auc, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, "
    "round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(brier, 6) AS brier, total - n AS missing_embeddings "
    "FROM c JOIN a USING (split) JOIN miss USING (split)",
)
def _evaluate(spark, sf):
    pairs = sampler(spark, sf).typed_pairs()
    both = d.pair_embeddings(pairs, b.item_vectors(spark, sf), b.ENCODER_DIM).withColumn("cosine", dot("va", "vb"))
    rows = cut_lineage(both.select("split", "label", F.round(s.shifted_cosine(F.col("cosine")), 9).alias("score")))
    missing = d.missing_embedding_rate(pairs, b.item_vectors(spark, sf), b.ENCODER_DIM).select(
        "split", F.col("missing").alias("missing_embeddings")
    )
    out = m.classification_metrics(rows, ["split"]).join(m.roc_auc(rows, ["split"]).select("split", "roc_auc"), "split").join(missing, "split")
    return out.select(
        "split", "n", "positives", *[r6(c, c) for c in ("roc_auc", "precision", "recall", "brier")], "missing_embeddings"
    )


def fitb_scored(spark, sf):
    members = d.usable_outfits(b.outfit_items(spark, sf))
    vectors = b.item_vectors(spark, sf).select("item_id", "vector")
    asked = m.fitb_questions(members, vectors)
    rest = members.select("split", "set_id", F.col("item_id").alias("rest_id"))
    rows = asked.join(rest, ["split", "set_id"]).filter(F.col("rest_id") != F.col("answer"))
    rows = rows.join(vectors.withColumnRenamed("vector", "vc"), "item_id").join(
        vectors.select(F.col("item_id").alias("rest_id"), F.col("vector").alias("vr")), "rest_id"
    )
    return rows.withColumn("score", dot("vc", "vr"))


@register(
    "fitb_accuracy",
    "WITH "
    + BASE_CTE
    + f", {VECTORS}, own AS (SELECT * FROM members WHERE item_id IN (SELECT item_id FROM item_vecs)), bl AS (SELECT split, set_id, count(*) AS "
    "n_usable, arg_min(item_id, sha1('42:blank:' || set_id || ':' || item_id)) AS answer FROM own GROUP BY 1, 2), "
    f"pool AS (SELECT split, item_id, row_number() OVER (PARTITION BY split ORDER BY {hx('item_id')} % 64, item_id) AS i, count(*) OVER "
    "(PARTITION BY split) AS n_pool FROM (SELECT DISTINCT split, item_id FROM own)), np AS (SELECT DISTINCT split, n_pool FROM pool), "
    "q AS (SELECT bl.*, n_pool FROM bl JOIN np USING (split) WHERE n_usable >= 2 AND n_pool > 3 + n_usable), "
    "pc AS (SELECT n_pool, unnest(range(n_pool, 2 * n_pool)) AS c FROM (SELECT DISTINCT n_pool FROM np)), dv AS (SELECT unnest(range(2, (SELECT 2 + sqrt(max(c))::BIGINT FROM pc))) AS d), "
    "pm AS (SELECT n_pool, min(c) AS prime FROM pc WHERE NOT EXISTS (SELECT 1 FROM dv WHERE d * d <= c AND c % d = 0) GROUP BY n_pool), "
    f"dr AS (SELECT * FROM (SELECT *, (start + try * step) % prime + 1 AS i FROM (SELECT q.*, prime, {hx(chr(39) + '42:distractor:' + chr(39) + ' || set_id', 15)} % prime AS start, "
    f"1 + {hx(chr(39) + '42:step:' + chr(39) + ' || set_id', 15)} % (prime - 1) AS step, unnest(range(0, n_usable + 3 + prime - n_pool)) AS try FROM q JOIN pm USING (n_pool))) "
    "WHERE i <= n_pool QUALIFY row_number() OVER (PARTITION BY split, set_id ORDER BY try) <= n_usable + 3), dx AS (SELECT dr.split, set_id, item_id, min(try) AS try FROM dr JOIN pool ON pool.split = dr.split AND "
    "pool.i = dr.i WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.split = dr.split AND m.set_id = dr.set_id AND m.item_id = pool.item_id) GROUP BY "
    "ALL), pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, set_id ORDER BY try) AS candidate FROM dx) WHERE candidate <= 3), "
    "cand AS (SELECT split, set_id, answer AS item_id, 0 AS candidate FROM q UNION ALL SELECT split, set_id, item_id, candidate FROM pk), "
    "sc AS (SELECT c.split, c.set_id, candidate, avg(list_dot_product(x.vector, y.vector)) AS mean FROM cand c JOIN q ON q.split = c.split AND "
    "q.set_id = c.set_id JOIN own r ON r.split = c.split AND r.set_id = c.set_id AND r.item_id <> q.answer JOIN item_vecs x ON x.item_id = c.item_id "
    "JOIN item_vecs y ON y.item_id = r.item_id GROUP BY ALL), b AS (SELECT split, set_id, arg_max(candidate, (round(mean, 12), -candidate)) AS c FROM "
    "sc GROUP BY 1, 2) SELECT split, round(avg((c = 0)::INT), 6) AS fitb_accuracy, count(*) AS questions, 0.25::DOUBLE AS chance FROM b GROUP BY 1",
)
def _fitb(spark, sf):
    return m.fitb_accuracy(fitb_scored(spark, sf)).withColumn("fitb_accuracy", F.round("fitb_accuracy", 6))


def real_and_fake(spark, sf):
    """Wardrobe outfits (items by p_size % 7; even ones validate, odd ones test) and their fakes, with plausibility."""
    items, part = usable(spark, sf), F.col("p_size") % 7
    split = F.when(part % 2 == 0, "valid").otherwise("test")
    worn = items.select(split.alias("split"), F.concat_ws("_", "wardrobe_id", part).alias("set_id"), F.col("seq").alias("ord"), "item_id")
    return cut_lineage(fit.real_and_fake(worn, items, BASE).withColumn("score", F.round("score", 9)))


_SPLIT = "CASE WHEN split_part({x}, '_', 2)::INT % 2 = 0 THEN 'valid' ELSE 'test' END"
RF = (
    f", real AS (SELECT *, wardrobe_id || '_' || (p_size % 7) AS outfit_id FROM items WHERE reason IS NULL), pool AS (SELECT category, item_id, "
    f"row_number() OVER (PARTITION BY category ORDER BY {hx('item_id')} % 64, item_id) - 1 AS idx, count(*) OVER (PARTITION BY category) AS n FROM real), "
    "n AS (SELECT DISTINCT category, n FROM pool), dr AS (SELECT real.outfit_id, real.seq AS seat, real.category, "
    + hx(f"'42:fake:' || {_SPLIT.format(x='outfit_id')} || ':' || outfit_id || ':' || item_id", 15)
    + " % n AS idx FROM real JOIN n USING (category)), "
    "fk AS (SELECT d.outfit_id, d.seat, p.item_id FROM dr d JOIN pool p USING (category, idx)), fake AS (SELECT r.* EXCLUDE (outfit_id, seq), "
    "fk.outfit_id, fk.seat AS seq FROM fk JOIN real r ON r.item_id = fk.item_id)"
)
_W = "CASE WHEN ca = 'accessory' OR cb = 'accessory' THEN 0.5::DOUBLE ELSE 1.0 END"


def _renamed(name: str, source: str) -> str:
    text = pairs_sql(source, "outfit_id")
    for part in ("pair_raw", "pair_rel", "pairs"):
        text = text.replace(f" {part} ", f" {part}_{name} ").replace(f" {part})", f" {part}_{name})").replace(f"FROM {part}\n", f"FROM {part}_{name}\n")
    return text


@register(
    "real_vs_fake_report",
    with_items(
        RF
        + f", {_renamed('r', 'real')}, {_renamed('f', 'fake')}, sc AS (SELECT outfit_id, 1 AS label, round(sum({_W} * p) / sum({_W}), 9) AS score FROM "
        f"pairs_r GROUP BY 1 UNION ALL SELECT outfit_id, 0, round(sum({_W} * p) / sum({_W}), 9) FROM pairs_f GROUP BY 1), "
        f"rf AS (SELECT *, {_SPLIT.format(x='outfit_id')} AS split FROM sc), {curve_sql('rf', 'split')}, "
        "best AS (SELECT arg_max(score, (round(tp / positives - fp / negatives, 12), -score)) AS cut FROM curve WHERE split = 'valid'), "
        f"auc AS (SELECT split, max(positives)::BIGINT AS real_outfits, max(negatives)::BIGINT AS fake_outfits, round({AUC}, 6) AS roc_auc FROM curve GROUP BY 1), "
        "rate AS (SELECT split, round(avg((score >= cut)::INT) FILTER (label = 1), 6) AS tpr, round(avg((score >= cut)::INT) FILTER (label = 0), 6) AS fpr "
        "FROM rf, best GROUP BY 1) SELECT auc.*, round(cut, 6) AS cut, tpr, fpr FROM auc JOIN rate USING (split), best"
    ),
)
def _real_fake(spark, sf):
    both = real_and_fake(spark, sf)
    ranked = cut_lineage(m.ranking_metrics(m.running_counts(both, ["split"]), ["split"]))
    report = fit.split_report(both, ranked, fit.validation_cut(ranked))
    return report.select("split", "real_outfits", "fake_outfits", *[r6(c, c) for c in ("roc_auc", "cut", "tpr", "fpr")])
