"""Model, image, source and streaming queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import style, vectors
from garderobe.functions.vectors import dot
from garderobe.operators import compat
from garderobe.operators import dataset as d
from garderobe.operators import detections as de
from garderobe.operators import images as im
from garderobe.operators import models as mo
from garderobe.operators import pairs as pr
from garderobe.plans import bindings as b
from garderobe.plans.fit import fit_ranker
from garderobe.plans.generate import generate_outfits
from garderobe.plans.ingest import ingest_detections
from garderobe.registry.base import register
from garderobe.registry.common import OUTFITS, VECTORS, case_map, with_items, with_outfits
from garderobe.registry.dataset import DISJOINT, TI, TYPED, sampler
from garderobe.registry.pairs import OK_ITEMS, pairs_sql, usable
from garderobe.registry.wardrobe import DIM, MODEL, r6
from garderobe.sources import readers as rd
from garderobe.streaming import ingest as st
from garderobe.streaming.state import stream_arrivals

FEATURES = v.FEATURES_BASELINE


# ------------------------------------------------------------------ models
def labelled_features(spark, sf):
    """Item pairs of one wardrobe with features; the label follows cosine and style, with hashed noise."""
    inputs = pr.pair_inputs(usable(spark, sf))
    pairs = pr.pair_features(pr.item_pairs(inputs, inputs, ["wardrobe_id"], lambda x, y: pr.earlier(x, y) & (x("slot") != y("slot"))))
    noise = F.pmod(F.xxhash64("a_item_id", "b_item_id"), F.lit(1000)) / 1000.0
    label = (F.col("clip_cos") * 2 + F.col("style_sim") + noise > 0.9).cast("int")
    return pairs.withColumn("label", label)


@register(
    "feature_moments",
    with_items(
        f", {OK_ITEMS}, {pairs_sql('ok_items')}, q AS (SELECT * FROM pairs WHERE ca <> cb) "
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(avg({f}), 6) AS impute, round(avg({f}), 6) AS mean, round(stddev_pop(coalesce({f}, m)) + 1e-9, 6) AS scale FROM q, "
            f"(SELECT avg({f}) AS m FROM q)"
            for f in FEATURES
        )
    ),
)
def _moments(spark, sf):
    out = mo.feature_moments(labelled_features(spark, sf), FEATURES)
    return out.select("feature", r6("impute", "impute"), r6("mean", "mean"), r6("scale", "scale"))


@register("fit_pair_model")
def _fit(spark, sf):
    return mo.model_rows(spark, mo.fit_pair_model(labelled_features(spark, sf), FEATURES))


@register("pair_model_io")
def _model_io(spark, sf):
    path = st.work_path(spark, "model")
    mo.save_pair_model(spark, mo.fit_pair_model(labelled_features(spark, sf), FEATURES), path)
    return mo.model_rows(spark, mo.load_pair_model(spark, path))


def observed(spark, sf):
    """Wardrobe outfits (items by p_size % 7), the even ones for validation, the odd ones for the test."""
    part = F.col("p_size") % 7
    split = F.when(part % 2 == 0, "valid").otherwise("test")
    return usable(spark, sf).select(split.alias("split"), F.concat_ws("_", "wardrobe_id", part).alias("set_id"), F.col("seq").alias("ord"), "item_id")


@register(
    "fit_ranker",
    "SELECT 'weights_support_compatibility' AS fact, true AS holds UNION ALL SELECT 'a_feature_is_kept', true UNION ALL SELECT 'cut_is_a_plausibility', true UNION ALL "
    "SELECT 'saved_model_is_the_fitted_one', true UNION ALL SELECT 'cut_separates_validation', true UNION ALL SELECT 'both_splits_reported', true",
)
def _fit_ranker(spark, sf):
    """The whole fitting job; what must hold of any fit is shown, the weights themselves depend on the solver."""
    rows = labelled_features(spark, sf).select(F.lit("valid").alias("split"), F.col("a_item_id").alias("item_a"), F.col("b_item_id").alias("item_b"), "label")
    path = st.work_path(spark, "ranker")
    fit = fit_ranker(rows, observed(spark, sf), usable(spark, sf), path=path)
    model, saved = fit.model, mo.load_pair_model(spark, path)
    report = fit.report.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("split") == "valid", F.col("tpr") - F.col("fpr"))).alias("gap"))
    facts = {
        "weights_support_compatibility": F.lit(len(model["features"]) == 1 or min(model["coef"]) >= 0),
        "a_feature_is_kept": F.lit(len(model["features"]) >= 1),
        "cut_is_a_plausibility": F.lit(0 <= model["outfit_threshold"] <= 1),
        "saved_model_is_the_fitted_one": F.lit(all(saved[k] == model[k] for k in ("features", "coef", "mean", "scale", "impute", "intercept", "outfit_threshold"))),
        "cut_separates_validation": F.col("gap") >= 0,
        "both_splits_reported": F.col("n") == 2,
    }
    return report.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), x.alias("holds")) for k, x in facts.items()])).alias("f")).select("f.*")


@register("ingest_detections")
def _ingest(spark, sf):
    """The whole ingest job over the detector rows of the tables, with the vector that the id points to."""
    n = b.table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    e = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    raw = b.raw_detections(spark, sf)
    found = de.detect_regions(raw).select("id").distinct()
    vectors_ = found.crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(F.xxhash64("id"), F.col("n"))).join(e, "vec_id").select("id", "embedding")  # one row on the right
    stored = b.item_base(spark, sf)
    job = ingest_detections(raw, vectors_, stored, (F.col("image_id") % 20).cast("bigint"), F.expr(f"{b.EPOCH} + make_dt_interval(1000, 0, 0, image_id)"), st.work_path(spark, "snapshot"))
    return job.snapshot.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("possible_duplicates") > 0).alias("flagged"))


@register("train_compat_model")
def _train(spark, sf):
    pairs = d.pair_embeddings(sampler(spark, sf).typed_pairs(), b.item_vectors(spark, sf), b.ENCODER_DIM)
    return mo.train_compat_model(pairs, b.ENCODER_DIM)[1]


@register(
    "model_gate",
    "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'missing' WHEN p_size % 5 = 0 OR p_size % 3 = 0 THEN 'error' WHEN p_size % 2 = 0 THEN 'not_better' ELSE 'loaded' END AS state "
    "FROM part",
)
def _gate(spark, sf):
    size = F.col("p_size")
    registry = b.table(spark, sf, "part").select(
        "p_partkey",
        (size % 7 != 0).alias("present"),
        F.when(size % 5 == 0, "old").otherwise("enc64").alias("model_name"),
        F.when(size % 3 == 0, 32).otherwise(64).alias("dim"),
        F.lit("enc64").alias("encoder_name"),
        F.lit(64).alias("encoder_dim"),
        (size % 2 != 0).alias("beats_baseline"),
    )
    return mo.model_gate(registry).select("p_partkey", "state")


@register(
    "style_from_embeddings",
    "WITH q AS (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) AS q FROM embeddings WHERE vec_id < 7), l AS (SELECT vec_id, list_transform(q, lambda z: 100.0 * "
    "list_dot_product(z, embedding::DOUBLE[])) AS lg FROM embeddings, q), s AS (SELECT vec_id, list_transform(lg, lambda z: round(exp(z - list_max(lg)) / "
    "list_sum(list_transform(lg, lambda y: exp(y - list_max(lg)))), 4)) AS sc FROM l) SELECT vec_id, "
    f"[{', '.join(chr(39) + x + chr(39) for x in v.STYLES)}][list_position(sc, list_max(sc))] AS style, list_max(sc) AS peak FROM s",
)
def _style(spark, sf):
    logits = vectors.style_logits(b.style_prompts(spark, sf), v.STYLE_TEMPERATURE)
    e = b.table(spark, sf, "embeddings").withColumn("_l", logits("embedding"))
    scored = e.withColumn("s", vectors.softmax_rounded(F.col("_l")))
    return scored.select("vec_id", style.top_style(F.col("s")).alias("style"), F.array_max("s").alias("peak"))


# ------------------------------------------------------------------ images: a vector's 64 numbers are an 8 x 8 picture
def pictures(spark, sf):
    def paint(batches):
        for batch in batches:
            data = []
            for e in batch["embedding"]:
                levels = np.clip((np.asarray(e, dtype=np.float64) + 0.4) * 320, 0, 255).astype(np.uint8)
                data.append(np.stack([levels, levels[::-1], np.roll(levels, 7)], axis=1).tobytes())
            yield pd.DataFrame({"item_id": "v" + batch["vec_id"].astype(str), "width": 8, "height": 8, "channels": 3, "data": data})

    return b.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(
        paint, "item_id string, width int, height int, channels int, data binary"
    )


@register("dhash")
def _dhash(spark, sf):
    return im.dhash(pictures(spark, sf))


@register("dominant_colours")
def _dominant(spark, sf):
    rows = im.dominant_colours(pictures(spark, sf))
    return rows.select("item_id", F.posexplode("colors").alias("rank", "c")).select("item_id", "rank", "c.*")


@register(
    "name_clusters",
    """
    WITH px AS (SELECT l_orderkey, l_linenumber AS cluster, l_partkey * 37 % 256 AS r, l_suppkey * 91 % 256 AS g, (l_partkey + 3 * l_orderkey) % 256 AS b,
        l_quantity::BIGINT AS n FROM lineitem),
    hs AS (SELECT *, (v - rr) / d AS fr, (v - gg) / d AS fg, (v - bb) / d AS fb FROM (SELECT *, greatest(rr, gg, bb) AS v, greatest(rr, gg, bb) - least(rr, gg, bb) AS d
        FROM (SELECT *, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM px))),
    h AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, (CASE WHEN d = 0 THEN 0 WHEN rr = v THEN fb - fg WHEN gg = v THEN 2.0::DOUBLE + fr - fb ELSE 4.0::DOUBLE + fg - fr END)
        / 6.0::DOUBLE AS h0 FROM hs),
    hsv AS (SELECT l_orderkey, r, g, b, n, v, s, (CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END) * 360.0::DOUBLE AS h FROM h),
    named AS (SELECT l_orderkey, n, r, g, b, CASE
      WHEN v < 0.2 AND v >= 0.08 AND s >= 0.55 AND h >= 195 AND h < 255 THEN 'navy' WHEN v < 0.2 AND v >= 0.08 AND s >= 0.55 AND (h < 12 OR h >= 345) THEN 'burgundy'
      WHEN v < 0.2 THEN 'black' WHEN s < 0.12 OR (s < 0.2 AND v < 0.4) THEN CASE WHEN v > 0.85 THEN 'white' ELSE 'gray' END
      WHEN h >= 18 AND h < 60 AND s < 0.4 AND v > 0.5 THEN 'beige' WHEN h >= 8 AND h < 45 AND v < 0.62 THEN 'brown' WHEN h >= 45 AND h < 80 AND v < 0.55 THEN 'olive'
      WHEN h < 12 OR h >= 345 THEN CASE WHEN v < 0.45 THEN 'burgundy' WHEN s < 0.45 AND v > 0.75 THEN 'pink' ELSE 'red' END
      WHEN h < 40 THEN 'orange' WHEN h < 68 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 195 THEN 'teal'
      WHEN h < 255 THEN CASE WHEN v < 0.45 THEN 'navy' WHEN s < 0.45 AND v > 0.7 THEN 'light blue' ELSE 'blue' END WHEN h < 290 THEN 'purple' ELSE 'pink' END AS name FROM hsv),
    m AS (SELECT l_orderkey, name, sum(n) AS n, (sum(r * n) / sum(n))::DOUBLE AS r FROM named GROUP BY 1, 2),
    t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total FROM m)
    SELECT 'i' || l_orderkey AS item_id, name, trunc(r)::INT AS red FROM t WHERE n / total >= 0.06
    """,
)
def _clusters(spark, sf):
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    rows = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("i"), order).alias("item_id"), F.col("l_linenumber").alias("cluster"), (part * 37 % 256).cast("double").alias("r"),
        (supp * 91 % 256).cast("double").alias("g"), ((part + 3 * order) % 256).cast("double").alias("b"), F.col("l_quantity").cast("bigint").alias("n"),
    )
    return im.name_clusters(rows).select("item_id", "name", F.conv(F.substring("hex", 2, 2), 16, 10).cast("int").alias("red"))


# ------------------------------------------------------------------ sources
@register(
    "parse_item_metadata",
    "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN event_type END AS label, CASE WHEN event_id % 5 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 5 "
    "= 2 THEN 'metadata_json was not valid JSON' END AS metadata_error FROM events",
)
def _metadata(spark, sf):
    e = F.col("event_id")
    text = (
        F.when(e % 5 == 0, F.concat(F.lit('{"label": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")))
        .when(e % 5 == 1, F.concat(F.lit('{"label": "'), "event_type", F.lit('", "bbox": [1, 2, 3, 4]}')))
        .when(e % 5 == 2, F.concat(F.lit('{"label": '), "props"))
        .when(e % 5 == 3, F.lit("[1, 2]"))
    )
    rows = rd.parse_item_metadata(b.table(spark, sf, "events").select("event_id", text.alias("metadata_json"), "event_type", "props"))
    return rows.select(
        "event_id", F.col("metadata.label").alias("label"), F.get_json_object(F.try_element_at("extra", F.lit("props")), "$.k").alias("k"), "metadata_error"
    )


@register(
    "read_pairs_csv",
    "SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 4 THEN 0 END AS label, CASE WHEN l_suppkey % 4 = 0 THEN 'train' WHEN l_suppkey % "
    "4 = 1 THEN 'holdout' END AS split, CASE WHEN l_partkey % 5 = 3 THEN 'label must be 0 or 1, got x' WHEN l_partkey % 5 = 2 THEN 'label must be 0 or 1, got 2' WHEN l_suppkey % 4 = 1 "
    "THEN 'split must be one of train, valid, test, got holdout' END AS problem FROM lineitem",
)
def _pairs_csv(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    label = F.get(F.array(*[F.lit(x) for x in ("1", "0.0", "2", "x", " 0.7")]), (part % 5).cast("int"))
    split = F.when(supp % 4 == 0, " Train ").when(supp % 4 == 1, "holdout").when(supp % 4 == 2, "")
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("item_a"), F.col("l_linenumber").cast("string").alias("item_b"), label.alias("label"), split.alias("split")
    )
    path = st.work_path(spark, "pairs-csv")
    rows.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    good, bad = rd.read_pairs_csv(spark, path, strict=False)
    return good.withColumn("problem", F.lit(None).cast("string")).unionByName(bad.select(*good.columns, "problem")).select(
        F.col("item_a").cast("bigint").alias("l_orderkey"), F.col("item_b").cast("int").alias("l_linenumber"), "label", "split", "problem"
    )


_WORD = "CASE WHEN p_size % 2 = 0 THEN upper(split_part(p_name, ' ', 2)) || 'S' ELSE split_part(p_name, ' ', 1) || ' ' || lower(p_type) END"


def _catalog(spark, sf):
    word = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("S"))).otherwise(
        F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), F.lower("p_type"))
    )
    return b.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id"), word.alias("category"), F.col("p_name").alias("title"))


_CAT = f"c AS (SELECT p_partkey, {_WORD} AS category FROM part), m AS (SELECT *, {case_map('lower(trim(category))', v.CATALOG_SLOT)} AS slot FROM c)"


@register(
    "read_catalog_parquet",
    f"WITH {_CAT} SELECT coalesce(slot, 'dropped') AS slot, category, count(*) AS n FROM m WHERE slot IS NOT NULL GROUP BY ALL UNION ALL SELECT 'dropped', category, count(*) FROM m WHERE "
    "slot IS NULL GROUP BY ALL",
)
def _read_catalog(spark, sf):
    path = st.work_path(spark, "catalog")
    shards = _catalog(spark, sf).select(F.col("item_id").alias("item_ID"), "category", F.col("title").alias("text"), F.lit(None).cast("binary").alias("image"), F.lit("unread").alias("other"))
    shards.write.parquet(path)
    kept, dropped = rd.read_catalog_parquet(spark, path)
    return (
        kept.groupBy("slot", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(dropped.select(F.lit("dropped").alias("slot"), "category", "n"))
    )


@register(
    "read_embeddings",
    "SELECT vec_id % 3 AS kind, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1",
)
def _read_embeddings(spark, sf):
    k = F.col("vec_id")
    bad = F.when(k % 3 == 1, F.slice("embedding", 1, 63)).when(k % 3 == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
    rows = b.table(spark, sf, "embeddings").select(k.cast("string").alias("item_id"), (k % 3).alias("kind"), F.coalesce(bad, F.col("embedding")).alias("vector"))
    path = st.work_path(spark, "vectors")
    rows.write.parquet(path)
    return rd.read_embeddings(spark, path, b.ENCODER_DIM).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _report_sql() -> str:
    """The facts of the audit without images, as text, from the same pairs; leakage counts shared items of splits."""
    counts = ", ".join(
        f"('{sp}_{name}', (SELECT count(*) FROM disjoint WHERE split = '{sp}' AND label = {y})::VARCHAR)" for sp in v.SPLITS for y, name in ((1, "positive"), (0, "negative"))
    )
    slots = ", ".join(f"('slot_{x}', (SELECT count(*) FROM its WHERE category = '{x}')::VARCHAR)" for x in v.SLOTS)
    dropped = ", ".join(
        f"('dropped_{sp}', ((SELECT count(*) FROM typed WHERE split = '{sp}') - (SELECT count(*) FROM disjoint WHERE split = '{sp}'))::VARCHAR)" for sp in ("valid", "test")
    )
    return (
        TYPED + TI + DISJOINT + ", its AS (SELECT item_id, any_value(category) AS category FROM members LEFT JOIN item_cats USING (item_id) GROUP BY item_id) SELECT metric, value FROM (VALUES "
        "('train_outfits', (SELECT count(DISTINCT set_id) FROM members WHERE split = 'train')::VARCHAR), ('raw_positive_pairs', (SELECT count(*) FROM positives)::VARCHAR), "
        f"('unique_items', (SELECT count(*) FROM its)::VARCHAR), {slots}, {counts}, {dropped}) t(metric, value)"
    )


@register("write_report", _report_sql())
def _write_report(spark, sf):
    """The whole audit, written and read back; the facts that SQL recomputes are shown."""
    from garderobe.plans.audit_report import audit_and_prepare

    audit = audit_and_prepare(b.outfit_items(spark, sf), b.item_categories(spark, sf))
    path = st.work_path(spark, "report")
    rd.write_report(audit.report, audit.gate, path)
    shown = ["train_outfits", "raw_positive_pairs", "unique_items", "dropped_valid", "dropped_test"]
    shown += [f"slot_{s}" for s in v.SLOTS] + [f"{s}_{y}" for s in v.SPLITS for y in ("positive", "negative")]
    return spark.read.schema("metric string, value string").json(f"{path}/metrics").filter(F.col("metric").isin(*shown))


# ------------------------------------------------------------------ streaming
def arrivals(spark, sf):
    schema = b.table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return files.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).alias("wardrobe_id"), F.col("event_type").alias("category"),
        (F.col("value") < 2).alias("needs_review"),
    )


@register("stream_dedup", "SELECT event_id AS id, event_type AS category FROM events")
def _stream_dedup(spark, sf):
    twice = arrivals(spark, sf).union(arrivals(spark, sf))
    return st.run_to_table(st.stream_dedup(twice).select("id", "category"), spark, "dedup")


@register(
    "stream_category_counts",
    "SELECT date_trunc('hour', ts) AS start, event_type AS category, count(*) AS n_items, count(*) FILTER (value < 2) AS n_review FROM events GROUP BY 1, 2 HAVING date_trunc('hour', "
    "any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def _stream_counts(spark, sf):
    counts = st.run_to_table(st.stream_category_counts(arrivals(spark, sf)), spark, "counts")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(
    "stream_ingest",
    with_items(
        ", twins AS (SELECT a.item_id, b.seq AS other FROM item_base a JOIN item_base b ON a.wardrobe_id = b.wardrobe_id AND a.category = b.category AND a.seq % 2 = 1 AND (b.seq % 2 = 0 OR b.seq < a.seq) AND "
        "a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND list_dot_product(a.vec, b.vec) >= 0.97), t AS (SELECT item_id, count(*) AS n, min(other) AS first FROM twins GROUP BY 1) "
        "SELECT i.item_id, coalesce(n, 0)::BIGINT AS possible_duplicates, 'it' || first AS possible_duplicate_of FROM item_base i LEFT JOIN t USING (item_id)"
    ),
)
def _stream_ingest(spark, sf):
    cols = ["wardrobe_id", "category", "item_id", "created_at", "embedding", "seq"]
    items = b.item_base(spark, sf).select(*cols)
    stored = items.filter(F.col("seq") % 2 == 0).drop("seq")
    source = st.work_path(spark, "arriving")
    items.filter(F.col("seq") % 2 == 1).drop("seq").write.parquet(source)
    stream = spark.readStream.schema(stored.schema).parquet(source)
    table = st.stream_ingest(stream, stored, spark)
    return spark.read.parquet(table).select("item_id", "possible_duplicates", "possible_duplicate_of")


@register(
    "cosine",
    "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def _cosine(spark, sf):
    e = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").withColumn("cosine", dot("embedding", "other")).select("vec_id", r6("cosine", "cosine"))


# ------------------------------------------------------------------ files of other shapes
@register(
    "read_outfits_json",
    f"WITH {OUTFITS} SELECT split, set_id::VARCHAR AS set_id, ord, item_id FROM (SELECT split, set_id, item_id, (row_number() OVER (PARTITION BY split, set_id ORDER BY ord) - 1)::INT AS ord, "
    "count(*) OVER (PARTITION BY split, set_id) AS n FROM outfit_items) WHERE n >= 2",
)
def _outfits_json(spark, sf):
    """The outfits written as JSON arrays, some files for each split, and read back in ranges of 256 KB."""
    items = F.sort_array(F.collect_list(F.struct("ord", "item_id")))
    sets = b.outfit_items(spark, sf).groupBy("split", "set_id").agg(items.alias("items"))
    indexed = F.transform("items", lambda x, i: F.struct(x["item_id"].alias("item_id"), i.alias("index")))
    sets = sets.select("split", F.to_json(F.struct(F.col("set_id").cast("string").alias("set_id"), indexed.alias("items"))).alias("record"))
    path, out = st.work_path(spark, "outfits"), None
    for split in v.SPLITS:
        rd.write_json_values(sets.filter(F.col("split") == split), f"{path}/{split}", "[")
        part = rd.read_outfits_json(spark, f"{path}/{split}", split, 256 << 10)
        out = part if out is None else out.unionByName(part)
    return out


@register("read_item_metadata_json", with_outfits("SELECT item_id, category FROM item_cats"))
def _metadata_json(spark, sf):
    info = F.to_json(F.struct(F.col("category").alias("semantic_category"), F.concat(F.lit('a "quoted" {name}, '), "item_id").alias("title")))
    rows = b.item_categories(spark, sf).select(F.concat(F.lit('"'), "item_id", F.lit('": '), info).alias("record"))
    path = st.work_path(spark, "metadata")
    rd.write_json_values(rows, path, "{")
    return rd.read_item_metadata_json(spark, path, 64 << 10).select("item_id", "category")


# ------------------------------------------------------------------ arrivals with state
@register(
    "stream_arrivals",
    with_items(
        ", twins AS (SELECT a.item_id, b.seq AS other FROM item_base a JOIN item_base b ON a.wardrobe_id = b.wardrobe_id AND a.category = b.category AND b.seq < a.seq AND "
        "a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND list_dot_product(a.vec, b.vec) >= 0.97), t AS (SELECT item_id, count(*) AS n, min(other) AS first FROM twins GROUP BY 1) "
        "SELECT i.item_id, coalesce(n, 0)::BIGINT AS possible_duplicates, 'it' || first AS possible_duplicate_of FROM item_base i LEFT JOIN t USING (item_id)"
    ),
)
def _stream_arrivals(spark, sf):
    """All items in three batches, in the order of their arrival."""
    items = b.item_base(spark, sf).select("wardrobe_id", "category", "item_id", "created_at", "embedding", "seq")
    last = items.agg(F.max("seq")).first()[0] or 0
    source, kinds = st.work_path(spark, "arriving"), items.drop("seq").schema
    for i in range(3):
        part = items.filter((F.col("seq") * 3 >= (last + 1) * i) & (F.col("seq") * 3 < (last + 1) * (i + 1)))
        part.drop("seq").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
    return spark.read.parquet(stream_arrivals(stream, spark)).select("item_id", "possible_duplicates", "possible_duplicate_of")


# ------------------------------------------------------------------ the learned variant
UNITS = 3


def small_network() -> compat.Network:
    """A network with weights from a rule, which SQL can make as well."""
    size = 4 * b.ENCODER_DIM
    first = np.sin(1.0 + np.arange(UNITS)[:, None] * size + np.arange(size)[None, :])
    last = np.sin(5.0 + 3.0 * np.arange(2)[:, None] + np.arange(UNITS)[None, :])
    return compat.Network(((first, np.cos(np.arange(UNITS, dtype=np.float64))), (last, np.array([0.1, -0.1]))), b.ENCODER, b.ENCODER_DIM)


def learned_of(spark):
    path = st.work_path(spark, "network")
    compat.save_network(spark, small_network(), path)
    return compat.served(spark, compat.load_network(spark, path), b.ENCODER, b.ENCODER_DIM)


def _unit_sql(u: int, x: str) -> str:
    return f"(1 / (1 + exp(-(list_dot_product({x}, w{u}) + cos({u}.0::DOUBLE)))))"


def _network_sql(x: str) -> str:
    z = [" + ".join(f"sin({5 + 3 * o + u}.0::DOUBLE) * {_unit_sql(u, x)}" for u in range(UNITS)) + f" + {(0.1, -0.1)[o]}::DOUBLE" for o in range(2)]
    return f"(1 / (1 + exp(({z[0]}) - ({z[1]}))))"


_L = v.PAIR_MODELS["with_learned"]
_SIZE = 4 * b.ENCODER_DIM
_TERMS = " + ".join(f"{c!r}::DOUBLE * (({f} - {m!r}) / {s!r})" for f, c, m, s in zip(_L["features"], _L["coef"], _L["mean"], _L["scale"]))


@register(
    "pair_scores_learned",
    with_items(
        f", {OK_ITEMS}, {pairs_sql('ok_items', condition='a.seq < b.seq AND a.category <> b.category')}, "
        "w AS (SELECT " + ", ".join(f"list_transform(range({_SIZE}), lambda j: sin({1 + u * _SIZE}.0::DOUBLE + j)) AS w{u}" for u in range(UNITS)) + "), "
        "gap AS (SELECT p.*, a.vec AS va, b.vec AS vb, list_transform(range(1, 65), lambda i: abs(a.vec[i] - b.vec[i])) AS d, list_transform(range(1, 65), lambda i: a.vec[i] * b.vec[i]) AS m "
        "FROM pairs p JOIN ok_items a ON a.item_id = ia JOIN ok_items b ON b.item_id = ib), "
        f"pr AS (SELECT gap.*, ({_network_sql('list_concat(list_concat(va, vb), list_concat(d, m))')} + {_network_sql('list_concat(list_concat(vb, va), list_concat(d, m))')}) / 2 AS lp FROM gap, w), "
        "fl AS (SELECT * EXCLUDE (p), ln(greatest(least(lp, 1 - 1e-4), 1e-4) / (1 - greatest(least(lp, 1 - 1e-4), 1e-4))) AS learned_logit FROM pr) "
        f"SELECT ia AS a_item_id, ib AS b_item_id, round(lp, 6) AS learned_prob, round(1 / (1 + exp(-({_TERMS} + {_L['intercept']!r}))), 6) AS p FROM fl"
    ),
)
def _pair_scores_learned(spark, sf):
    inputs = pr.pair_inputs(usable(spark, sf))
    pairs = pr.item_pairs(inputs, inputs, ["wardrobe_id"], lambda x, y: pr.earlier(x, y) & (x("slot") != y("slot")))
    scored = pr.pair_scores(pairs, _L, learned_of(spark))
    return scored.select("a_item_id", "b_item_id", r6("learned_prob", "learned_prob"), r6("p", "p"))


@register("generate_outfits_learned")
def _generate_learned(spark, sf):
    learned = learned_of(spark)
    job = generate_outfits(b.items(spark, sf), MODEL, DIM, v.PAIR_MODELS[compat.variant_for(learned)], k=3, threshold=0.1, learned=learned)
    members = F.array_join(F.transform("members", lambda g: g["item_id"]), ",")
    return job.chosen.select("wardrobe_id", "choice", "template", members.alias("item_ids"), r6("score", "score"))
