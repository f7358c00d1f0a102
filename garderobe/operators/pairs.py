"""Item pairs inside a wardrobe: features, fitted score, contributions, conflicts and partners."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import boxes, colour, scores, style, vectors
from garderobe.operators.spread import pair_join

Side = Callable[[str], Column]


def pair_inputs(items: DataFrame, keys: Sequence[str] = ("wardrobe_id",), extra: Sequence[str] = ()) -> DataFrame:
    """The narrow item row a pair needs: identity, slot, vector, style, primary colour, photo box."""
    first = F.get("colors", F.lit(0))
    return items.select(
        *keys,
        "item_id",
        F.struct("created_at", "item_id").alias("ord"),
        F.col("category").alias("slot"),
        "embedding",
        "style_scores",
        first["name"].alias("colour"),
        colour.lightness(first["hex"]).alias("light"),
        colour.is_neutral(first["name"]).alias("neutral"),
        colour.hue(first["name"]).alias("hue"),
        "source_image",
        "bbox",
        *extra,
    )


def earlier(a: Side, b: Side) -> Column:
    return a("ord") < b("ord")


def wearable(a: Column, b: Column) -> Column:
    """Two slots that can appear in one outfit: their plausibility is above zero."""
    never = [f"{p}+{q}" for (p, q), s in v.SLOT_PAIR_SCORE.items() if s <= 0]
    never += ["+".join(reversed(x.split("+"))) for x in never]
    return (a != b) & ~F.concat_ws("+", a, b).isin(*never)


def one_garment(a: Side, b: Side) -> Column:
    return boxes.same_region(a("source_image"), a("bbox"), b("source_image"), b("bbox"))


def _carried(side: Side, prefix: str, names: Sequence[str]) -> list[Column]:
    return [side(n).alias(f"{prefix}{n}") for n in names]


FEATURE_INPUTS = ("item_id", "ord", "slot", "embedding", "style_scores", "colour", "light", "neutral", "hue")


def item_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    on: Callable[[Side, Side], Column],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Pairs inside equal ``keys`` that satisfy ``on``; block-wise, so that no key is one task."""
    return pair_join(
        left,
        right,
        keys,
        ["item_id"],
        on,
        select=lambda a, b: [
            *_carried(a, "a_", (*FEATURE_INPUTS, *extra)),
            *_carried(b, "b_", (*FEATURE_INPUTS, *extra)),
            one_garment(a, b).alias("one_region"),
        ],
    )


def pair_features(pairs: DataFrame, learned: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Adds the feature columns; unknown features stay null. ``learned`` maps two vectors to a probability."""
    c = F.col
    vecs, styles = (tuple(c(f"{s}_{n}") for s in "ab") for n in ("embedding", "style_scores"))
    batches = {"clip_cos": vectors.dot(*vecs), "style_sim": style.style_similarity(*styles)}
    if learned is not None:
        batches["learned_prob"] = learned(*vecs)
    out = pairs.withColumns(batches)  # at once, so that the vectors of a pair go to Python once
    if learned is not None:
        out = out.withColumn("learned_logit", scores.logit(c("learned_prob")))
    relation = colour.relation_of(*(tuple(c(f"{s}_{n}") for n in ("colour", "light", "neutral", "hue")) for s in "ab"))
    return (
        out.drop("a_embedding", "b_embedding")
        .withColumn("relation", relation)
        .withColumn("colour", colour.relation_score(c("relation")))
        .withColumn("category", scores.category_pair_score(c("a_slot"), c("b_slot")))
        .withColumn("conflict", F.coalesce(c("clip_cos") >= v.DUPLICATE_COSINE, F.lit(False)) | F.coalesce(c("one_region"), F.lit(False)))
        .drop(*[f"{s}_{n}" for s in "ab" for n in ("style_scores", "light", "neutral", "hue")], "one_region")
    )


def pair_scores(pairs: DataFrame, model: dict, learned: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Features, contributions ``c_<feature>`` and the score ``p`` of every pair."""
    out = pair_features(pairs, learned)
    parts = scores.contributions({f: F.col(f) for f in model["features"]}, model)
    named = out.withColumns({f"c_{f}": x for f, x in parts.items()})
    return named.withColumn("p", scores.joined_score([F.col(f"c_{f}") for f in parts], model))


def pair_summary(items: DataFrame, model: dict) -> DataFrame:
    """Scores every pair of different slots and reduces them per slot pair where they are formed."""
    inputs = pair_inputs(items)
    pairs = item_pairs(inputs, inputs, ["wardrobe_id"], lambda a, b: earlier(a, b) & (a("slot") != b("slot")))
    scored = pair_scores(pairs, model)
    slots = F.concat_ws("+", F.least("a_slot", "b_slot"), F.greatest("a_slot", "b_slot"))
    return scored.groupBy("wardrobe_id", slots.alias("slots")).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if("conflict").alias("n_conflicts"),
        *[F.avg(f).alias(f"mean_{f}") for f in ("clip_cos", "style_sim", "colour", "category", "p")],
        *[F.avg(f"c_{f}").alias(f"mean_c_{f}") for f in model["features"]],
        F.max("p").alias("best_p"),
    )


def recommend_for_item(
    items: DataFrame,
    model: dict,
    k: int | None = None,
    anchors: DataFrame | None = None,
    style_name: str | None = None,
    occasion: str | None = None,
    learned: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Best partners of every anchor: wearable together, not the same garment, score plus context shift.

    With ``k``, Spark's window group limit keeps the best k per anchor inside each task before the shuffle,
    so what travels is k rows per anchor and block, not all pairs.
    """
    context = style.item_context(F.col("style_scores"), style_name, occasion)
    usable = items.withColumn("ctx", context)
    right = pair_inputs(usable, extra=("ctx", "label"))
    left = right if anchors is None else right.join(anchors.select("item_id"), "item_id", "left_semi")
    pairs = item_pairs(
        left,
        right,
        ["wardrobe_id"],
        lambda a, b: (a("item_id") != b("item_id")) & wearable(a("slot"), b("slot")) & ~one_garment(a, b),
        extra=("ctx", "label"),
    )
    scored = pair_scores(pairs, model, learned).filter(~F.col("conflict"))
    pair_ctx = F.coalesce((F.col("a_ctx") + F.col("b_ctx")) / 2, "a_ctx", "b_ctx")
    scored = scored.withColumn("context", pair_ctx).withColumn("score", scores.context_rank(F.col("p"), F.col("context")))
    best = [F.col("score").desc(), F.col("b_ord").asc()]
    rank = Window.partitionBy("wardrobe_id", "a_item_id").orderBy(*best)
    ranked = scored.withColumn("position", F.row_number().over(rank))
    if k is not None:
        ranked = ranked.filter(F.col("position") <= k)
    # Named after the ranking, so that only the pairs that stay are named.
    strongest = F.array_sort(
        F.filter(
            F.array(*[F.struct((-F.col(f"c_{f}")).alias("c"), F.lit(SIGNAL_NAME[f]).alias("n")) for f in model["features"]]),
            lambda s: s["c"] <= -v.STRONG_CONTRIBUTION,
        )
    )
    signals = F.array_join(F.transform(strongest, lambda s: s["n"]), ", ")
    ranked = ranked.withColumn("signals", F.when(signals == "", "no single strong signal").otherwise(signals))
    return ranked.select(
        "wardrobe_id",
        F.col("a_item_id").alias("anchor"),
        F.col("b_item_id").alias("partner"),
        "position",
        "score",
        F.col("p").alias("plausibility"),
        "clip_cos",
        "style_sim",
        "colour",
        "category",
        "context",
        "signals",
    )


# --- Fixed values: names of the signals in explanations -------------------------------------------
SIGNAL_NAME = {
    "learned_logit": "learned compatibility",
    "colour": "colour",
    "style_sim": "style",
    "clip_cos": "visual coherence",
    "category": "garment-type pairing",
}


def recommendation_message(judged: DataFrame, recommended: DataFrame, asked: DataFrame) -> DataFrame:
    """Why an asked item has no partners: unknown, excluded, or nothing to combine it with."""
    state = judged.select("item_id", "reason", F.lit(True).alias("_known"))
    served = recommended.select(F.col("anchor").alias("item_id")).distinct().withColumn("_served", F.lit(True))
    message = (
        F.when(F.col("_known").isNull(), "That item no longer exists.")
        .when(F.col("reason").isNotNull(), F.concat(F.lit("This item cannot be used yet: "), "reason", F.lit(".")))
        .when(F.col("_served").isNull(), "No other usable item in your wardrobe can be worn with this one yet.")
    )
    return (
        asked.select("item_id")
        .join(state, "item_id", "left")
        .join(served, "item_id", "left")
        .select("item_id", message.alias("message"))
    )


# ------------------------------------------------------------------ given outfits
def member_pairs(members: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of the members of each given outfit, in stored order."""
    inputs = pair_inputs(members, keys, extra)
    return item_pairs(inputs, inputs, keys, earlier, extra)


def outfit_scores(scored_pairs: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Plausibility (accessory pairs weigh half), plain mean score and mean known component per outfit."""
    w = scores.pair_weight(F.col("a_slot"), F.col("b_slot"))
    return scored_pairs.groupBy(*keys).agg(
        (F.sum(w * F.col("p")) / F.sum(w)).alias("plausibility"),
        F.avg("p").alias("mean_pair_score"),
        F.avg("clip_cos").alias("visual_similarity"),
        F.avg("style_sim").alias("style"),
        F.avg("colour").alias("colour"),
        F.avg("category").alias("category"),
        *[F.avg(f"c_{f}").alias(f"c_{f}") for f in features],
    )


def colour_summary(members: DataFrame, scored_pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean harmony, palette reason and worst-pair note per outfit; outfits without known pairs are absent.

    The palette sets are sets of colour names, so their size is bounded by the vocabulary.
    """
    keys = list(keys)
    known = scored_pairs.filter(F.col("relation").isNotNull())
    text = colour.relation_text(F.col("relation"), F.col("a_colour"), F.col("b_colour"))
    harmony = known.groupBy(*keys).agg(
        F.avg("colour").alias("mean"),
        F.min(F.struct("colour", "a_ord", "b_ord", text.alias("text"))).alias("worst"),
    )
    first = F.get("colors", F.lit(0))["name"]
    neutral = first.isin(*v.NEUTRALS)
    palette = members.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(~neutral, first))).alias("accents"),
        F.sort_array(F.collect_set(F.when(neutral, first))).alias("neutrals"),
    )
    accents, neutrals, mean = F.col("accents"), F.col("neutrals"), F.col("mean")
    busy = F.size(accents) > 2
    score = F.when(busy, mean - F.lit(0.10) * (F.size(accents) - 2)).otherwise(mean)
    joined = F.array_join(accents, " and ")
    capital = F.concat(F.upper(F.substring(joined, 1, 1)), F.lower(F.substring(joined, F.lit(2), F.length(joined))))
    reason = (
        F.when(
            busy,
            F.concat(F.lit("Busy palette: "), F.size(accents), F.lit(" accent colours ("), F.array_join(accents, ", "), F.lit(")")),
        )
        .when(
            F.size(accents) == 0,
            F.concat(
                F.lit("Neutral palette ("),
                F.array_join(neutrals, ", "),
                F.when(mean < 0.6, ") with little light/dark contrast").otherwise(")"),
            ),
        )
        .when(
            F.size(neutrals) > 0,
            F.concat(capital, F.lit(" balanced by neutrals ("), F.array_join(neutrals, ", "), F.lit(")")),
        )
        .otherwise(F.concat(F.lit("Colour story: "), F.array_join(accents, ", ")))
    )
    note = F.when(F.col("worst.colour") < 0.5, F.concat(F.lit("; note "), F.col("worst.text"))).otherwise("")
    return harmony.join(palette, keys).select(
        *keys,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("colour_score"),
        F.concat(reason, note).alias("colour_reason"),
    )
