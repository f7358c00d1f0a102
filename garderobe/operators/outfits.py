"""Outfit building: pools, core combinations, layers, ranking, selection, explanations, funnel.

A garment travels as one struct ``(created_at, item_id, grp, slot, ctx)``: it orders like the stored items
and carries what later stages need, so candidates never have to be joined back to the item table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import lookup, scores, style
from garderobe.operators import pairs as pr
from garderobe.operators.combine import count_three, layered, three_garments
from garderobe.operators.spread import pair_join, places
from garderobe.session import cut_lineage, written

TEMPLATES = {"+".join(t): t for t in v.CORE_TEMPLATES}
THREE = "top+bottom+shoes"

# --- Fixed values: sentences shown with a result --------------------------------------------------
NO_SHOES = "Every outfit needs shoes, and there are no usable shoes in your wardrobe."
TOO_FEW = "Not enough items for an outfit: add at least one top and one bottom, or a dress/one-piece, plus shoes."
EMPTY_WARDROBE = "Your wardrobe is empty. Add some clothes on the Wardrobe page first."
NONE_USABLE = "No wardrobe item is currently usable for outfits (see the excluded items)."
GONE = "The selected item no longer exists."
UNUSABLE = "The selected item cannot be used: "
ALL_INVALID = (
    "Valid outfit structures exist, but every combination was rejected by the validity rules "
    "(the same garment twice or conflicting items)."
)
TOO_ALIKE = " other strong combination(s) were too similar to these to add variety."
NONE_REACHED = " valid combinations were scored, but none reached the quality threshold ("
ADD_MORE = "). Add more items or review flagged ones."
SOME_FOUND = " strong outfit(s) found from your current wardrobe (you asked for "
KEY = "wardrobe_id"


# ------------------------------------------------------------------ pools
def outfit_pool(
    eligible: DataFrame,
    groups: DataFrame | None = None,
    style_name: str | None = None,
    occasion: str | None = None,
    required: DataFrame | None = None,
) -> DataFrame:
    """Usable garments with their identity struct, context fit, duplicate group and any required garment.

    ``required(wardrobe_id, item_id)`` forces one garment per wardrobe: its slot keeps only that garment.
    """
    items = eligible.withColumn("ctx", style.item_context(F.col("style_scores"), style_name, occasion))
    if groups is None:
        items = items.withColumn("grp", F.col("item_id"))
    else:
        linked = groups.filter(F.col("group_id") != F.col("item_id")).select("item_id", F.col("group_id").alias("grp"))
        items = items.join(linked, "item_id", "left").withColumn("grp", F.coalesce("grp", "item_id"))
    items = items.withColumn("g", F.struct("created_at", "item_id", "grp", F.col("category").alias("slot"), "ctx"))
    if required is None:
        return items.withColumn("forced", F.lit(None).cast("string"))
    wanted = (
        required.select(KEY, "item_id")
        .join(items.select(KEY, "item_id", F.col("category").alias("forced")), [KEY, "item_id"])
        .select(KEY, F.col("item_id").alias("_want"), "forced")
    )
    asked = required.select(KEY).distinct().withColumn("_asked", F.lit(True))
    out = items.join(asked, KEY, "left").join(wanted, KEY, "left")
    usable = F.col("_asked").isNull() | F.col("_want").isNotNull()
    right_slot = (F.col("category") != F.col("forced")) | (F.col("item_id") == F.col("_want"))
    return out.filter(usable & F.coalesce(right_slot, F.lit(True))).drop("_want", "_asked")


def pool_sizes(pool: DataFrame) -> DataFrame:
    return pool.groupBy(KEY).agg(
        F.max("forced").alias("forced"), *[F.count_if(F.col("category") == s).alias(f"n_{s}") for s in v.SLOTS]
    )


def templates_for(sizes: DataFrame) -> DataFrame:
    """Template rows a wardrobe can fill, with their combination counts before pruning."""
    rows = []
    for name, slots in TEMPLATES.items():
        filled = F.lit(True)
        for s in slots:
            filled = filled & (F.col(f"n_{s}") > 0)
        allowed = F.col("forced").isNull() | F.col("forced").isin(*slots, *v.LAYER_SLOTS)
        total = F.lit(1).cast("double")
        for s in slots:
            total = total * F.col(f"n_{s}")
        rows.append(F.when(filled & allowed, F.struct(F.lit(name).alias("template"), total.alias("total"))))
    return (
        sizes.withColumn("_t", F.explode(F.array_compact(F.array(*rows))))
        .withColumn("template", F.col("_t.template"))
        .withColumn("total", F.col("_t.total"))
        .drop("_t")
    )


def template_pool(pool: DataFrame, template: str) -> DataFrame:
    """Garments of the template in the wardrobes that can fill it."""
    usable = templates_for(pool_sizes(pool)).filter(F.col("template") == template)
    return pool.filter(F.col("category").isin(*TEMPLATES[template])).join(usable.select(KEY), KEY)


def keep_per_slot(slots: Sequence[str], limit: int) -> int:
    return max(2, int(limit ** (1.0 / len(slots))))


def prune_pools(
    pool: DataFrame, model: dict, template: str, limit: int, learned=None
) -> tuple[DataFrame, DataFrame]:
    """Garments of one template, cut down where a wardrobe has more than ``limit`` combinations.

    A pruned wardrobe keeps, per slot, the garments with the best pair score to any garment of the other
    slots. The maxima are taken inside the pair blocks, so no pair list is ever shuffled. Also returns the
    pruned wardrobes with their size before and the number kept.
    """
    slots = TEMPLATES[template]
    core = pool.filter(F.col("category").isin(*slots))
    usable = templates_for(pool_sizes(pool)).filter(F.col("template") == template)
    core = core.join(usable.select(KEY, "total"), KEY)
    keep = keep_per_slot(slots, limit)
    report = usable.filter(F.col("total") > limit).select(
        KEY, "template", F.col("total").cast("bigint").alias("before"), F.lit(keep).alias("kept_per_slot")
    )
    small = core.filter(F.col("total") <= limit)
    if report.limit(1).count() == 0:
        return small.drop("total"), report
    large = core.filter(F.col("total") > limit)
    inputs = pr.pair_inputs(large)
    crossed = pr.item_pairs(inputs, inputs, [KEY], lambda a, b: a("slot") != b("slot"))
    strength = (
        pr.pair_scores(crossed, model, learned).groupBy(KEY, F.col("a_item_id").alias("item_id")).agg(F.max("p").alias("strength"))
    )
    best = Window.partitionBy(KEY, "category").orderBy(F.col("strength").desc(), "g")
    kept = (
        large.join(strength, [KEY, "item_id"])
        .withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") <= keep)
        .drop("_r", "strength")
    )
    return small.unionByName(kept).drop("total"), report


# ------------------------------------------------------------------ core combinations
PLACE = {"top": 0, "one_piece": 0, "bottom": 1, "shoes": 2}


def core_pairs(kept: DataFrame, model: dict, learned=None) -> DataFrame:
    """Scored pairs of different slots of each template, in template order; conflicting pairs are left out."""
    keys = [KEY, "template"]
    inputs = pr.pair_inputs(kept, keys, extra=("g",))

    def in_order(a, b):
        return lookup.lookup(PLACE, a("slot")) < lookup.lookup(PLACE, b("slot"))

    scored = pr.pair_scores(pr.item_pairs(inputs, inputs, keys, in_order, extra=("g",)), model, learned)
    return scored.filter(~F.col("conflict")).select(
        *keys, "a_slot", "b_slot", F.col("a_g").alias("ga"), F.col("b_g").alias("gb"), "p"
    )


def core_combinations(scored: DataFrame) -> DataFrame:
    """Every conflict-free combination of each template as ``m1, m2, m3`` with its score sum.

    Pairs meet on the garments they share, in blocks of garments, so that no combination is shuffled; a conflicting pair
    is simply not there, so validity costs no extra join. ``m2`` is null for one-piece outfits.
    """
    keys = [KEY, "template"]

    worn = scored.filter(F.col("template") == "one_piece+shoes").select(
        *keys, F.col("ga").alias("m1"), F.lit(None).cast(scored.schema["ga"].dataType).alias("m2"), F.col("gb").alias("m3"),
        F.col("p").alias("total"), F.lit(1.0).alias("weight"),
    )
    three = three_garments(scored.filter(F.col("template") == THREE), keys, TEMPLATES[THREE])
    return three.withColumn("weight", F.lit(3.0)).unionByName(worn)


def core_counts(scored: DataFrame) -> DataFrame:
    """Per wardrobe the number of rows of :func:`core_combinations` (``valid``), counted in blocks and not formed."""
    three = count_three(scored.filter(F.col("template") == THREE), [KEY], TEMPLATES[THREE])
    worn = scored.filter(F.col("template") == "one_piece+shoes").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return three.unionByName(worn).filter(F.col("n") > 0).groupBy(KEY).agg(F.sum("n").alias("valid"))


def core_scores(pool: DataFrame, model: dict, learned=None) -> DataFrame:
    """The scored pairs of a pool's core garments for each template, written."""
    kept = None
    for template in TEMPLATES:
        part = template_pool(pool, template).withColumn("template", F.lit(template))
        kept = part if kept is None else kept.unionByName(part)
    return written(core_pairs(cut_lineage(kept), model, learned))


def core_of(pool: DataFrame, model: dict, learned=None) -> DataFrame:
    """The core combinations of a pool, without layers."""
    return core_combinations(core_scores(pool, model, learned))


# ------------------------------------------------------------------ layers
def layer_scores(wearers: DataFrame, layers: DataFrame, model: dict, learned=None) -> DataFrame:
    """Per garment, its scores against each layer pool as aligned arrays, one row per layer slot and block.

    ``ps`` is null where the two conflict. A block holds a bounded number of garments whatever the wardrobe
    size, and every garment of a wardrobe sees the same blocks in the same order.
    """
    left, right = pr.pair_inputs(wearers), pr.pair_inputs(layers, extra=("g",))
    pairs = pair_join(
        left,
        right,
        [KEY],
        ["item_id"],
        lambda a, b: a("slot") != b("slot"),
        select=lambda a, b: [
            *pr._carried(a, "a_", pr.FEATURE_INPUTS),
            *pr._carried(b, "b_", pr.FEATURE_INPUTS),
            pr.one_garment(a, b).alias("one_region"),
            b("g").alias("layer_g"),
        ],
    )
    scored = pr.pair_scores(pairs, model, learned).select(
        KEY,
        F.col("a_item_id").alias("wearer"),
        F.col("b_slot").alias("layer"),
        F.col("_bj").alias("blk"),
        "layer_g",
        F.when(~F.col("conflict"), F.col("p")).alias("p"),
    )
    row = F.sort_array(F.collect_list(F.struct("layer_g", "p")))
    return (
        scored.groupBy(KEY, "wearer", "layer", "blk")
        .agg(row.alias("row"))
        .select(
            KEY,
            "wearer",
            "layer",
            "blk",
            F.transform("row", lambda x: x["layer_g"]).alias("gs"),
            F.transform("row", lambda x: x["p"]).alias("ps"),
        )
    )


def best_layer(candidates: DataFrame, vectors: DataFrame, layer: str, members: Sequence[str]) -> DataFrame:
    """Attach the layer garment with the highest new mean, if the mean does not drop or the layer is forced.

    ``members`` are the garment columns present so far; all but the first and last core garment may be null.
    Candidates whose forced layer cannot fit are dropped.
    """
    weight = v.ACCESSORY_PAIR_WEIGHT if layer == "accessory" else 1.0
    table = vectors.filter(F.col("layer") == layer)
    out, sums, count = candidates, None, F.lit(0.0)
    for n, m in enumerate(members):
        cols = [F.col(KEY), F.col("wearer").alias(f"_w{n}"), F.col("blk"), F.col("ps").alias(f"_p{n}")]
        if n == 0:
            cols.append(F.col("gs"))
        out = out.withColumn(f"_w{n}", F.col(m)["item_id"]).join(
            table.select(*cols), [KEY, f"_w{n}"] + (["blk"] if n else []), "left"
        )
        mine = F.col(f"_p{n}")
        both = mine if sums is None else F.zip_with(sums, mine, lambda x, y: x + y)
        sums = both if sums is None else F.when(F.col(m).isNull(), sums).otherwise(both)
        count = count + F.col(m).isNotNull().cast("double")
    out = out.withColumn("_sum", sums).withColumn("_best", F.array_max("_sum"))
    found = F.get("gs", (F.array_position("_sum", F.col("_best")) - 1).cast("int"))
    pick = F.when(F.col("_best").isNotNull(), F.struct((-F.col("_best")).alias("neg"), found.alias("g")))
    ids = [*members]
    others = [c for c in candidates.columns if c not in ids and c not in (KEY, "template")]
    merged = (
        out.withColumn("_pick", pick)
        .groupBy(KEY, "template", *ids)
        .agg(*[F.first(c).alias(c) for c in others], F.min("_pick").alias("_pick"))
    )
    fits = F.col("_pick").isNotNull()
    new_total = F.col("total") - weight * F.col("_pick.neg")
    new_weight = F.col("weight") + weight * count
    forced = F.coalesce(F.col("forced") == layer, F.lit(False))
    use = fits & ((new_total / new_weight >= F.col("total") / F.col("weight")) | forced)
    return (
        merged.filter(fits | ~forced)
        .withColumn(layer, F.when(use, F.col("_pick.g")))
        .withColumn("_t", F.when(use, new_total).otherwise(F.col("total")))
        .withColumn("_w", F.when(use, new_weight).otherwise(F.col("weight")))
        .drop("total", "weight", "_pick")
        .withColumnsRenamed({"_t": "total", "_w": "weight"})
    )


LAYERS = (("outerwear", 1.0), ("accessory", v.ACCESSORY_PAIR_WEIGHT))


def dressed(scored: DataFrame, vectors: DataFrame, template: str) -> DataFrame:
    """The distinct core combinations of ``template`` after :func:`best_layer` for outerwear and accessory, formed in tasks that
    hold the layer arrays of their garments, so that no combination is shuffled. ``scored`` carries ``forced`` and ``want``."""
    slots = TEMPLATES[template]
    pairs = scored.filter(F.col("template") == template)
    return layered(pairs, vectors, [KEY, "template"], slots if len(slots) == 3 else (slots[0], "", slots[1]), LAYERS)


def build_candidates(
    pool: DataFrame,
    model: dict,
    include_outerwear: bool = True,
    include_accessory: bool = True,
    limit: int | None = None,
    learned=None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All valid candidates with layers, score and rank; also the core combinations and the pruning report.

    Nothing is left out unless the caller sets ``limit``: then :func:`prune_pools` cuts wardrobes with more
    combinations and reports them; the report is null otherwise.

    Pair scores and layer arrays are written once to the checkpoint folder: each is read by several joins.
    """
    kept, report = None, None
    for template in TEMPLATES:
        if limit is None:
            part, pruned = template_pool(pool, template), None
        else:
            part, pruned = prune_pools(pool, model, template, limit, learned)
        part = part.withColumn("template", F.lit(template))
        kept = part if kept is None else kept.unionByName(part)
        report = pruned if report is None else report.unionByName(pruned)
    kept = cut_lineage(kept)
    scored = written(core_pairs(kept, model, learned))
    forced = pool_sizes(pool).select(KEY, "forced")
    core = core_combinations(scored).join(forced, KEY)
    wanted = {"outerwear": include_outerwear, "accessory": include_accessory}
    # Without its switch a layer is open only to wardrobes that force it.
    on = [s for s, w in wanted.items() if w]
    layers = pool.filter(F.col("category").isin(*v.LAYER_SLOTS)).filter(
        F.col("category").isin(*on) | F.coalesce(F.col("forced") == F.col("category"), F.lit(False))
    )
    core_items = kept.drop("template").dropDuplicates([KEY, "item_id"])
    wearers = core_items.unionByName(pool.filter(F.col("category") == "outerwear"))
    vectors = written(layer_scores(wearers, layers, model, learned))
    known = scored.join(forced, KEY).withColumn("want", F.lit(None).cast("string"))
    cands = dressed(known, vectors, THREE).unionByName(dressed(known, vectors, "one_piece+shoes"))
    return rank_columns(cands), core, report


def rank_columns(candidates: DataFrame) -> DataFrame:
    core = F.array_compact(F.array("m1", "m2", "m3"))
    known = F.filter(F.transform(core, lambda g: g["ctx"]), lambda x: x.isNotNull())
    ctx = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))
    return (
        candidates.withColumn("core", core)
        .withColumn("members", F.array_compact(F.array("m1", "m2", "m3", "outerwear", "accessory")))
        .withColumn("score", F.col("total") / F.col("weight"))
        .withColumn("context", ctx)
        .withColumn("rank", scores.context_rank(F.col("score"), F.col("context")))
        .select(KEY, "template", "core", "members", "score", "context", "rank")
    )


def quality_threshold(candidates: DataFrame, threshold: float | None) -> DataFrame:
    """Candidates at or above the fitted cut-off; everything when the model has none."""
    return candidates if threshold is None else candidates.filter(F.col("score") >= threshold)


def rank_candidates(strong: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates with their place in the order of their wardrobe; with ``limit`` only the first ones.

    Without ``limit`` every candidate gets its place, so the order of a wardrobe is cut into ranges of ranks.
    """
    garments = F.transform("members", lambda g: F.struct(g["created_at"], g["item_id"]))
    if limit is None:
        return places(strong, [KEY], "rank", [garments], "position")
    order = Window.partitionBy(KEY).orderBy(F.col("rank").desc(), garments)
    return strong.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


# ------------------------------------------------------------------ diversity
def diverse_topk(
    strong: DataFrame, k: int, weight: float = v.DIVERSITY_WEIGHT, max_shared: float = v.MAX_SHARED_CORE
) -> DataFrame:
    """Greedy selection per wardrobe over all candidates: rank minus the largest overlap with what is chosen, at most
    half a shared core. Adds ``choice`` from 1.

    One round per choice: the chosen outfits of a wardrobe (k rows at most) are joined to its candidates, and one
    maximum per wardrobe, combined before the shuffle, is the next. Ties go to the higher rank, then to the earlier
    garments. Rounds end early when no wardrobe finds another outfit.
    """
    groups = lambda c: F.array_distinct(F.transform(c, lambda g: g["grp"]))
    order = F.transform("members", lambda g: F.struct(g["created_at"], g["item_id"]))
    slim = strong.select(KEY, "rank", order.alias("order"), groups("core").alias("core_groups"), groups("members").alias("look_groups"))
    slim = written(slim)
    kind = "array<struct<core:array<string>,look:array<string>>>"
    state = None  # wardrobe, what was chosen so far, and its garments

    def overlap(own: str, other: Column) -> Column:
        shared = F.size(F.array_intersect(F.col(own), other)).cast("double")
        return shared / F.greatest(F.size(own), F.size(other))

    def worst(own: str, part: str) -> Column:
        return F.aggregate("past", F.lit(0.0), lambda most, c: F.greatest(most, overlap(own, c[part])))

    for choice in range(1, k + 1):
        if state is None:
            rows = slim.withColumn("past", F.array().cast(kind))
        else:
            # A wardrobe without a new choice in the last round is done.
            rows = slim.join(state.filter(F.size("taken") == choice - 1), KEY)
            rows = rows.filter(worst("core_groups", "core") <= max_shared + 1e-9)
            # With a limit of a whole core the chosen outfits themselves would come again.
            rows = rows.filter(~F.array_contains("taken", F.col("order")))
        value = F.col("rank") - F.lit(weight) * worst("look_groups", "look")
        best = F.min(F.struct((-value).alias("value"), (-F.col("rank")).alias("rank"), "order", "core_groups", "look_groups"))
        pick = rows.groupBy(KEY).agg(best.alias("b"))
        one = F.array(F.struct(F.col("b.core_groups").alias("core"), F.col("b.look_groups").alias("look")))
        if state is None:
            after = pick.select(KEY, one.alias("past"), F.array("b.order").alias("taken"))
        else:
            more = F.col("b").isNotNull()
            after = state.join(pick, KEY, "left").select(
                KEY,
                F.when(more, F.concat("past", one)).otherwise(F.col("past")).alias("past"),
                F.when(more, F.concat("taken", F.array("b.order"))).otherwise(F.col("taken")).alias("taken"),
            )
        state = written(after)  # of known size, so that a small one goes to the candidates
        if state.filter(F.size("taken") == choice).limit(1).count() == 0:
            break
    if state is None:
        return strong.withColumn("choice", F.lit(1)).filter(F.lit(False))
    found = state.select(KEY, F.posexplode("taken").alias("choice", "order")).withColumn("choice", F.col("choice") + 1)
    return strong.withColumn("order", order).join(found, [KEY, "order"]).drop("order")


# ------------------------------------------------------------------ funnel, exposure, messages
def funnel(judged: DataFrame, pool: DataFrame, candidates: DataFrame, core: DataFrame, chosen: DataFrame,
           threshold: float | None, include_outerwear: bool = True, include_accessory: bool = True,
           limit: int | None = None) -> DataFrame:
    """Counts per stage and wardrobe."""
    base = judged.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("wardrobe_items"), F.count_if(F.col("reason").isNull()).alias("eligible_items")
    )
    combos = F.lit(0.0)
    structural = F.lit(0.0)
    plans = templates_for(pool_sizes(pool))
    for name, slots in TEMPLATES.items():
        size = F.col("total")
        if limit is not None:
            pruned = F.lit(1.0)
            for s in slots:
                pruned = pruned * F.least(F.col(f"n_{s}"), F.lit(keep_per_slot(slots, limit))).cast("double")
            size = F.when(F.col("total") > limit, pruned).otherwise(size)
        combos = F.when(F.col("template") == name, size).otherwise(combos)
    structural = combos
    for layer, wanted in (("outerwear", include_outerwear), ("accessory", include_accessory)):
        n = F.col(f"n_{layer}")
        forced = F.coalesce(F.col("forced") == layer, F.lit(False))
        factor = F.when(n == 0, F.lit(1)).when(forced, n).otherwise(n + 1 if wanted else F.lit(1))
        structural = structural * factor
    planned = plans.groupBy(KEY).agg(
        F.sum(structural).cast("bigint").alias("structural_combinations"), F.sum(combos).cast("bigint").alias("core_combinations")
    )
    strong = F.lit(True) if threshold is None else F.col("score") >= threshold
    scored = candidates.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("candidates_scored"), F.count_if(strong).alias("above_threshold")
    )
    shown = (
        chosen.select(KEY, "choice", F.explode("members").alias("g"))
        .groupBy(KEY)
        .agg(F.countDistinct("choice").alias("returned"), F.countDistinct("g.item_id").alias("unique_items_in_results"))
    )
    out = base.join(planned, KEY, "left").join(scored, KEY, "left").join(shown, KEY, "left")
    counts = [c for c in out.columns if c != KEY]
    out = out.fillna(0, counts)
    return out.withColumn("rejected_by_validity", F.col("core_combinations") - F.col("candidates_scored"))


def exposure(pool: DataFrame, strong: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per usable garment: appearances among strong candidates and in the selection."""

    def count(df: DataFrame, name: str) -> DataFrame:
        worn = df.select(KEY, F.explode("members").alias("g"))
        return worn.groupBy(KEY, F.col("g.item_id").alias("item_id")).agg(F.count(F.lit(1)).alias(name))

    return (
        pool.select(KEY, "item_id", "category")
        .join(count(strong, "in_strong_candidates"), [KEY, "item_id"], "left")
        .join(count(chosen, "selected"), [KEY, "item_id"], "left")
        .fillna(0, ["in_strong_candidates", "selected"])
    )


def shortage_message(sizes: DataFrame, required_label: Column | None = None) -> DataFrame:
    """What a wardrobe lacks for any outfit; null when a template can be filled."""
    have = []
    for s in sorted(v.SLOTS):
        n = F.col(f"n_{s}")
        have.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + v.SLOT_NAMES[s].lower()))))
    owned = F.concat_ws(", ", *have)
    owned = F.when(owned == "", "nothing usable").otherwise(owned)
    tail = F.concat(F.lit(" Usable items: "), owned, F.lit("."))
    body = (F.col("n_top") > 0) & (F.col("n_bottom") > 0) | (F.col("n_one_piece") > 0)
    message = F.when(
        F.col("n_shoes") == 0,
        F.concat(F.lit(NO_SHOES), tail),
    ).when(
        ~body,
        F.concat(F.lit(TOO_FEW), tail),
    )
    if required_label is not None:
        for mine, other in (("top", "bottom"), ("bottom", "top")):
            text = F.concat(
                F.lit("To build an outfit around this "),
                required_label,
                F.lit(f" you need at least one {v.SLOT_NAMES[other].lower()}."),
                tail,
            )
            message = F.when((F.col("forced") == mine) & (F.col(f"n_{other}") == 0), text).otherwise(message)
    return sizes.withColumn("message", message)


def excluded_items(judged: DataFrame) -> DataFrame:
    """Items that take no part, counted by wardrobe, slot and reason."""
    return judged.filter(F.col("reason").isNotNull()).groupBy(KEY, "category", "reason").agg(F.count(F.lit(1)).alias("n_excluded"))


def required_message(judged: DataFrame, required: DataFrame) -> DataFrame:
    """(wardrobe, message) where the garment that ``required(wardrobe_id, item_id)`` asks for is excluded or gone."""
    state = judged.select(KEY, "item_id", "reason", F.lit(True).alias("_known"))
    joined = required.select(KEY, "item_id").join(state, [KEY, "item_id"], "left")
    message = F.when(F.col("_known").isNull(), GONE).when(F.col("reason").isNotNull(), F.concat(F.lit(UNUSABLE), "reason", F.lit(".")))
    return joined.select(KEY, message.alias("message")).filter(F.col("message").isNotNull())


def result_message(stages: DataFrame, shortages: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """The sentence shown with a result; null when k outfits were returned."""
    c = F.col
    joined = stages.join(shortages.select(KEY, F.col("message").alias("_short")), KEY, "left")
    leftover = c("above_threshold") - c("returned")
    extra = F.when(
        leftover > 0,
        F.concat(F.lit(" "), leftover, F.lit(TOO_ALIKE)),
    ).otherwise("")
    cut = F.lit("none" if threshold is None else f"{threshold:.2f}")
    message = (
        F.when(c("wardrobe_items") == 0, EMPTY_WARDROBE)
        .when(c("eligible_items") == 0, NONE_USABLE)
        .when(c("_short").isNotNull(), c("_short"))
        .when(
            c("candidates_scored") == 0,
            ALL_INVALID,
        )
        .when(
            c("returned") == 0,
            F.concat(
                c("candidates_scored"),
                F.lit(NONE_REACHED),
                cut,
                F.lit(ADD_MORE),
            ),
        )
        .when(
            c("returned") < k,
            F.concat(
                c("returned"), F.lit(SOME_FOUND), F.lit(f"{k})."), extra
            ),
        )
    )
    return joined.withColumn("message", message).drop("_short")


# ------------------------------------------------------------------ explanations
def structure_text(slots: Column) -> Column:
    """"Valid top + bottom + shoes structure" from an array of slots."""
    order = ("top", "bottom", "one_piece", "shoes", "outerwear", "accessory")
    present = [F.when(F.array_contains(slots, s), v.SLOT_NAMES[s].lower()) for s in order]
    return F.concat(F.lit("Valid "), F.concat_ws(" + ", *present), F.lit(" structure"))


def explain_outfits(
    chosen: DataFrame, items: DataFrame, model: dict, style_name: str | None = None, occasion: str | None = None, learned=None
) -> DataFrame:
    """Components, reasons and caveats of the chosen outfits (k per wardrobe, at most five garments each)."""
    keys = [KEY, "choice"]
    worn = chosen.select(KEY, "choice", F.posexplode("members").alias("pos", "g")).select(
        KEY, "choice", "pos", F.col("g.item_id").alias("item_id")
    )
    members = worn.join(items, [KEY, "item_id"])
    scored = pr.pair_scores(pr.member_pairs(members, keys), model, learned)
    parts = pr.outfit_scores(scored, keys, model["features"]).drop("plausibility", "mean_pair_score")
    colours = pr.colour_summary(members, scored, keys)
    unsure = (F.col("confidence") < v.MODERATE_CONFIDENCE) & (F.col("review_status") != "confirmed")
    caveat = F.when(
        F.coalesce(unsure, F.lit(False)),
        F.concat(
            lookup.item_label(F.col("label"), F.col("category")),
            F.lit(" was detected with moderate confidence ("),
            F.format_number("confidence", 2),
            F.lit(")"),
        ),
    )
    facts = members.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "item_id", "category", "label", "style", caveat.alias("caveat")))).alias("worn")
    )
    joined = chosen.join(parts, keys, "left").join(colours, keys, "left").join(facts, keys)
    tops = F.filter(F.transform("worn", lambda m: m["style"]), lambda s: s.isNotNull())
    palette = F.col("colour_reason")
    strong = {
        "learned_logit": F.lit("Strong learned compatibility (model trained on real outfits)"),
        "colour": F.coalesce(F.concat(F.lit("Good colour coordination: "), palette), F.lit("Good colour coordination")),
        "style_sim": F.when(
            F.size(F.array_distinct(tops)) == 1, F.concat(F.lit("Consistent "), F.get(tops, F.lit(0)), F.lit(" style (CLIP estimate)"))
        ).otherwise("Styles agree (CLIP estimate)"),
        "clip_cos": F.lit("Pieces look visually coherent together"),
        "category": F.lit("Classic pairing of these garment types"),
    }
    mixed = F.concat(F.lit("mixed styles ("), F.array_join(F.array_sort(F.array_distinct(tops)), ", "), F.lit(")"))
    weak = {
        "learned_logit": F.lit("learned compatibility signal is weak"),
        "colour": F.coalesce(F.concat(F.lit("colours: "), palette), F.lit("colours do not coordinate well")),
        "style_sim": F.when(F.size(tops) > 0, mixed).otherwise("mixed styles"),
        "clip_cos": F.lit("pieces look very different from each other"),
        "category": F.lit("unusual combination of garment types"),
    }
    feats = list(enumerate(model["features"]))
    ups = F.array(*[F.struct((-F.col(f"c_{f}")).alias("c"), F.lit(i).alias("i"), strong[f].alias("t")) for i, f in feats])
    downs = F.array(*[F.struct(F.col(f"c_{f}").alias("c"), F.lit(i).alias("i"), weak[f].alias("t")) for i, f in feats])
    good = F.transform(F.array_sort(F.filter(ups, lambda s: s["c"] <= -v.STRONG_CONTRIBUTION)), lambda s: s["t"])
    bad = F.transform(F.array_sort(F.filter(downs, lambda s: s["c"] <= -v.STRONG_CONTRIBUTION)), lambda s: s["t"])
    weaker = F.when(F.size(bad) > 0, F.array(F.concat(F.lit("Weaker: "), F.array_join(bad, "; ")))).otherwise(F.array().cast("array<string>"))
    wanted = " / ".join(x for x in (style_name, occasion) if x)
    ctx = F.col("context")
    word = F.when(ctx >= 0.6, "Good").when(ctx >= 0.35, "Partial").otherwise("Weak")
    fit = F.concat(word, F.lit(f" fit for '{wanted}' ("), F.format_number(ctx, 2), F.lit(")"))
    none = F.array().cast("array<string>")
    fits_good = F.when(ctx >= 0.6, F.array(fit)).otherwise(none)
    fits_less = F.when(ctx < 0.6, F.array(fit)).otherwise(none)
    structure = structure_text(F.transform("worn", lambda m: m["category"]))
    return joined.select(
        *keys,
        "template",
        F.array_join(F.transform("worn", lambda m: m["item_id"]), ",").alias("item_ids"),
        "score",
        "rank",
        "context",
        "visual_similarity",
        F.col("style").alias("style_agreement"),
        "colour",
        "category",
        structure.alias("structure"),
        F.coalesce(palette, F.lit("no colour data")).alias("colour_note"),
        F.when(F.size(tops) > 0, F.concat(F.lit("top styles: "), F.array_join(tops, ", "))).otherwise("no style data").alias("style_note"),
        F.concat(F.array(structure), good, F.coalesce(fits_good, none)).alias("reasons"),
        F.concat(weaker, F.coalesce(fits_less, none), F.filter(F.transform("worn", lambda m: m["caveat"]), lambda x: x.isNotNull())).alias("caveats"),
    )


def outfit_json(explained: DataFrame, items: DataFrame) -> DataFrame:
    """One JSON document per outfit: rounded score and components, garments, reasons, caveats."""
    keys = [KEY, "choice"]
    worn = explained.select(*keys, F.posexplode(F.split("item_ids", ",")).alias("pos", "item_id"))
    garments = (
        worn.join(items.select(KEY, "item_id", "category", "label"), [KEY, "item_id"])
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("item_id").alias("id"), "category", "label"))).alias("items"))
    )
    r4 = lambda c: F.bround(c, 4)
    parts = F.struct(
        r4("score").alias("plausibility"), r4("colour").alias("colour"), r4("style_agreement").alias("style"),
        r4("visual_similarity").alias("visual_similarity"), r4("category").alias("category"), r4("context").alias("context"),
    )
    doc = F.struct(
        r4("score").alias("score"),
        F.transform("items", lambda m: F.struct(m["id"].alias("id"), m["category"].alias("category"), m["label"].alias("label"))).alias("items"),
        parts.alias("components"), "reasons", "caveats", "structure",
        F.col("colour_note").alias("colour"), F.col("style_note").alias("style"),
    )
    return explained.join(garments, keys).select(*keys, F.to_json(doc).alias("outfit"))


# ------------------------------------------------------------------ validity of given outfits
def structural_validity(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every reason why a given outfit fails, one row per reason; valid outfits have no rows.

    ``members`` are item rows with ``keys`` naming the outfit and ``reason`` from the eligibility check.
    Reasons stay rows because their number grows with the outfit.
    """
    keys = list(keys)
    label = lookup.item_label(F.col("label"), F.col("category"))
    excluded = members.filter(F.col("reason").isNotNull()).select(
        *keys,
        F.lit(1).alias("stage"),
        F.concat(label, F.lit(" ("), "category", F.lit(") is not eligible: "), "reason").alias("why"),
    )
    per_slot = members.filter(F.col("category").isin(*v.SLOTS)).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))
    repeated = per_slot.filter(F.col("n") > 1).select(
        *keys,
        F.lit(2).alias("stage"),
        F.concat(
            F.lit("contains "), "n", F.lit(" items of the same type ("), F.lower(lookup.lookup(v.SLOT_NAMES, F.col("category"))), F.lit(")")
        ).alias("why"),
    )
    has = {s: F.count_if(F.col("category") == s) > 0 for s in ("top", "bottom", "one_piece", "shoes")}
    shape = members.groupBy(*keys).agg(*[x.alias(f"has_{s}") for s, x in has.items()])
    top, bottom, one, shoes = (F.col(f"has_{s}") for s in ("top", "bottom", "one_piece", "shoes"))
    body = F.when(one | (top & bottom), F.lit(None)).when(top, "a top needs a bottom (or use a dress/one-piece)").when(
        bottom, "a bottom needs a top (or use a dress/one-piece)"
    ).otherwise("no main garment: needs a top + bottom or a dress/one-piece")
    mixed = F.when(one & (top | bottom), "a dress/one-piece cannot be worn with a separate top or bottom")
    broken = shape.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(3).alias("stage"), mixed.alias("why")),
                    F.struct(F.lit(4).alias("stage"), body.alias("why")),
                    F.struct(F.lit(5).alias("stage"), F.when(~shoes, "no shoes").alias("why")),
                ),
                lambda s: s["why"].isNotNull(),
            )
        ).alias("s"),
    ).select(*keys, "s.stage", "s.why")
    inputs = pr.pair_inputs(members, keys, ("label",))
    pairs = pr.item_pairs(inputs, inputs, keys, pr.earlier, ("label",))
    clash = pr.pair_features(pairs.withColumn("region", F.col("one_region"))).filter(F.coalesce("conflict", "region"))
    same = clash.select(
        *keys, F.lit(6).alias("stage"), F.lit("two items are the same garment (same photo region or identical image)").alias("why")
    )
    photo = clash.filter("region").select(
        *keys,
        F.lit(7).alias("stage"),
        F.concat(
            lookup.item_label(F.col("a_label"), F.col("a_slot")), F.lit(" and "), lookup.item_label(F.col("b_label"), F.col("b_slot")),
            F.lit(" are the same region of the same photo"),
        ).alias("why"),
    )
    out = excluded
    for part in (repeated, broken, same, photo):
        out = out.unionByName(part)
    return out.distinct()
