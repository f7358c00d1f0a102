"""Pair scoring expressions: features, fitted model, contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions.lookup import lookup


def category_pair_score(a: Column, b: Column) -> Column:
    table: dict[str, float] = {}
    for (p, q), score in v.SLOT_PAIR_SCORE.items():
        table[f"{p}+{q}"] = table[f"{q}+{p}"] = score
    key = F.concat_ws("+", a, b)
    found = lookup(table, key)
    return F.when(a == b, F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), F.coalesce(found, F.lit(v.UNKNOWN_SLOT_PAIR)))


def rescale_cosine(cos: Column) -> Column:
    scaled = (cos - v.COSINE_LOW) / (v.COSINE_HIGH - v.COSINE_LOW)
    return F.when(scaled < 0, F.lit(0.0)).when(scaled > 1, F.lit(1.0)).otherwise(scaled)


def shifted_cosine(cos: Column) -> Column:
    return (cos + 1.0) / 2.0


def weighted_mean(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Mean over the known parts with their weights renormalised; 0 if nothing is known."""
    weights = weights or v.SIGNAL_WEIGHTS
    used = [(c, weights[n]) for n, c in parts.items() if weights.get(n, 0.0) > 0]
    num = reduce(lambda p, q: p + q, [F.coalesce(c * w, F.lit(0.0)) for c, w in used])
    den = reduce(lambda p, q: p + q, [F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in used])
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def heuristic_score(cos: Column, slot_a: Column, slot_b: Column) -> Column:
    return weighted_mean({"visual": rescale_cosine(cos), "category": category_pair_score(slot_a, slot_b)})


def logit(p: Column) -> Column:
    q = F.when(p < 1e-4, F.lit(1e-4)).when(p > 1 - 1e-4, F.lit(1 - 1e-4)).otherwise(p)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def contributions(features: dict[str, Column], model: dict) -> dict[str, Column]:
    """coef * standardised value per model feature; unknown values take the fitted mean."""
    out = {}
    for name, coef, mean, scale, impute in zip(
        model["features"], model["coef"], model["mean"], model["scale"], model["impute"]
    ):
        value = F.coalesce(features[name], F.lit(float(impute)))
        out[name] = F.lit(float(coef)) * ((value - F.lit(float(mean))) / F.lit(float(scale)))
    return out


def pair_score(features: dict[str, Column], model: dict) -> Column:
    return joined_score(list(contributions(features, model).values()), model)


def joined_score(parts: list[Column], model: dict) -> Column:
    """The score from contributions that are already known."""
    return sigmoid(reduce(lambda p, q: p + q, parts) + F.lit(float(model["intercept"])))


def context_rank(score: Column, context: Column) -> Column:
    return score + F.coalesce(F.lit(v.SIGNAL_WEIGHTS["context"]) * (context - 0.5), F.lit(0.0))


def pair_weight(slot_a: Column, slot_b: Column) -> Column:
    layered = (slot_a == "accessory") | (slot_b == "accessory")
    return F.when(layered, F.lit(v.ACCESSORY_PAIR_WEIGHT)).otherwise(F.lit(1.0))
