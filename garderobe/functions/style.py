"""Style distributions: fixed-order arrays of seven probabilities (see ``vocab.STYLES``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garderobe import vocab as v
from garderobe.functions.lookup import inline_array


def total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, z: acc + z)


def style_of(scores: Column, style: str) -> Column:
    return F.get(scores, F.lit(v.STYLES.index(style)))


def top_style(scores: Column) -> Column:
    names = inline_array(v.STYLES)
    return F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def _known(x: pa.Array, n: int) -> np.ndarray:
    """(n rows, ``n``) float64 view of a list column; missing entries are 0, entries beyond ``n`` are left out."""
    out = np.zeros((len(x), n))
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    for size in {int(s) for s in sizes if s > 0}:
        rows = np.flatnonzero(sizes == size)
        flat = pc.fill_null(x.take(pa.array(rows)).flatten(), 0.0).to_numpy(zero_copy_only=False)
        out[rows, : min(size, n)] = flat.astype(np.float64).reshape(-1, size)[:, :n]
    return out


def _similarity(x: pa.Array, y: pa.Array) -> pa.Array:
    n = len(v.STYLES)
    terms = np.sqrt(np.maximum(_known(x, n), 0.0) * np.maximum(_known(y, n), 0.0))
    out = terms[:, 0]
    for i in range(1, n):
        out = out + terms[:, i]
    unknown = pc.or_(pc.is_null(x), pc.is_null(y)).to_numpy(zero_copy_only=False)
    return pa.array(out, mask=unknown)


# Bhattacharyya coefficient; null if a side is unknown. In Arrow batches beside the dot product: as generated code its
# terms make the method of a pair longer than the 8,000 bytes up to which the JVM compiles one.
style_similarity = F.arrow_udf(_similarity, T.DoubleType()).asNondeterministic()


def style_match(scores: Column, style: str) -> Column:
    peak = F.array_max(scores)
    share = style_of(scores, style) / F.when(peak == 0, F.lit(1.0)).otherwise(peak)
    return F.when(share > 1, F.lit(1.0)).otherwise(share)


def occasion_match(scores: Column, occasion: str) -> Column:
    """Expected affinity under the distribution; null for an occasion without a table."""
    if occasion not in v.OCCASION_AFFINITY:
        return F.lit(None).cast("double")
    weights = inline_array(v.OCCASION_AFFINITY[occasion])
    mass = total(scores)
    return total(F.zip_with(scores, weights, lambda p, w: p * w)) / F.when(mass == 0, F.lit(1.0)).otherwise(mass)


def user_style_scores(style: Column) -> Column:
    """One-hot distribution for a style set by hand; an unknown style is an error."""
    one_hot = F.array(*[F.when(style == s, F.lit(1.0)).otherwise(F.lit(0.0)) for s in v.STYLES])
    return F.when(style.isin(*v.STYLES), one_hot).otherwise(
        F.raise_error(F.concat(F.lit("Unknown style "), style)).cast("array<double>")
    )


def item_context(scores: Column, style: str | None, occasion: str | None) -> Column:
    """Mean of the requested and known matches; null when nothing is requested or known."""
    parts = []
    if style:
        parts.append(style_match(scores, style))
    if occasion:
        parts.append(occasion_match(scores, occasion))
    if not parts:
        return F.lit(None).cast("double")
    known = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    value = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.when(known > 0, value / known)
