"""Vector expressions. Dot products run as Arrow batches in numpy; everything else stays in the JVM."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(column: pa.Array) -> np.ndarray:
    """(n, d) float64 view of a non-null list column whose rows share one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _dot(x: pa.Array, y: pa.Array) -> pa.Array:
    lx, ly = x.value_lengths(), y.value_lengths()
    same = pa.compute.fill_null(pa.compute.equal(lx, ly), False).to_numpy(zero_copy_only=False)
    out = np.full(len(x), np.nan)
    if same.any():
        for length in np.unique(lx.to_numpy(zero_copy_only=False)[same]):
            hit = same & (lx.to_numpy(zero_copy_only=False) == length)
            keep = pa.array(hit)
            if length:
                out[hit] = np.einsum("ij,ij->i", _rows(x.filter(keep)), _rows(y.filter(keep)))
            else:
                out[hit] = 0.0
    return pa.array(out, mask=~same)


# Row-wise dot product in double precision; null where a side is null or the lengths differ. Marked
# non-deterministic so that a filter on the result does not make Spark compute it a second time.
dot = F.arrow_udf(_dot, T.DoubleType()).asNondeterministic()


def dot_expr(x: Column, y: Column) -> Column:
    """The same product as a pure Column expression, for short arrays."""
    return F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, z: acc + z
    )


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, z: acc + z.cast("double") * z.cast("double")))


def l2_normalize(x: Column, eps: float = 1e-12) -> Column:
    length = F.greatest(norm(x), F.lit(eps))
    return F.transform(x, lambda z: z.cast("double") / length)


def all_finite(x: Column) -> Column:
    return F.forall(x, lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < F.lit(math.inf)))


def leading(x: Column, m: int = 16) -> list[Column]:
    """The first ``m`` components as plain columns, for :func:`may_be_near`."""
    return [F.coalesce(F.get(x, F.lit(i)).cast("double"), F.lit(0.0)) for i in range(m)]


def may_be_near(a: list[Column], b: list[Column], cosine: float) -> Column:
    """Necessary condition for two unit vectors to reach ``cosine``.

    The squared distance of unit vectors is ``2 - 2 cos``; a sum over some components can only be smaller.
    Norms may be off by 2%, so the bound is widened accordingly. Cheap, exact (never drops a true match)
    and evaluated inside the join, so far pairs are never emitted.
    """
    partial = sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
    return partial <= F.lit(2 * 1.02**2 - 2 * cosine + 1e-6)


def softmax_rounded(logits: Column) -> Column:
    """Max-subtracted softmax of an array, each entry rounded to 4 places."""
    peak = F.array_max(logits)
    shifted = F.transform(logits, lambda z: F.exp(z - peak))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, z: acc + z)
    return F.transform(shifted, lambda z: F.round(z / total, 4))


def style_logits(prompts: list[list[float]], temperature: float):
    """Arrow function mapping unit vectors to ``temperature * (prompts @ v)``; null in, null out."""
    matrix = np.asarray(prompts, dtype=np.float64)

    def logits(x: pa.Array) -> pa.Array:
        known = pa.compute.fill_null(pa.compute.equal(x.value_lengths(), matrix.shape[1]), False)
        hit = known.to_numpy(zero_copy_only=False)
        scores = np.zeros((len(x), matrix.shape[0]))
        if hit.any():
            scores[hit] = temperature * (_rows(x.filter(known)) @ matrix.T)
        offsets = np.arange(0, scores.size + 1, matrix.shape[0], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()), mask=pa.array(~hit))

    return F.arrow_udf(logits, T.ArrayType(T.DoubleType())).asNondeterministic()
