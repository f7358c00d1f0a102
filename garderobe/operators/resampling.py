"""Bootstrap of any metric that is a function of weighted sums, without a row per replicate.

A task adds up its own rows into one small matrix per key (replicates x terms) and hands on only that, so what is
shuffled is tasks x keys x replicates numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from garderobe.functions.lookup import hash_int
from garderobe.operators.metrics import PRIME, REPLICATE_BLOCK, replicate_weights

#: Keys whose matrices a task holds at once; with more it hands on what it has and starts again.
KEYS_HELD = 200


@dataclass(frozen=True)
class SumMetric:
    """``terms`` are numbers of a row; ``value`` makes the metric of their weighted sums and the sum ``weight``."""

    terms: Mapping[str, Column]
    value: Callable[[Mapping[str, Column]], Column]


def brier(score: str = "score", label: str = "label") -> SumMetric:
    gap = F.col(score) - F.col(label)
    return SumMetric({"gap": gap * gap}, lambda s: F.try_divide(s["gap"], s["weight"]))


def f1(threshold: float = 0.5, score: str = "score", label: str = "label") -> SumMetric:
    """Harmonic mean of precision and recall at ``threshold``; 0 when nothing is or should be found."""
    hit, positive = F.col(score) >= threshold, F.col(label) == 1
    terms = {"tp": hit & positive, "fp": hit & ~positive, "fn": ~hit & positive}
    return SumMetric(terms, lambda s: F.coalesce(F.try_divide(2 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"]), F.lit(0.0)))


def _group_sums(batch: pa.RecordBatch, n_terms: int, n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Group names of a batch, the first row of each, and its sums (groups, replicates, terms)."""
    names = np.array(batch.column("_group").to_pylist(), dtype=object)
    groups, first, own = np.unique(names, return_index=True, return_inverse=True)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(groups)))
    h = batch.column("_h").to_numpy()[order]
    terms = [batch.column(f"_t{i}").to_numpy()[order] for i in range(n_terms)]
    sums = np.empty((len(groups), n, n_terms))
    for low in range(0, n, REPLICATE_BLOCK):
        block = np.arange(low + 1, min(low + REPLICATE_BLOCK, n) + 1, dtype=np.int64)
        weights = replicate_weights(h, block)
        for i, term in enumerate(terms):
            sums[:, low : low + len(block), i] = np.add.reduceat(weights * term[:, None], starts, axis=0)
    return list(groups), first, sums


def bootstrap_sums(
    df: DataFrame,
    row_key: Sequence[str],
    metrics: Mapping[str, SumMetric],
    keys: Sequence[str] = (),
    n: int = 500,
    seed: int = 0,
) -> DataFrame:
    """One row per key and replicate with the value of each metric, all on the same weights.

    The weights are those of ``bootstrap_values``: a row gets the same ones there and here. A term that is null or NaN
    counts as 0, so rows without a score should be filtered before. No row: no result.
    """
    keys = list(keys)
    columns, place = [F.lit(1.0)], {}
    for name, metric in metrics.items():
        place[name] = {"weight": 0} | {t: len(columns) + i for i, t in enumerate(metric.terms)}
        columns += metric.terms.values()
    h = F.pmod(hash_int(F.concat_ws(":", F.lit(str(seed)), F.concat_ws("|", *row_key)), 8), F.lit(PRIME))
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    terms = [F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_t{i}") for i, c in enumerate(columns)]
    rows = df.select(*keys, group.alias("_group"), h.alias("_h"), *terms)
    n_terms = len(columns)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.RecordBatch, np.ndarray]] = {}

        def packed() -> pa.RecordBatch:
            flat = pa.array(np.concatenate([s.ravel() for _, s in held.values()]))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_terms), pa.int32()), flat)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, n), pa.int32()), inner)
            whole = pa.Table.from_batches([row for row, _ in held.values()]) if keys else None
            own = [whole.column(k).combine_chunks() for k in keys] if keys else []
            return pa.RecordBatch.from_arrays([*own, outer], names=[*keys, "_sums"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups, first, sums = _group_sums(batch, n_terms, n)
            for name, at, own in zip(groups, first, sums):
                if name in held:
                    held[name][1][:] += own
                    continue
                if len(held) == KEYS_HELD:
                    yield packed()
                    held.clear()
                key_row = batch.select(keys).take(pa.array([at])) if keys else batch.slice(0, 0)
                held[name] = (key_row, own.copy())
        if held:
            yield packed()

    schema = StructType([rows.schema[k] for k in keys]).add("_sums", ArrayType(ArrayType(DoubleType())))
    per_task = rows.mapInArrow(add_up, schema)
    spread = per_task.select(*keys, F.posexplode("_sums").alias("_at", "_row"))
    merged = spread.groupBy(*keys, (F.col("_at") + 1).cast("bigint").alias("replicate")).agg(
        *[F.sum(F.col("_row")[i]).alias(f"_s{i}") for i in range(n_terms)]
    )
    values = [metrics[m].value({t: F.col(f"_s{i}") for t, i in place[m].items()}).alias(m) for m in metrics]
    return merged.filter(F.col("_s0") > 0).select(*keys, "replicate", *values)


def bootstrap_intervals(
    df: DataFrame,
    row_key: Sequence[str],
    metrics: Mapping[str, SumMetric],
    keys: Sequence[str] = (),
    n: int = 500,
    seed: int = 0,
    alpha: float = 0.05,
) -> DataFrame:
    """Per key, ``<metric>_low`` and ``<metric>_high`` of each metric and the number of replicates that have rows."""
    values = bootstrap_sums(df, row_key, metrics, keys, n, seed)
    tails = (("low", alpha / 2), ("high", 1 - alpha / 2))
    bounds = [F.percentile(m, F.lit(q)).alias(f"{m}_{t}") for m in metrics for t, q in tails]
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), *bounds)
