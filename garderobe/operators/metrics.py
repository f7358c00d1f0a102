"""Tie-aware ranking metrics, calibration, thresholds and bootstrap intervals over (label, score)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions.lookup import hash_int
from garderobe.session import cut_lineage

#: Rows aimed at in a score range.
RANGE_ROWS = 200_000


def by_ranges(df: DataFrame, order: Sequence[str], name: str, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` with the number of its range in the order of ``order``; equal values share a range.

    Spark cuts the ranges, as many as the rows call for, so nothing but a count comes to the driver. The result is
    written: a second cut could fall elsewhere.
    """
    n = -(-(df.count() if rows is None else rows) // (size or RANGE_ROWS))
    return cut_lineage(df.repartitionByRange(max(1, n), *order).withColumn(name, F.spark_partition_id()))


def running_counts(
    df: DataFrame,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    weight: Column | None = None,
) -> DataFrame:
    """One row per key and distinct score, highest first, with cumulative positives ``tp`` and negatives ``fp``.

    Ties are merged by the first aggregate. The running sums never put one key's scores into one task: they run inside
    ranges of (key, score) and are shifted by the totals of the key's higher ranges, at most as many rows as there are
    keys and ranges. Rows without a score are left out.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    per_score = cut_lineage(
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, score)
        .agg(
            F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("double").alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).cast("double").alias("neg"),
        )
    )
    ranged = by_ranges(per_score, [*keys, score], "_range")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    higher = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    shift = totals.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_p").over(higher), F.lit(0.0)).alias("_tp"),
        F.coalesce(F.sum("_n").over(higher), F.lit(0.0)).alias("_fp"),
        F.sum("_p").over(whole).alias("positives"),
        F.sum("_n").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("_otp", F.sum("pos").over(inside)).withColumn("_ofp", F.sum("neg").over(inside))
    return own.join(shift, [*keys, "_range"]).select(
        *keys,
        F.col(score).alias("score"),
        "pos",
        "neg",
        (F.col("_otp") + F.col("_tp")).alias("tp"),
        (F.col("_ofp") + F.col("_fp")).alias("fp"),
        "positives",
        "negatives",
    )


def ranking_metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, average precision, best-F1 threshold and the TPR - FPR cut from running counts.

    AUC and AP are null and the F1 threshold is 0.5 when a key has one class only.
    """
    c = F.col
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    concordant = F.sum(c("neg") * (c("tp") - c("pos") + c("pos") / 2))
    precision = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    recall = F.when(c("positives") > 0, c("tp") / c("positives")).otherwise(0.0)
    gain = F.when(c("positives") > 0, c("pos") / c("positives")).otherwise(0.0)
    f1 = F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    fpr = F.when(c("negatives") > 0, c("fp") / c("negatives")).otherwise(0.0)
    best_f1 = F.max(F.struct(F.round(f1, 12).alias("f1"), (-c("score")).alias("neg_score")))
    best_cut = F.max(F.struct(F.round(recall - fpr, 12).alias("gap"), (-c("score")).alias("neg_score"), recall.alias("tpr"), fpr.alias("fpr")))
    return (
        counts.groupBy(*keys)
        .agg(
            both.alias("_both"),
            F.max("positives").cast("bigint").alias("positives"),
            F.max("negatives").cast("bigint").alias("negatives"),
            F.try_divide(concordant, F.max("positives") * F.max("negatives")).alias("_auc"),
            F.sum(gain * precision).alias("_ap"),
            best_f1.alias("_f1"),
            best_cut.alias("_cut"),
        )
        .select(
            *keys,
            "positives",
            "negatives",
            F.when(c("_both"), c("_auc")).alias("roc_auc"),
            F.when(c("_both"), c("_ap")).alias("pr_auc"),
            F.when(c("_both"), -c("_f1.neg_score")).otherwise(0.5).alias("best_f1_threshold"),
            F.when(c("_both"), c("_f1.f1")).alias("best_f1"),
            (-c("_cut.neg_score")).alias("cut"),
            c("_cut.tpr").alias("cut_tpr"),
            c("_cut.fpr").alias("cut_fpr"),
        )
    )


def roc_auc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    return ranking_metrics(running_counts(df, keys, score, label), keys).select(*keys, "positives", "negatives", "roc_auc")


def classification_metrics(
    df: DataFrame, keys: Sequence[str] = (), threshold: float | Column = 0.5, probabilistic: bool = True
) -> DataFrame:
    """Thresholded metrics in one pass; ratios with a zero denominator are 0."""
    hit = F.col("score") >= threshold
    positive = F.col("label") == 1
    tp, fp = F.count_if(hit & positive), F.count_if(hit & ~positive)
    fn, tn = F.count_if(~hit & positive), F.count_if(~hit & ~positive)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    parts = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("positives"),
        F.avg(positive.cast("double")).alias("positive_rate"),
        ratio(tp + tn, F.count(F.lit(1))).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]
    if probabilistic:
        gap = F.col("score") - F.col("label")
        parts.append(F.avg(gap * gap).alias("brier"))
    return df.groupBy(*keys).agg(*parts)


def calibration_bin(score: Column, bins: int = 10) -> Column:
    """Index of the equal-width bin: how many inner edges are at or below the score."""
    edges = [F.when(score >= i * (1.0 / bins), 1).otherwise(0) for i in range(1, bins)]
    return sum(edges[1:], edges[0])


def calibration_error(df: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    keys = list(keys)
    binned = (
        df.groupBy(*keys, calibration_bin(F.col("score"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("hit"), F.avg("score").alias("mean"))
    )
    weighted = F.sum(F.col("n") * F.abs(F.col("hit") - F.col("mean"))) / F.sum("n")
    return binned.groupBy(*keys).agg(weighted.alias("ece"))


def auc_by_group(df: DataFrame, group: str, min_each: int = 30) -> DataFrame:
    return roc_auc(df, [group]).filter((F.col("positives") >= min_each) & (F.col("negatives") >= min_each))


def auc_vs_kind(df: DataFrame, kind: str) -> DataFrame:
    """All positives against one kind of negative; no row when either side is empty."""
    part = df.filter((F.col("label") == 1) | (F.col("kind") == kind))
    return roc_auc(part).filter((F.col("positives") > 0) & (F.col("negatives") > 0))


# ------------------------------------------------------------------ bootstrap
def poisson_cuts(terms: int = 13) -> list[float]:
    """Cumulative probabilities of Poisson(1)."""
    steps = [math.exp(-1) / math.factorial(k) for k in range(terms)]
    return [sum(steps[: k + 1]) for k in range(terms)]


#: Modulus of the weight hash: 2^31 - 1, a prime; products of two residues fit into 64 bits.
PRIME = 2_147_483_647
#: Replicates whose weights are in memory at once.
REPLICATE_BLOCK = 50
#: Rows aimed at in a range of the bootstrap; with a block of replicates they are some 20 MB a matrix.
BOOTSTRAP_ROWS = 50_000
#: Rows whose hashes are worked on at once.
HASHED_ROWS = 1_024


def _first_residue(cut: float) -> int:
    """The smallest residue whose uniform reaches ``cut``."""
    r = int(cut * PRIME)
    while r and (r - 1) / float(PRIME) >= cut:
        r -= 1
    while r / float(PRIME) < cut:
        r += 1
    return r


_STEPS = np.array([_first_residue(c) for c in poisson_cuts()], dtype=np.int64)
#: Weight by the upper 16 bits of a residue; -1 where they don't tell.
_WEIGHT = np.searchsorted(_STEPS, np.arange(1 << 16, dtype=np.int64) << 15, side="right").astype(np.int32)
_WEIGHT[_STEPS[_STEPS < PRIME] >> 15] = -1


def replicate_weights(h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weights (rows, replicates): the number of cumulative probabilities at or below a hashed uniform.

    That is the distributed form of resampling with replacement: the replicate size is not fixed, but no row has to
    know the others and every engine computes the same weights. The uniform of a row in a replicate is a linear hash
    of the row's number ``h``, modulo a prime.
    """
    times = 1 + (replicates * 1_103_515_245 + 12_345) % (PRIME - 1)
    plus = (replicates * 69_069 + 362_437) % PRIME
    out = np.empty((len(h), len(replicates)), dtype=np.int32)
    for at in range(0, len(h), HASHED_ROWS):
        x = h[at : at + HASHED_ROWS, None] * times + plus
        for _ in range(2):  # 2^31 is 1 modulo the prime
            x = (x & PRIME) + (x >> 31)
        np.subtract(x, PRIME, out=x, where=x >= PRIME)
        w = _WEIGHT[x >> 15]
        unsure = w < 0
        w[unsure] = np.searchsorted(_STEPS, x[unsure], side="right")
        out[at : at + HASHED_ROWS] = w
    return out


@dataclass
class _Ties:
    """Rows by score, highest first, and where each distinct score starts."""

    h: np.ndarray
    positive: np.ndarray
    starts: np.ndarray
    scores: np.ndarray

    def sums(self, replicates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted positives and negatives per distinct score and replicate."""
        weights = replicate_weights(self.h, replicates)
        whole = np.add.reduceat(weights, self.starts, axis=0)
        weights *= self.positive
        pos = np.add.reduceat(weights, self.starts, axis=0)
        return pos.astype(float), (whole - pos).astype(float)

    def inner(self) -> _Ties:
        """Without the rows of the first and the last score."""
        if len(self.starts) < 3:
            return _Ties(self.h[:0], self.positive[:0], self.starts[:0], self.scores[:0])
        a, b = self.starts[1], self.starts[-1]
        return _Ties(self.h[a:b], self.positive[a:b], self.starts[1:-1] - a, self.scores[1:-1])


def _ties(rows: pd.DataFrame) -> _Ties:
    score = rows["score"].to_numpy()
    order = np.argsort(score, kind="stable")[::-1]
    score = score[order]
    new = (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))
    starts = np.flatnonzero(np.append(True, new))
    positive = (rows["label"].to_numpy()[order] == 1).astype(np.int32)[:, None]
    return _Ties(rows["h"].to_numpy()[order], positive, starts, score[starts])


def bootstrap_values(
    df: DataFrame, row_key: Sequence[str], scores: Sequence[str], n: int = 500, seed: int = 0
) -> DataFrame:
    """ROC-AUC and average precision per replicate and score column, on the same weights for every column.

    The rows travel once, cut by ranges of (score, row), so that a score of very many rows lies in several ranges and no
    range is large; the weights of all replicates are made where a range is. A first pass gives totals per replicate of
    each range's highest score, its lowest score and what is between. Only the two outer scores can go on in other
    ranges: they are added up there, one step of the curve each. A second pass adds up the steps between, with
    the totals of all higher scores. Shuffled between them are at most three numbers per range and replicate and class.
    """
    h = F.pmod(hash_int(F.concat_ws(":", F.lit(str(seed)), F.concat_ws("|", *row_key)), 8), F.lit(PRIME)).alias("h")
    long = df.select(
        F.col("label").cast("int").alias("label"),
        h,
        F.explode(F.create_map(*[x for s in scores for x in (F.lit(s), F.col(s).cast("double"))])).alias("scorer", "score"),
    ).filter(F.col("score").isNotNull())
    long = cut_lineage(long.withColumn("row", F.monotonically_increasing_id()))
    ranged = by_ranges(long, ["scorer", "score", "row"], "range", size=min(RANGE_ROWS, BOOTSTRAP_ROWS)).drop("row")
    blocks = np.array_split(np.arange(1, n + 1, dtype=np.int64), max(1, -(-n // REPLICATE_BLOCK)))
    keys = ["scorer", "range"]

    def totals(key, rows: pd.DataFrame) -> pd.DataFrame:
        ties, out = _ties(rows), []
        last = len(ties.starts) - 1
        parts = [(0, 0, 1)] + ([(0, last, last + 1)] if last > 0 else []) + ([(1, 1, last)] if last > 1 else [])
        for block in blocks:
            pos, neg = ties.sums(block)
            for between, a, b in parts:
                at = ties.scores[0 if between else a]
                sums = {"pos": pos[a:b].sum(axis=0), "neg": neg[a:b].sum(axis=0)}
                out.append(pd.DataFrame({"between": between, "score": at, "replicate": block, **sums}))
        return pd.concat(out).assign(scorer=key[0], range=key[1])

    sums = ranged.groupBy(*keys).applyInPandas(totals, "scorer string, range int, between int, score double, replicate long, pos double, neg double")
    # What is between the outer scores of a range comes right after the highest one.
    steps = sums.groupBy("scorer", "score", "between", "replicate").agg(F.max("range").alias("range"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    higher = Window.partitionBy("scorer", "replicate").orderBy(F.col("score").desc(), "between").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("scorer", "replicate")
    curved = cut_lineage(
        steps.withColumns(
            {
                "tp": F.coalesce(F.sum("pos").over(higher), F.lit(0.0)),
                "fp": F.coalesce(F.sum("neg").over(higher), F.lit(0.0)),
                "positives": F.sum("pos").over(whole),
                "negatives": F.sum("neg").over(whole),
            }
        )
    )

    def curve(key, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("replicate").reset_index(drop=True)
        ties, out = _ties(rows).inner() if len(rows) and len(given) else None, []
        for block in blocks if ties is not None else []:
            pos, neg = ties.sums(block)
            at = given.iloc[block - 1]
            tp, fp = pos.cumsum(axis=0) + at["tp"].to_numpy(), neg.cumsum(axis=0) + at["fp"].to_numpy()
            good = (neg * (tp - pos / 2)).sum(axis=0)
            precision = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
            out.append(pd.DataFrame({"replicate": block, "good": good, "gained": (pos * precision).sum(axis=0), "positives": at["positives"].to_numpy(), "negatives": at["negatives"].to_numpy()}))
        empty = pd.DataFrame({c: [] for c in ("replicate", "good", "gained", "positives", "negatives")})
        return pd.concat(out).assign(scorer=key[0]) if out else empty.assign(scorer="")

    schema = "scorer string, replicate long, good double, gained double, positives double, negatives double"
    ahead = curved.filter("between = 1").select(*keys, "replicate", "tp", "fp", "positives", "negatives")
    parts = ranged.groupBy(*keys).cogroup(ahead.groupBy(*keys)).applyInPandas(curve, schema)
    tp, fp = F.col("tp") + F.col("pos"), F.col("fp") + F.col("neg")
    single = curved.filter("between = 0").select(
        "scorer",
        "replicate",
        (F.col("neg") * (tp - F.col("pos") / 2)).alias("good"),
        F.when(tp + fp > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0).alias("gained"),
        "positives",
        "negatives",
    )
    added = parts.unionByName(single).groupBy("scorer", "replicate").agg(*[F.sum(c).alias(c) for c in ("good", "gained")], *[F.max(c).alias(c) for c in ("positives", "negatives")])
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return added.select(
        "scorer",
        "replicate",
        F.when(both, F.col("good") / (F.col("positives") * F.col("negatives"))).alias("roc_auc"),
        F.when(both, F.col("gained") / F.col("positives")).alias("pr_auc"),
    )


def bootstrap_metric(df: DataFrame, row_key: Sequence[str], metric: Callable[[DataFrame, Sequence[str], Column], DataFrame], n: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval of any metric: ``metric(rows, keys, weight)`` gives (keys, value) from rows weighted by ``weight``.

    Every row becomes a row per replicate, so this is for metrics that the ranged plan of :func:`bootstrap_values`
    doesn't cover.
    """
    h = F.pmod(hash_int(F.concat_ws(":", F.lit(str(seed)), F.concat_ws("|", *row_key)), 8), F.lit(PRIME))
    rows = df.withColumn("_h", h).withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n))))
    times = F.lit(1) + (F.col("replicate") * 1_103_515_245 + 12_345) % (PRIME - 1)
    plus = (F.col("replicate") * 69_069 + 362_437) % PRIME
    rows = rows.withColumn("_u", ((F.col("_h") * times + plus) % PRIME) / F.lit(float(PRIME)))
    cuts = poisson_cuts()
    over = [F.when(F.col("_u") >= c, 1).otherwise(0) for c in cuts]
    rows = rows.filter(F.col("_u") >= cuts[0]).withColumn("w", sum(over[1:], over[0])).drop("_u", "_h")
    values = metric(rows, ["replicate"], F.col("w"))
    return values.agg(F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_ci(
    df: DataFrame, row_key: Sequence[str], scores: Sequence[str] = ("score",), n: int = 500, seed: int = 0, alpha: float = 0.05
) -> DataFrame:
    values = bootstrap_values(df, row_key, scores, n, seed).filter(F.col("roc_auc").isNotNull())
    bounds = [(m, tail) for m in ("roc_auc", "pr_auc") for tail in ("low", "high")]
    share = {"low": alpha / 2, "high": 1 - alpha / 2}
    return values.groupBy("scorer").agg(
        F.count(F.lit(1)).alias("replicates"), *[F.percentile(m, F.lit(share[t])).alias(f"{m}_{t}") for m, t in bounds]
    )


def paired_bootstrap_auc_diff(
    df: DataFrame, row_key: Sequence[str], a: str, b: str, n: int = 500, seed: int = 0
) -> DataFrame:
    """AUC(a) - AUC(b) with a 95% interval on shared replicates; ``beats`` when the interval is above zero."""
    values = bootstrap_values(df, row_key, [a, b], n, seed).filter(F.col("roc_auc").isNotNull())
    sign = F.when(F.col("scorer") == a, F.col("roc_auc")).otherwise(-F.col("roc_auc"))
    diffs = values.groupBy("replicate").agg(F.sum(sign).alias("d"))
    point = long_auc(df, [a, b])
    difference = point.agg(
        (F.max(F.when(F.col("scorer") == a, F.col("roc_auc"))) - F.max(F.when(F.col("scorer") == b, F.col("roc_auc")))).alias("difference")
    )
    interval = diffs.agg(F.percentile("d", F.lit(0.025)).alias("ci95_low"), F.percentile("d", F.lit(0.975)).alias("ci95_high"))
    # Both sides are one row by construction.
    return difference.join(interval).withColumn("beats", F.coalesce(F.col("ci95_low") > 0, F.lit(False)))


def long_auc(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    long = df.select(
        "label", F.explode(F.create_map(*[x for s in scores for x in (F.lit(s), F.col(s).cast("double"))])).alias("scorer", "score")
    )
    return ranking_metrics(running_counts(long, ["scorer"]), ["scorer"])


def baseline_comparison(df: DataFrame, scores: Sequence[str], random_name: str = "random") -> DataFrame:
    """Ranking quality of several scorers on the same pairs; marks the strongest non-random one."""
    table = long_auc(df, scores).select("scorer", "positives", "negatives", "roc_auc", "pr_auc")
    best = table.filter(F.col("scorer") != random_name).agg(F.max_by("scorer", F.col("roc_auc")).alias("_best"))
    return table.join(best).withColumn("strongest", F.col("scorer") == F.col("_best")).drop("_best")


# ------------------------------------------------------------------ fill in the blank
def next_prime(n: int) -> int:
    """Smallest prime from ``n`` on."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def fitb_questions(members: DataFrame, usable: DataFrame, distractors: int = 3, seed: int = 42) -> DataFrame:
    """One question per outfit: a hidden member and hash-drawn distractors from outside the outfit.

    ``members(split, set_id, ord, item_id)``; only ``usable(item_id)`` items count. Candidate 0 is the answer.
    Distractors are drawn without replacement from the densely numbered item pool, for each question on its own: places
    ``start + try * step`` modulo the next prime, both drawn, visit every place once, and any two places are equally likely to come
    together. As many are taken as wanted and as the outfit has items there, so that enough remain when its own are left out.
    """
    from garderobe.operators.spread import numbered

    keys = ["split", "set_id"]
    own = members.join(usable.select("item_id").distinct(), "item_id", "left_semi")
    blank_key = F.struct(F.sha1(F.concat_ws(":", F.lit(f"{seed}:blank"), "set_id", "item_id")).alias("h"), F.col("item_id").alias("item_id"))
    blanks = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_usable"), F.min(blank_key)["item_id"].alias("answer"))
    pool = own.select("split", "item_id").distinct()
    prime = F.udf(next_prime, "bigint")  # one call per split
    n_pool = pool.groupBy("split").agg(F.count(F.lit(1)).alias("n_pool")).withColumn("_p", prime("n_pool"))
    questions = blanks.join(n_pool, "split").filter(
        (F.col("n_usable") >= 2) & (F.col("n_pool") > distractors + F.col("n_usable"))
    )
    indexed = numbered(pool, ["split"], ["item_id"], "_i", ["item_id"])
    start, step = (F.pmod(hash_int(F.concat_ws(":", F.lit(f"{seed}:{tag}"), "set_id"), 15), m) for tag, m in (("distractor", F.col("_p")), ("step", F.col("_p") - 1)))
    wanted = F.col("n_usable") + F.lit(distractors)
    drawn = questions.withColumn("_start", start).withColumn("_step", step + 1)
    # At most prime - n_pool places lie outside of the pool.
    tries = F.sequence(F.lit(0).cast("bigint"), wanted + F.col("_p") - F.col("n_pool") - 1)
    places = F.transform(tries, lambda t: F.struct(t.alias("_try"), (F.pmod(F.col("_start") + t * F.col("_step"), F.col("_p")) + 1).alias("_i")))
    inside = F.slice(F.filter(places, lambda x: x["_i"] <= F.col("n_pool")), F.lit(1), wanted.cast("int"))
    draws = drawn.select(*keys, F.inline(inside)).join(indexed, ["split", "_i"])
    outside = draws.join(members.select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
    first = outside.groupBy(*keys, "item_id").agg(F.min("_try").alias("_try"))
    order = Window.partitionBy(*keys).orderBy("_try")
    picked = first.withColumn("candidate", F.row_number().over(order)).filter(F.col("candidate") <= distractors)
    answers = questions.select(*keys, F.col("answer").alias("item_id"), F.lit(0).alias("candidate"))
    return answers.unionByName(picked.select(*keys, "item_id", "candidate")).join(questions.select(*keys, "answer"), keys)


def fitb_accuracy(scored: DataFrame, distractors: int = 3) -> DataFrame:
    """Share of questions whose answer has the best mean score; ties favour the answer.

    ``scored(split, set_id, candidate, score)`` has one row per candidate and remaining member.
    """
    keys = ["split", "set_id"]
    means = scored.groupBy(*keys, "candidate").agg(F.avg("score").alias("mean"))
    best = means.groupBy(*keys).agg(F.max(F.struct(F.round("mean", 12).alias("m"), (-F.col("candidate")).alias("c"))).alias("b"))
    return best.groupBy("split").agg(
        F.avg((F.col("b.c") == 0).cast("double")).alias("fitb_accuracy"),
        F.count(F.lit(1)).alias("questions"),
        F.lit(1.0 / (1 + distractors)).alias("chance"),
    )
