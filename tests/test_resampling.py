"""Bootstrap of metrics from sums against the plan with a row per replicate and against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe.operators import metrics as m
from garderobe.operators import resampling as rs


def rows(n=240):
    rng = np.random.default_rng(5)
    keys = ("a", "b", None)
    return [(i, keys[i % 3], int(rng.random() < 0.4), round(float(rng.random()), 3)) for i in range(n)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(rows(), "id long, grp string, label int, score double").repartition(5)


def test_same_interval_as_a_row_per_replicate(table):
    def weighted_brier(part, keys, w):
        gap = F.col("score") - F.col("label")
        return part.groupBy(*keys).agg((F.sum(w * gap * gap) / F.sum(w)).alias("value"))

    want = m.bootstrap_metric(table, ["id"], weighted_brier, n=40).first()
    got = rs.bootstrap_intervals(table, ["id"], {"brier": rs.brier()}, n=40).first()
    assert (got.replicates, got.brier_low, got.brier_high) == (40, pytest.approx(want.low), pytest.approx(want.high))


def test_values_per_key_against_a_loop(spark, table, monkeypatch):
    got = rs.bootstrap_sums(table, ["id"], {"f1": rs.f1(0.4), "brier": rs.brier()}, ["grp"], n=60)
    found = {(r.grp, r.replicate): (r.f1, r.brier) for r in got.collect()}
    assert len(found) == 3 * 60
    hashed = {r.id: r.h for r in table.select("id", F.pmod(m.hash_int(F.concat_ws(":", F.lit("0"), F.col("id").cast("string")), 8), F.lit(m.PRIME)).alias("h")).collect()}
    for key in ("a", "b", None):
        part = [r for r in rows() if r[1] == key]
        w = m.replicate_weights(np.array([hashed[r[0]] for r in part]), np.arange(1, 61))
        y, s = (np.array([r[i] for r in part]) for i in (2, 3))
        hit = s >= 0.4
        for k in range(60):
            tp, wrong = (w[:, k] * (hit & (y == 1))).sum(), (w[:, k] * (hit != (y == 1))).sum()
            value = (2 * tp / (2 * tp + wrong), (w[:, k] * (s - y) ** 2).sum() / w[:, k].sum())
            assert found[key, k + 1] == pytest.approx(value)


def test_many_keys_few_held_and_no_rows(spark, table, monkeypatch):
    metrics = {"brier": rs.brier()}
    many = table.withColumn("grp", F.col("id") % 50).withColumn("_extra", F.lit(1))
    want = {tuple(r) for r in rs.bootstrap_intervals(many, ["id"], metrics, ["grp"], n=20).select("grp", F.round("brier_low", 9)).collect()}
    monkeypatch.setattr(rs, "KEYS_HELD", 3)
    assert {tuple(r) for r in rs.bootstrap_intervals(many, ["id"], metrics, ["grp"], n=20).select("grp", F.round("brier_low", 9)).collect()} == want
    assert len(want) == 50
    assert rs.bootstrap_sums(table.filter("id < 0"), ["id"], metrics, ["grp"], n=20).count() == 0
