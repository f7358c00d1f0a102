"""Arrivals with state and the served network against plain versions."""

import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.operators import compat
from garderobe.operators import models as mo
from garderobe.plans.generate import generate_outfits
from garderobe.streaming import state
from tests.test_outfits import BASE, COUNTS29, wardrobe

SCHEMA = "wardrobe_id long, category string, item_id string, created_at timestamp_ntz, embedding array<float>"


def arrivals(n=150, dim=6):
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        vec = rng.normal(size=dim) if i < 20 or i % 3 else np.array(rows[i - 20][4] or np.ones(dim)) + rng.normal(size=dim) * 0.08
        vec = [float(np.float32(x)) for x in vec / np.linalg.norm(vec)]
        when = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i // 2)
        rows.append((i % 2, ("top", "shoes")[i % 5 == 0], f"i{i:04d}", when, None if i % 31 == 7 else vec))
    return rows


def twins_before(rows):
    out = {}
    for r in rows:
        near = [] if r[4] is None else [q for q in rows if q[4] is not None and q[:2] == r[:2] and (q[3], q[2]) < (r[3], r[2]) and float(np.dot(q[4], r[4])) >= v.DUPLICATE_COSINE]
        out[r[2]] = (len(near), min(((q[3], q[2]) for q in near), default=(None, None))[1])
    return out


@pytest.mark.parametrize("files,axes", [(1, 2), (10, 2), (3, 1)])
def test_flags_do_not_depend_on_the_cut(spark, tmp_path, files, axes):
    rows = arrivals()
    want = twins_before(rows)
    assert sum(n > 0 for n, _ in want.values()) > 20
    source = str(tmp_path / "in")
    for i in range(files):
        spark.createDataFrame(rows[i * len(rows) // files : (i + 1) * len(rows) // files], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    got = spark.read.parquet(state.stream_arrivals(stream, spark, axes=axes)).collect()
    assert len(got) == len(rows) and {r.item_id: (r.possible_duplicates, r.possible_duplicate_of) for r in got} == want


def test_exported_network_equals_the_fitted_one(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(a @ b > 0), a.tolist(), b.tolist()) for a, b in zip(rng.normal(size=(80, 3)), rng.normal(size=(80, 3)))]
    pairs = spark.createDataFrame(rows, "label int, va array<double>, vb array<double>")
    train = pairs.select(F.col("label").cast("double").alias("label"), mo._pair_vector("va", "vb").alias("x"))
    fitted = Pipeline(stages=[MultilayerPerceptronClassifier(featuresCol="x", layers=[12, 4, 3, 2], maxIter=8, seed=1)]).fit(train)
    want = [r.score for r in mo.predict_symmetric(fitted, pairs.orderBy("va")).orderBy("va").select("score").collect()]
    net = compat.exported(fitted, "m", 3)
    compat.save_network(spark, net, str(tmp_path / "net"))
    for same in (net, compat.load_network(spark, str(tmp_path / "net"))):
        learned = compat.served(spark, same, "m", 3)
        got = [r.p for r in pairs.withColumn("p", learned("va", "vb")).orderBy("va").select("p").collect()]
        assert np.allclose(got, want, atol=1e-9)


def test_gate_keeps_a_network_out(spark):
    net = compat.Network(((np.zeros((2, 12)), np.zeros(2)),), "m", 3)
    assert compat.served(spark, net, "m", 3) is not None
    for args in ((None, "m", 3), (net, "other", 3), (net, "m", 4), (net, "m", 3, False)):
        assert compat.served(spark, *args) is None and compat.variant_for(None) == "baseline"


def test_network_steers_the_outfits(spark):
    """A network that likes large first components changes what comes first; the learned model is used throughout."""
    items = wardrobe(spark, {k: n for k, n in COUNTS29.items() if k not in ("one_piece", "accessory")}, seed=9)
    weights = np.zeros((2, 64))
    weights[1, [0, 16]] = 8.0
    learned = compat.served(spark, compat.Network(((weights, np.array([0.0, -3.0])),), "m", 16), "m", 16)
    job = generate_outfits(items, "m", 16, v.PAIR_MODELS["with_learned"], k=1, threshold=0.0, learned=learned)
    best = {g["item_id"] for g in job.chosen.first()["core"]}
    first = {r.item_id: r.embedding[0] for r in items.select("item_id", "embedding").collect()}
    mean = np.mean([first[i] for i in best])
    plain = generate_outfits(items, "m", 16, BASE, k=1, threshold=0.0).chosen.first()["core"]
    assert mean > np.mean(list(first.values())) and mean >= np.mean([first[g["item_id"]] for g in plain])
    assert "learned" in " ".join(job.explained.first()["reasons"] + job.explained.first()["caveats"]).lower()
