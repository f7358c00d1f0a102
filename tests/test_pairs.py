"""The step that many queries share: features and scores of all pairs of a wardrobe."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.functions import style
from garderobe.operators import models as mo
from garderobe.operators import pairs as pr
from tests.test_outfits import COUNTS29, wardrobe

BASE = v.PAIR_MODELS["baseline"]
#: Longer methods are never compiled by the JVM.
COMPILED_BYTES = 8000


def plan(df, mode):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def method_sizes(df_of, spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan(df_of(), "codegen"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def labelled(items):
    inputs = pr.pair_inputs(items)
    return pr.pair_features(pr.item_pairs(inputs, inputs, ["wardrobe_id"], lambda a, b: pr.earlier(a, b) & (a("slot") != b("slot"))))


@pytest.mark.parametrize("job", ["summary", "moments"])
def test_the_methods_of_a_pair_are_short_enough_to_be_compiled(spark, job):
    items = wardrobe(spark, COUNTS29)

    def df():
        return pr.pair_summary(items, BASE) if job == "summary" else mo.feature_moments(labelled(items), v.FEATURES_BASELINE)

    sizes = method_sizes(df, spark)
    assert sizes and max(sizes) < COMPILED_BYTES


def test_moments_read_the_pairs_once(spark):
    values = [0.5, None, 2.0, 3.5, None, -1.0]
    pairs = spark.createDataFrame([(x, float(i), None) for i, x in enumerate(values)], "x double, y double, z double")
    out = mo.feature_moments(pairs, ["x", "y", "z"])
    assert "Join" not in plan(out, "simple")
    rows = {r.feature: r for r in out.collect()}
    known = [x for x in values if x is not None]
    full = [np.mean(known) if x is None else x for x in values]
    assert rows["x"].impute == pytest.approx(np.mean(known)) and rows["x"].mean == pytest.approx(np.mean(full))
    assert rows["x"].scale == pytest.approx(np.std(full) + 1e-9)
    assert rows["y"].scale == pytest.approx(np.std(range(6)) + 1e-9)
    assert (rows["z"].impute, rows["z"].mean, rows["z"].scale) == (None, None, None)
    empty = mo.feature_moments(pairs.limit(0), ["x"]).collect()
    assert [(r.impute, r.mean, r.scale) for r in empty] == [(None, None, None)]


def test_style_similarity_of_odd_distributions(spark):
    whole = [0.1, 0.2, 0.05, 0.15, 0.2, 0.2, 0.1]
    odd = [whole, [0.3, None, 0.7, 0.0, 0.0, 0.0, 0.0], [0.5, 0.5], [], [*whole, 0.9], [-0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0], None]
    rows = [(i, j, a, b) for i, a in enumerate(odd) for j, b in enumerate(odd)]
    df = spark.createDataFrame(rows, "i int, j int, a array<double>, b array<double>")
    got = {(r.i, r.j): r.s for r in df.select("i", "j", style.style_similarity(F.col("a"), F.col("b")).alias("s")).collect()}

    def at(x, k):
        return max(x[k] or 0.0, 0.0) if k < len(x) else 0.0

    for i, j, a, b in rows:
        if a is None or b is None:
            assert got[i, j] is None
        else:
            want = math.sqrt(at(a, 0) * at(b, 0))
            for k in range(1, 7):
                want += math.sqrt(at(a, k) * at(b, k))
            assert got[i, j] == want


def test_signals_are_named_after_the_ranking(spark):
    items = wardrobe(spark, COUNTS29)
    best = pr.recommend_for_item(items, BASE, k=2, style_name="formal")
    text = best._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("array_sort") < text.index("Window")
    every = pr.recommend_for_item(items, BASE, style_name="formal").filter("position <= 2")
    assert sorted(best.collect()) == sorted(every.collect())
