"""Outfit job on small wardrobes, checked by counting and brute force."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.operators import duplicates as d
from garderobe.operators import outfits as o
from garderobe.operators import wardrobe as w
from garderobe.operators.spread import numbered, pair_join
from garderobe.plans.generate import generate_outfits

BASE = v.PAIR_MODELS["baseline"]
SCHEMA = (
    "wardrobe_id long, item_id string, created_at timestamp_ntz, category string, label string, review_status string, confidence double, "
    "colors array<struct<name:string,hex:string,fraction:double>>, source_image string, bbox struct<x1:int,y1:int,x2:int,y2:int>, "
    "embedding_model string, embedding_dim int, embedding array<float>, style_scores array<double>, style string"
)


def wardrobe(spark, counts, seed=0, wid=1, dim=16):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for slot, k in counts.items():
        for _ in range(k):
            vec = rng.normal(size=dim) + 1.5
            vec /= np.linalg.norm(vec)
            p = rng.random(7)
            p /= p.sum()
            when = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)
            rows.append(
                (wid, f"w{wid}i{n:03d}", when, slot, f"{slot} {n}", "auto", 0.8, [("red", "#d01c1c", 1.0)], None, None, "m", dim,
                 [float(x) for x in vec], [float(x) for x in p], v.STYLES[int(p.argmax())])
            )
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


COUNTS29 = {"top": 8, "bottom": 6, "shoes": 5, "outerwear": 4, "one_piece": 3, "accessory": 3}


def pool(spark, items, **kw):
    return o.outfit_pool(w.eligible_items(items, "m", None).filter("reason is null"), **kw)


def test_29_items_give_255_core_combinations(spark):
    items = wardrobe(spark, COUNTS29)
    job = generate_outfits(items, "m", 16, BASE, k=10, threshold=0.0)
    row = job.funnel.collect()[0]
    assert row.core_combinations == 255 and row.structural_combinations == 255 * 5 * 4
    assert row.candidates_scored == 255 and row.rejected_by_validity == 0
    assert row.returned == 10 and row.unique_items_in_results > 10
    shown = job.chosen.select("choice", F.transform("core", lambda g: g["item_id"]).alias("c")).collect()
    for x, y in itertools.combinations([set(r.c) for r in shown], 2):
        assert len(x & y) / max(len(x), len(y)) <= v.MAX_SHARED_CORE + 1e-9


def test_pruning_keeps_five_per_slot(spark):
    items = wardrobe(spark, {"top": 12, "bottom": 12, "shoes": 12})
    cands, _, report = o.build_candidates(pool(spark, items), BASE, limit=200)
    assert cands.count() <= 125
    row = report.collect()[0]
    assert (row.before, row.kept_per_slot) == (1728, 5)


def test_greedy_selection_equals_brute_force(spark):
    items = wardrobe(spark, COUNTS29, seed=5)
    cands, _, _ = o.build_candidates(pool(spark, items), BASE)
    ranked = o.rank_candidates(cands)
    place = {tuple(g.item_id for g in r.members): r.position for r in ranked.collect()}
    got = [place[tuple(g.item_id for g in r.members)] for r in o.diverse_topk(cands, 8).orderBy("choice").collect()]
    rows = sorted(ranked.collect(), key=lambda r: r.position)
    core = [{g.grp for g in r.core} for r in rows]
    look = [{g.grp for g in r.members} for r in rows]
    share = lambda x, y: len(x & y) / max(len(x), len(y))
    chosen = []
    while len(chosen) < 8:
        best = None
        for i, r in enumerate(rows):
            if i in chosen or any(share(core[i], core[j]) > 0.5 + 1e-9 for j in chosen):
                continue
            value = r["rank"] - 0.6 * max([share(look[i], look[j]) for j in chosen], default=0)
            if best is None or value > best[0]:
                best = (value, i)
        if best is None:
            break
        chosen.append(best[1])
    assert got == [rows[i].position for i in chosen]


def test_forced_layer_and_switches(spark):
    items = wardrobe(spark, COUNTS29)
    want = items.filter("category = 'outerwear'").limit(1).select("wardrobe_id", "item_id")
    wanted = want.collect()[0].item_id
    cands, _, _ = o.build_candidates(pool(spark, items, required=want), BASE, include_outerwear=False, include_accessory=False)
    rows = cands.select(F.transform("members", lambda g: g["item_id"]).alias("m")).collect()
    assert len(rows) == 255 and all(wanted in r.m for r in rows)
    plain, _, _ = o.build_candidates(pool(spark, items), BASE, include_outerwear=False, include_accessory=False)
    assert plain.filter(F.size("members") > 3).count() == 0
    top = items.filter("category = 'top'").limit(1).select("wardrobe_id", "item_id")
    only, _, _ = o.build_candidates(pool(spark, items, required=top), BASE)
    assert {r.template for r in only.select("template").collect()} == {"top+bottom+shoes"} and only.count() == 30


def test_copies_are_never_worn_together_and_count_as_one(spark):
    items = wardrobe(spark, {"top": 2, "bottom": 2, "shoes": 1})
    rows = items.collect()
    twin = rows[0].asDict() | {"item_id": "zz", "category": "shoes"}
    both = items.unionByName(spark.createDataFrame([tuple(twin.values())], SCHEMA))
    cands, _, _ = o.build_candidates(pool(spark, both), BASE)
    looks = [set(r.m) for r in cands.select(F.transform("members", lambda g: g["item_id"]).alias("m")).collect()]
    assert len(looks) == 6 and not any({"zz", rows[0].item_id} <= x for x in looks)
    groups = {r.item_id: r.group_id for r in d.duplicate_groups(both, ["wardrobe_id"]).collect()}
    assert groups["zz"] == rows[0].item_id and len(set(groups.values())) == 5


def test_messages(spark):
    few = wardrobe(spark, {"top": 2, "bottom": 1}).unionByName(wardrobe(spark, {"top": 1, "shoes": 1}, wid=2))
    job = generate_outfits(few, "m", 16, BASE, k=3)
    text = {r.wardrobe_id: r.message for r in job.messages.collect()}
    assert text[1].startswith("Every outfit needs shoes") and "2 top" in text[1]
    assert text[2].startswith("Not enough items for an outfit")


def test_messages_for_a_required_item(spark):
    items = wardrobe(spark, {"top": 2, "bottom": 1, "shoes": 1}).unionByName(wardrobe(spark, {"top": 1, "bottom": 1, "shoes": 1}, wid=2))
    items = items.withColumn("review_status", F.when(F.col("item_id") == "w1i000", "needs_review").otherwise(F.col("review_status")))
    asked = spark.createDataFrame([(1, "w1i000"), (2, "nothing")], "wardrobe_id long, item_id string")
    job = generate_outfits(items, "m", 16, BASE, k=1, threshold=0.0, required=asked)
    text = {r.wardrobe_id: r.message for r in job.messages.collect()}
    assert text[1].startswith("The selected item cannot be used: needs review") and text[2] == "The selected item no longer exists."
    assert [(r.wardrobe_id, r.category, r.n_excluded) for r in job.excluded.collect()] == [(1, "top", 1)]


def test_adversarial_outfits(spark):
    items = wardrobe(spark, {"top": 2, "bottom": 1, "shoes": 2, "one_piece": 1, "outerwear": 1, "accessory": 1})
    ids = [r.item_id for r in items.orderBy("item_id").collect()]
    t1, t2, b, s1, s2, dress, coat, hat = ids
    valid = [(t1, b, s1), (t1, b, s1, coat), (dress, s1), (dress, s1, coat, hat), (t2, b, s2, hat)]
    invalid = {
        (t1, t2, b, s1): "contains 2 items of the same type (top)",
        (t1, b, s1, s2): "contains 2 items of the same type (shoes)",
        (t1, s1): "a top needs a bottom (or use a dress/one-piece)",
        (b, s1): "a bottom needs a top (or use a dress/one-piece)",
        (coat, hat, s1): "no main garment: needs a top + bottom or a dress/one-piece",
        (t1, b): "no shoes",
        (dress,): "no shoes",
        (dress, t1, s1): "a dress/one-piece cannot be worn with a separate top or bottom",
        (dress, b, s1): "a dress/one-piece cannot be worn with a separate top or bottom",
        (coat, s1): "no main garment: needs a top + bottom or a dress/one-piece",
    }
    looks = [(str(i), x) for i, look in enumerate([*valid, *invalid]) for x in look]
    members = spark.createDataFrame(looks, "outfit_id string, item_id string").join(w.eligible_items(items, "m", 16), "item_id")
    found = {}
    for r in o.structural_validity(members, ["outfit_id"]).collect():
        found.setdefault(int(r.outfit_id), set()).add(r.why)
    for i in range(len(valid)):
        assert i not in found
    for i, why in enumerate(invalid.values(), start=len(valid)):
        assert why in found[i]


@pytest.mark.parametrize("block", [3, 1000])
def test_hot_key_is_spread_and_whole(spark, block):
    """One key holds a third of all rows: the blocked join finds exactly the pairs of a plain join."""
    rows = [(0 if i % 3 == 0 else i % 17 + 1, i) for i in range(180)]
    df = spark.createDataFrame(rows, "k long, u long")
    got = pair_join(
        df, df, ["k"], ["u"], lambda a, b: a("u") < b("u"), block_rows=block, select=lambda a, b: [a("u").alias("x"), b("u").alias("y")]
    )
    pairs = [(r.k, r.x, r.y) for r in got.collect()]
    want = {(k, x, y) for k, x in rows for k2, y in rows if k == k2 and x < y}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    if block == 3:
        assert got.filter("k = 0").select("_bi", "_bj").distinct().count() > 100


def test_numbering_is_dense(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(300)], "k string, u long")
    out = numbered(df, ["k"], ["u"], "n", ["u"], buckets=7)
    for k in "ab":
        ns = sorted(r.n for r in out.filter(F.col("k") == k).collect())
        assert ns == list(range(1, len(ns) + 1))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(2, 5, 9)], "k int, a int, b int")
    out = d.connected_components(edges, ["k"])
    assert {(r.k, r.label) for r in out.collect()} == {(1, 0), (2, 5)} and out.count() == 43


def test_choosing_outfits_does_not_shuffle_candidates(spark, monkeypatch):
    """Candidates and what is chosen are tables of known size: the chosen go to the candidates, also in later rounds."""
    plans, real = [], o.written

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    strong = real(o.build_candidates(pool(spark, wardrobe(spark, COUNTS29)), BASE)[0])
    monkeypatch.setattr(o, "written", kept)
    assert o.diverse_topk(strong, 3).count() == 3
    assert len(plans) == 4 and all("BroadcastHashJoin" in p for p in plans[2:])
    assert not any("SortMergeJoin" in line and "Inner" in line for p in plans for line in p.splitlines())
