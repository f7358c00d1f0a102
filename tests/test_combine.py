"""Combinations of three garments, formed in blocks."""

import collections
import itertools

from pyspark.sql import functions as F

from garderobe.operators import combine
from garderobe.operators import outfits as o

G = "struct<created_at:timestamp_ntz,item_id:string,grp:string,slot:string,ctx:double>"
SCORED = f"wardrobe_id long, template string, a_slot string, b_slot string, ga {G}, gb {G}, p double"


def scored_pairs(spark, sizes=(9, 8, 7), wardrobes=(1, 2)):
    """Pairs with gaps, one pair twice, one without a score and one without an id; a wardrobe of one-piece outfits too."""

    def garment(slot, i):
        return (None, None if i is None else f"{slot}{i}", None, slot, None)

    slots, rows = ("top", "bottom", "shoes"), []
    for w in wardrobes:
        n = sizes if w == 1 else (2, 1, 2)
        for (i, x), (j, y) in itertools.combinations(list(enumerate(slots)), 2):
            for a, b in itertools.product(range(n[i]), range(n[j])):
                if (a * 7 + b * 3 + i + w) % 5:
                    rows.append((w, o.THREE, x, y, garment(x, a), garment(y, b), 0.01 * a + 0.001 * b + 0.1 * i))
    rows.append(rows[0])
    rows.append((*rows[1][:6], None))
    rows.append((1, o.THREE, "top", "bottom", garment("top", None), garment("bottom", 0), 0.5))
    rows.append((3, "one_piece+shoes", "one_piece", "shoes", garment("one_piece", 0), garment("shoes", 0), 0.25))
    return rows


def brute_force(rows):
    pick = lambda x, y: [r for r in rows if r[1] == o.THREE and (r[2], r[3]) == (x, y) and r[4][1] and r[5][1]]
    out = collections.Counter()
    for tb, ts, bs in itertools.product(pick("top", "bottom"), pick("top", "shoes"), pick("bottom", "shoes")):
        if tb[0] == ts[0] == bs[0] and tb[4] == ts[4] and tb[5] == bs[4] and ts[5] == bs[5]:
            ps = [r[6] for r in (tb, ts, bs)]
            out[tb[0], tb[4][1], tb[5][1], ts[5][1], None if None in ps else ps[0] + ps[1] + ps[2], 3.0] += 1
    out.update((r[0], r[4][1], None, r[5][1], r[6], 1.0) for r in rows if r[1] != o.THREE)
    return out


def test_core_combinations_equal_brute_force_in_blocks(spark, monkeypatch):
    rows = scored_pairs(spark)
    want = brute_force(rows)
    assert max(want.values()) > 1 and any(k[4] is None for k in want)
    for block, step in ((128, 20_000), (3, 11)):
        monkeypatch.setattr(combine, "BLOCK", block)
        monkeypatch.setattr(combine, "STEP", step)
        found = o.core_combinations(spark.createDataFrame(rows, SCORED)).select("wardrobe_id", "m1.item_id", "m2.item_id", "m3.item_id", "total", "weight")
        assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_counts_equal_the_combinations_and_none_is_formed(spark, monkeypatch):
    rows = scored_pairs(spark)
    want = collections.Counter()
    for key, n in brute_force(rows).items():
        want[key[0]] += n
    monkeypatch.setattr(combine, "joined_rows", None)
    for block in (128, 3):
        monkeypatch.setattr(combine, "BLOCK", block)
        found = o.core_counts(spark.createDataFrame(rows, SCORED)).collect()
        assert {r.wardrobe_id: r.valid for r in found} == dict(want)


def test_no_combination_is_shuffled(spark):
    """Pairs go to their blocks; above the step that forms combinations there is no join and no exchange."""
    core = o.core_combinations(spark.createDataFrame(scored_pairs(spark), SCORED))
    plan = core._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Join" not in above and "Exchange" not in above


def layer_rows(rows, layers=("outerwear", "accessory"), n=5, block=2):
    """Score arrays of every garment for blocks of layer garments with equal scores, gaps and a garment without any."""
    G0 = lambda slot, i: (None, f"{slot}{i}", None, slot, None)
    out = []
    wearers = {(r[0], g[1], g[3]) for r in rows for g in r[4:6] if g[1]}
    wearers |= {(w, f"outerwear{i}", "outerwear") for w in (1, 2, 3) for i in range(n)}
    for w, name, slot in sorted(wearers):
        for layer in layers:
            if slot == layer or name == "shoes1":
                continue
            for blk in range(0, n, block):
                span = range(blk, min(n, blk + block))
                ps = [None if (hash_of(name) + i) % 11 == 0 else ((hash_of(name) + i * 3) % 7) / 8 for i in span]
                out.append((w, name, layer, blk, [G0(layer, i) for i in span], ps))
    return out


def hash_of(name):
    return sum(name.encode())


def test_layers_chosen_where_combinations_are_formed_equal_joined_ones(spark, monkeypatch):
    rows = scored_pairs(spark, (4, 5, 3))
    vectors = spark.createDataFrame(layer_rows(rows), f"wardrobe_id long, wearer string, layer string, blk int, gs array<{G}>, ps array<double>")
    forced = spark.createDataFrame([(1, None), (2, "outerwear"), (3, "accessory")], "wardrobe_id long, forced string")
    scored = spark.createDataFrame([r for r in rows if r[6] is not None], SCORED)
    core = o.core_combinations(scored).join(forced, "wardrobe_id")
    joined = o.best_layer(o.best_layer(core, vectors, "outerwear", ["m1", "m2", "m3"]), vectors, "accessory", ["m1", "m2", "m3", "outerwear"])
    members = ["m1", "m2", "m3", "outerwear", "accessory"]
    shown = ["wardrobe_id", "template", *[f"{m}.item_id" for m in members], "total", "weight"]
    want = collections.Counter(tuple(r) for r in joined.select(*shown).collect())
    assert {bool(k[5]) for k in want} == {bool(k[6]) for k in want} == {True, False}
    known = scored.join(forced, "wardrobe_id").selectExpr("*", "cast(null as string) as want")
    for block, cells in ((128, 1_000_000), (2, 20)):
        monkeypatch.setattr(combine, "BLOCK", block)
        monkeypatch.setattr(combine, "LAYER_CELLS", cells)
        found = o.dressed(known, vectors, o.THREE).unionByName(o.dressed(known, vectors, "one_piece+shoes"))
        assert collections.Counter(tuple(r) for r in found.select(*shown).collect()) == want
    asked = o.dressed(known.withColumn("want", F.lit("bottom2")), vectors, o.THREE).select(*shown)
    assert collections.Counter(tuple(r) for r in asked.collect()) == {k: n for k, n in want.items() if k[3] == "bottom2"}


def test_candidates_with_layers_are_not_shuffled(spark):
    rows = scored_pairs(spark)
    vectors = spark.createDataFrame(layer_rows(rows), f"wardrobe_id long, wearer string, layer string, blk int, gs array<{G}>, ps array<double>")
    known = spark.createDataFrame(rows, SCORED).selectExpr("*", "cast(null as string) as forced", "cast(null as string) as want")
    plan = o.dressed(known, vectors, o.THREE)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Join" not in above and "Exchange" not in above and "Aggregate" not in above
