import pytest
from pyspark.sql import functions as F

from garderobe.operators import audit as a
from garderobe.operators import dataset as d
from garderobe.operators import detections as det
from garderobe.operators import metrics as m
from garderobe.operators import models as mo
from garderobe.plans import bindings as b

SF = "/root/testdata/sf0.001"


def test_disjoint_filter_uses_surviving_valid_pairs(spark):
    rows = [
        ("train", "a", "b"), ("train", "c", "d"), ("valid", "a", "x"), ("valid", "e", "f"),
        ("test", "x", "y"), ("test", "e", "z"), ("test", "d", "w"),
    ]
    pairs = spark.createDataFrame([(*r, 1, "observed_positive") for r in rows], "split string, item_a string, item_b string, label int, kind string")
    got = {r.split: r.dropped for r in d.disjoint_report(pairs).collect()}
    assert got == {"train": 0, "valid": 1, "test": 2}
    assert d.unseen_item_check(d.item_disjoint_filter(pairs)).collect()[0][0] == 0


def test_negatives_match_in_number_and_are_never_observed(spark):
    s = d.PairSampler(b.outfit_items(spark, SF), b.item_categories(spark, SF))
    pairs = s.typed_pairs()
    counts = {(r.split, r.kind): r.n for r in pairs.groupBy("split", "kind").agg(F.count("*").alias("n")).collect()}
    for split in ("train", "valid", "test"):
        pos = counts[split, "observed_positive"]
        assert counts[split, "hard_negative"] == pos // 2
        assert counts[split, "random_negative"] == pos - pos // 2
    ends = [F.least("item_a", "item_b").alias("lo"), F.greatest("item_a", "item_b").alias("hi")]
    seen = pairs.filter("label = 1").select("split", *ends)
    assert pairs.filter("label = 0").select("split", *ends).join(seen, ["split", "lo", "hi"], "left_semi").count() == 0


def scored(spark, ys, ps):
    return spark.createDataFrame(list(zip(ys, ps)), "label int, score double")


def test_metric_goldens(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    row = m.ranking_metrics(m.running_counts(df)).collect()[0]
    assert row.roc_auc == pytest.approx(0.75) and row.pr_auc == pytest.approx(0.5 + 0.5 * 2 / 3)
    ties = m.roc_auc(scored(spark, [1, 0, 1, 0], [0.5, 0.5, 0.5, 0.5])).collect()[0]
    assert ties.roc_auc == pytest.approx(0.5)
    single = m.ranking_metrics(m.running_counts(scored(spark, [1, 1], [0.2, 0.9]))).collect()[0]
    assert single.roc_auc is None and single.best_f1_threshold == 0.5
    assert m.calibration_error(scored(spark, [0, 0, 1, 1], [0.0, 0.0, 1.0, 1.0])).collect()[0].ece == 0.0


def test_running_counts_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = [(i * 7 % 3 % 2, (i * 37 % 101) / 101, "ab"[i % 5 == 0]) for i in range(500)]
    df = spark.createDataFrame(rows, "label int, score double, grp string")

    def counts():
        return [m.running_counts(df, k).orderBy(*k, "score").collect() for k in ([], ["grp"])]

    few = counts()
    monkeypatch.setattr(m, "RANGE_ROWS", 20)
    assert m.by_ranges(df.select("score").distinct(), ["score"], "r").select("r").distinct().count() > 3
    assert counts() == few
    for r in few[0]:
        above = [x for x in rows if x[1] >= r.score]
        assert (r.tp, r.fp) == (sum(x[0] for x in above), sum(1 - x[0] for x in above))


def test_written_pairs_are_not_written_again(spark, monkeypatch):
    """The report of the disjoint filter, and counts of a split, read pairs that come from written tables as they are."""
    rows = [("train", "a", "b", 1, "observed_positive"), ("valid", "a", "c", 1, "observed_positive"), ("valid", "c", "d", 0, "hard_negative"), ("test", "d", "e", 1, "observed_positive")]
    pairs = spark.createDataFrame(rows, "split string, item_a string, item_b string, label int, kind string")
    sizes = []
    kept = d.cut_lineage
    monkeypatch.setattr(d, "cut_lineage", lambda df: sizes.append(df.columns) or kept(df))
    got = {r.split: (r.pairs, r.kept) for r in d.disjoint_report(pairs, written=True).collect()}
    assert got == {"train": (1, 1), "valid": (2, 1), "test": (1, 0)}
    assert [sorted(x) for x in sizes].count(sorted(pairs.columns)) == 1  # the surviving valid pairs alone
    sizes.clear()
    assert d.split_stats(pairs, written=True).count() == 3 and sizes == []


def test_bootstrap_values_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = [(i, i * 7 % 3 % 2, (i * 37 % 101) / 101) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, score double")

    def values():
        out = m.bootstrap_values(df, ["id"], ["score"], n=60)
        return [(r.replicate, round(r.roc_auc, 12), round(r.pr_auc, 12)) for r in out.orderBy("replicate").collect()]

    few = values()
    monkeypatch.setattr(m, "RANGE_ROWS", 50)
    assert values() == few and len(few) == 60


def tied_rows():
    return [(i, i * 7 % 5 % 2, [0.2, 0.2, 0.2, 0.7, (i % 29) / 29][i % 5], float(i % 2)) for i in range(600)]


def bootstrap_loop(rows, at, n):
    """(AUC, average precision) of each replicate, row by row."""
    import hashlib

    import numpy as np

    w = m.replicate_weights(np.array([int(hashlib.sha1(f"0:{r[0]}".encode()).hexdigest()[:8], 16) % m.PRIME for r in rows]), np.arange(1, n + 1))
    label, score = (np.array([r[i] for r in rows]) for i in (1, at))
    for k in range(n):
        tp = fp = good = gained = 0.0
        for s in sorted(set(score), reverse=True):
            pos, neg = (float(w[(score == s) & (label == y), k].sum()) for y in (1, 0))
            good += neg * (tp + pos / 2)
            tp, fp = tp + pos, fp + neg
            gained += pos * tp / (tp + fp) if tp + fp else 0.0
        yield round(good / (tp * fp), 9), round(gained / tp, 9)


def test_bootstrap_cuts_a_score_of_many_rows(spark, monkeypatch):
    df, sizes, cut = spark.createDataFrame(tied_rows(), "id long, label int, score double, other double"), [], m.by_ranges

    def counted(*args, **options):
        out = cut(*args, **options)
        sizes.extend(r["count"] for r in out.groupBy("range").count().collect())
        return out

    monkeypatch.setattr(m, "RANGE_ROWS", 50)
    monkeypatch.setattr(m, "by_ranges", counted)
    got = m.bootstrap_values(df, ["id"], ["score", "other"], n=60).collect()
    assert max(sizes) <= 100 and sum(sizes) == 1200
    for at, name in ((2, "score"), (3, "other")):
        found = [(round(r.roc_auc, 9), round(r.pr_auc, 9)) for r in sorted(got, key=lambda r: r.replicate) if r.scorer == name]
        assert found == list(bootstrap_loop(tied_rows(), at, 60))


def test_paired_bootstrap_cuts_a_score_of_many_rows(spark, monkeypatch):
    import numpy as np

    df, sizes, cut = spark.createDataFrame(tied_rows(), "id long, label int, score double, other double"), [], m.by_ranges

    def counted(rows, order, name, *args, **options):
        out = cut(rows, order, name, *args, **options)
        sizes.extend(r["count"] for r in out.groupBy(name).count().collect())
        return out

    monkeypatch.setattr(m, "RANGE_ROWS", 50)
    monkeypatch.setattr(m, "by_ranges", counted)
    got = m.paired_bootstrap_auc_diff(df, ["id"], "score", "other", n=60).first()
    assert max(sizes) <= 100
    d = [a - b for (a, _), (b, _) in zip(bootstrap_loop(tied_rows(), 2, 60), bootstrap_loop(tied_rows(), 3, 60), strict=True)]
    assert [round(got.ci95_low, 6), round(got.ci95_high, 6)] == [round(float(q), 6) for q in np.percentile(d, [2.5, 97.5])]


def test_distractors_are_drawn_for_each_question(spark):
    from collections import Counter
    from itertools import combinations

    rows = [("valid", s, k, f"i{(s * 7 + k * 13) % 60:02d}") for s in range(600) for k in range(2 + s % 3)]
    members = spark.createDataFrame(rows, "split string, set_id long, ord long, item_id string")
    asked = m.fitb_questions(members, members.select("item_id")).collect()
    own, chosen = {}, {}
    for _, s, _, item in rows:
        own.setdefault(s, set()).add(item)
    for r in asked:
        if r.candidate:
            chosen.setdefault(r.set_id, []).append(r.item_id)
    assert len(chosen) == 600 and all(len(set(c)) == 3 and not own[s] & set(c) for s, c in chosen.items())
    together = Counter(p for c in chosen.values() for p in combinations(sorted(c), 2))
    # 1,800 pairs over 1,770 possible ones; neighbours in one list would meet some 20 times.
    assert max(together.values()) <= 9 and len(together) > 1000
    assert [m.next_prime(n) for n in (1, 8, 60, 7919)] == [2, 11, 61, 7919]


def test_audit_counts_shared_and_repeated_outfits(spark):
    rows = [("train", 1, "a"), ("train", 1, "b"), ("train", 2, "b"), ("train", 2, "a"), ("valid", 3, "a"), ("valid", 3, "b"), ("test", 4, "c"), ("test", 4, "d")]
    members = spark.createDataFrame(rows, "split string, set_id long, item_id string")
    leak = a.split_leakage(members).collect()[0]
    assert (leak.items_train_valid, leak.items_train_test, leak.identical_outfits, leak.items_in_multiple_outfits) == (2, 0, 1, 2)
    assert {r.split: r.duplicates for r in a.duplicate_outfits(members).collect()} == {"train": 1, "valid": 0, "test": 0}


def test_regions_equal_the_sequential_rule(spark):
    evidence = det.evidence_filter(det.first_seen_dedup(det.validate_detections(b.raw_detections(spark, SF)))).cache()
    got = {
        (r.image_id, tuple(r.box)): (r.label, round(r.conf, 6), [x.label for x in r.alternatives]) for r in det.group_regions(evidence).collect()
    }

    def iou(p, q):
        area = lambda z: max(0, z[2] - z[0]) * max(0, z[3] - z[1])
        inter = area((max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])))
        return inter / (area(p) + area(q) - inter)

    images = {}
    for r in evidence.collect():
        images.setdefault(r.image_id, []).append((-r.conf, tuple(r.box), r.seq, r.label))
    want = {}
    for image, rows in images.items():
        regions = []
        for neg, box, _, label in sorted(rows):
            home = next((x for x in regions if iou(x["box"], box) >= 0.55), None)
            if home is None:
                regions.append({"box": box, "label": label, "conf": round(-neg, 6), "alt": []})
            elif label != home["label"] and label not in home["alt"]:
                home["alt"].append(label)
        for x in regions:
            want[image, x["box"]] = (x["label"], x["conf"], x["alt"])
    assert got == want


def test_person_photo_flags(spark):
    rows = [
        ("p", 400, 600, 1, "jumpsuit", 0.72, 100, 50, 300, 550), ("p", 400, 600, 2, "coat", 0.20, 100, 50, 300, 550),
        ("p", 400, 600, 3, "jacket", 0.13, 102, 50, 300, 550), ("p", 400, 600, 4, "jeans", 0.60, 120, 300, 280, 540),
        ("p", 400, 600, 5, "sneakers", 0.70, 130, 550, 200, 590), ("p", 400, 600, 6, "spoon", 0.9, 0, 0, 100, 100),
    ]
    raw = spark.createDataFrame(rows, "image_id string, width int, height int, seq int, label string, confidence double, x1 int, y1 int, x2 int, y2 int")
    out = {r.label: r for r in det.detect_regions(raw).collect()}
    assert set(out) == {"jumpsuit", "jeans", "sneakers"}
    suit = out["jumpsuit"]
    assert [x.label for x in suit.alternatives] == ["coat", "jacket"] and suit.suggested_category == "outerwear"
    assert [f.code for f in suit.flags] == ["contains_separates"] and "(jeans 0.60, coat 0.20, jacket 0.13)" in suit.flags[0].message
    assert not out["jeans"].flags
    again = det.detections_from_json(det.detections_to_json(det.detect_regions(raw)))
    assert {r.id for r in again.collect()} == {r.id for r in out.values()}


def test_negative_feature_is_dropped(spark):
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(600):
        good, bad = rng.random(), rng.random()
        rows.append((int(good - bad + rng.random() * 0.5 > 0.2), good, bad if rng.random() > 0.1 else None))
    model = mo.fit_pair_model(spark.createDataFrame(rows, "label int, good double, bad double"), ["good", "bad"])
    assert model["features"] == ("good",) and "bad" in model["dropped"] and model["coef"][0] > 0
    assert mo.load_pair_model(spark, "/tmp/no-such-model")["outfit_threshold"] is None


def test_gate(spark):
    facts = {
        "is_outfits": True, "train_outfits": 10, "raw_positive_pairs": 5, "unique_items": 9000, "train_positive": 20000, "valid_positive": 600,
        "test_positive": 2000, "train_negative": 1, "valid_negative": 1, "test_negative": 1, "has_categories": True, "slot_top": 5, "slot_bottom": 5,
        "slot_shoes": 5, "slot_one_piece": 0, "slot_outerwear": 1, "slot_accessory": 1, "top_category_share": 0.2, "images_checked": False,
        "missing_or_corrupt_rate": 0.0, "duplicate_image_rate": 0.0, "images_sampled": False, "items_checked": 0, "groups_across_splits": 0,
        "items_train_valid": 0, "items_train_test": 0, "items_valid_test": 0, "dropped_valid": 0, "dropped_test": 0, "items_in_multiple_outfits": 3,
        "license": "CC0",
    }
    row = a.audit_gate(spark.createDataFrame([facts])).collect()[0]
    assert row.verdict == "INSUFFICIENT" and row.failures == ["only 10 training outfits (need >= 2000)"]
    assert row.what_is_missing == ["at least 1990 more real training outfits"]
    assert "no items for: one_piece" in row.limitations
    loose = a.audit_gate(spark.createDataFrame([facts]), {"min_train_outfits": 5}).collect()[0]
    assert loose.verdict == "SUFFICIENT_WITH_LIMITATIONS"


def test_few_draws_go_to_the_tables(spark, monkeypatch):
    rows = [(("train", "valid")[s % 2], s, k, f"i{(s * 7 + k * 5) % 18:02d}") for s in range(40) for k in range(3)]
    outfits = spark.createDataFrame(rows, "split string, set_id long, ord long, item_id string")
    kinds = spark.createDataFrame([(f"i{i:02d}", f"c{i % 2}") for i in range(17)], "item_id string, category string")

    def drawn():
        sampler = d.PairSampler(outfits, kinds)
        assert "i00" in {r.item_a for r in sampler.positives.collect()}
        found = sorted(tuple(r) for r in sampler.negatives().collect())
        return found, sorted(tuple(r) for r in sampler.unfilled().collect())

    few = drawn()
    assert len(few[0]) + sum(r[2] for r in few[1]) == 120
    seen = {(r[0], *sorted(r[2:4])) for r in few[0]} & {(r.split, *sorted((r.item_a, r.item_b))) for r in d.positive_pairs(outfits).collect()}
    assert not seen
    monkeypatch.setattr(d, "FEW_TRIES", 0)
    assert drawn() == few


def test_pairs_of_small_groups_carry_no_blocks(spark):
    from garderobe.operators.spread import pair_join

    rows = spark.createDataFrame([(g, i) for g in range(30) for i in range(g % 5)], "g long, i long")

    def pairs(**options):
        return pair_join(rows, rows, ["g"], ["i"], lambda a, b: a("i") < b("i"), select=lambda a, b: [a("i").alias("a"), b("i").alias("b")], **options)

    def found(df):
        return sorted(tuple(r) for r in df.select("g", "a", "b").collect())

    assert "explode" not in pairs()._jdf.queryExecution().optimizedPlan().toString()
    assert found(pairs()) == found(pairs(block_rows=2)) == sorted((g, a, b) for g in range(30) for b in range(g % 5) for a in range(b))
