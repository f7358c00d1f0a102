"""Whole jobs: selection over large wardrobes, stream cuts, shipping to workers, fitting and ingest."""

import datetime
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe import vocab as v
from garderobe.operators import dataset as d
from garderobe.operators import outfits as o
from garderobe.operators.duplicates import flag_earlier
from garderobe.streaming import ingest as st
from tests.test_outfits import BASE, pool, wardrobe

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_over_200000_combinations_equal_brute_force(spark):
    """60 garments per slot: every combination takes part, no pruning, no short list."""
    n = 60
    items = wardrobe(spark, {"top": n, "bottom": n, "shoes": n})
    cands = o.build_candidates(pool(spark, items), BASE, include_outerwear=False, include_accessory=False)[0]
    kept = o.template_pool(pool(spark, items), "top+bottom+shoes").withColumn("template", F.lit("top+bottom+shoes"))
    p = {(r.x, r.y): r.p for r in o.core_pairs(kept, BASE).select(F.col("ga.item_id").alias("x"), F.col("gb.item_id").alias("y"), "p").collect()}
    ids = [f"w1i{i:03d}" for i in range(3 * n)]
    t, b, s = ids[:n], ids[n : 2 * n], ids[2 * n :]
    grid = lambda xs, ys: np.array([[p.get((x, y), np.nan) for y in ys] for x in xs])
    total = (grid(t, b)[:, :, None] + grid(t, s)[:, None, :] + grid(b, s)[None, :, :]) / 3
    assert np.isfinite(total).sum() > 200_000 and cands.count() == np.isfinite(total).sum()
    i, j, k = np.indices(total.shape)
    shared = np.zeros(total.shape, int)
    rank, left, want = np.where(np.isfinite(total), total, -np.inf), np.isfinite(total), []
    for _ in range(4):
        value = np.where(left, rank - v.DIVERSITY_WEIGHT * shared / 3, -np.inf)
        at = np.unravel_index(np.argmax(value), value.shape)
        want.append((t[at[0]], b[at[1]], s[at[2]]))
        same = (i == at[0]).astype(int) + (j == at[1]) + (k == at[2])
        shared = np.maximum(shared, same)
        left &= same <= 1  # at most half of three garments
    rows = o.diverse_topk(cands, 4).orderBy("choice").select(F.transform("members", lambda g: g["item_id"]).alias("m")).collect()
    assert [tuple(r.m) for r in rows] == want


@pytest.fixture(scope="module")
def arrivals(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16))
    rows = []
    for n in range(24):
        vec = base[n % 4] + (0 if n % 3 else 0.01 * rng.normal(size=16))
        vec /= np.linalg.norm(vec)
        when = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n // 2)  # ties in time go by id
        rows.append((1, "top", f"i{n:02d}", when, [float(x) for x in vec]))
    return rows, "wardrobe_id long, category string, item_id string, created_at timestamp_ntz, embedding array<float>"


def twins_before(rows):
    out = {}
    for r in rows:
        vec = np.array(r[4])
        near = [q for q in rows if (q[3], q[2]) < (r[3], r[2]) and float(np.array(q[4]) @ vec) >= v.DUPLICATE_COSINE]
        out[r[2]] = (len(near), min(((q[3], q[2]) for q in near), default=(None, None))[1])
    return out


def test_earlier_twins_of_a_batch(spark, arrivals):
    rows, schema = arrivals
    got = {r.item_id: (r.earlier, r.first_earlier.item_id) for r in flag_earlier(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: x for k, x in twins_before(rows).items() if x[0]}


@pytest.mark.parametrize("files", [1, 4])
def test_flags_do_not_depend_on_the_batches(spark, arrivals, tmp_path, files):
    rows, schema = arrivals
    source = tmp_path / "in"
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    table = st.stream_ingest(stream, spark.createDataFrame([], schema), spark)
    got = {r.item_id: (r.possible_duplicates, r.possible_duplicate_of) for r in spark.read.parquet(table).collect()}
    assert got == twins_before(rows)


def test_every_negative_is_drawn_or_reported(spark):
    """Two outfits of two: only four unseen pairs across, none is hard; the other wanted negatives are counted."""
    rows = [("train", s, i, f"{s}{i}") for s in ("a", "b") for i in range(2)]
    members = spark.createDataFrame(rows, "split string, set_id string, ord long, item_id string")
    cats = spark.createDataFrame([(f"{s}{i}", f"{s}{i}") for s in ("a", "b") for i in range(2)], "item_id string, category string")
    sampler = d.PairSampler(members, cats)
    drawn = sampler.negatives().count()
    missing = {r.kind: r.unfilled for r in sampler.unfilled().collect()}
    assert drawn + sum(missing.values()) == 2 and missing == {"hard_negative": 1}


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "from garderobe.session import build_session\n"
        "spark = build_session('elsewhere', 'local[2]', {'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "import __spark_entry__ as e\n"
        "print('rows', e.queries()['cosine'](spark, '/root/testdata/sf0.001').count(), e.queries()['cosine'](spark, '/root/testdata/sf0.001').agg({'cosine': 'avg'}).first())\n"
    )
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 499" in run.stdout, run.stderr[-2000:]
