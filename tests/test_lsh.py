"""Approximate duplicates by bands of signs against all pairs."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe.operators import duplicates as d

SCHEMA = "wardrobe_id long, category string, item_id string, created_at timestamp_ntz, embedding array<double>"
START = datetime.datetime(2024, 1, 1)


def rows(groups=150, dim=24, spread=0.028):
    """Groups of three near vectors; one wardrobe holds half of all."""
    rng, out = np.random.default_rng(11), []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for k in range(3):
            vec = centre / np.linalg.norm(centre) + rng.normal(size=dim) * spread
            wardrobe = 0 if g % 2 else g % 5
            out.append((wardrobe, "top", f"i{g:03d}_{k}", START + datetime.timedelta(seconds=g), [float(x) for x in vec / np.linalg.norm(vec)]))
    return out


def all_pairs(data, threshold=0.97):
    matrix, n = np.array([r[4] for r in data]), len(data)
    near = matrix @ matrix.T >= threshold
    return {(data[i][2], data[j][2]) for i in range(n) for j in range(i + 1, n) if near[i, j] and data[i][:2] == data[j][:2]}


@pytest.mark.parametrize("bits", [None, 14])
def test_recall_and_no_wrong_pair(spark, bits):
    data = rows()
    want = all_pairs(data)
    found = d.lsh_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4), bits=bits).collect()
    got = [(r.a, r.b) for r in found]
    assert len(want) > 250 and len(got) == len(set(got))
    assert set(got) <= want and len(got) >= 0.95 * len(want)


def test_same_pairs_when_a_bucket_is_cut(spark, monkeypatch):
    table = spark.createDataFrame(rows(60), SCHEMA)
    whole = {(r.a, r.b) for r in d.lsh_duplicates(table, bits=1, tables=3).collect()}
    join = d.pair_join
    monkeypatch.setattr(d, "pair_join", lambda *a, **k: join(*a, **{**k, "block_rows": 7}))
    assert {(r.a, r.b) for r in d.lsh_duplicates(table, bits=1, tables=3).collect()} == whole


def test_edges(spark):
    one, other = [1.0, 0.0], [1.0, 0.0, 0.0]
    data = [(1, "top", f"i{i}", START, vec) for i, vec in enumerate((one, one, one, other, None, [], [], [0.0, 1.0]))]
    data.append((1, "shoes", "i9", START, one))
    got = {(r.a, r.b, r.n_pairs) for r in d.lsh_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert ("i0", "i0", 3) in got and not any("i3" in r or "i9" in r or "i7" in r or "i4" in r for r in got)
    assert d.lsh_duplicates(spark.createDataFrame(data, SCHEMA).filter("false")).count() == 0


def test_tables_follow_from_recall():
    for bits in (6, 12, 24):
        n = d.tables_for(0.97, bits, 0.99)
        share = (1 - np.arccos(0.97) / np.pi) ** bits
        assert (1 - share) ** n <= 0.01 < (1 - share) ** (n - 1)
