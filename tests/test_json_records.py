"""Records of one JSON file in byte ranges of any length."""

import json
import random
import tempfile

import pytest

from garderobe.sources import readers as rd
from garderobe.sources.json_records import IN, OUT, json_records, separators, structure

NASTY = ['},{"set_id": "x", "items": []', "\\", '\\"', "][", "é東🙂", 'a\\\\"b', "{", ",", ""]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="garderobe-test-")


def written(folder, name, value, **options):
    path = f"{folder}/{name}.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, **options)
    return path


def test_state_at_every_cut():
    """A text cut anywhere gives the same structure as in one piece."""
    text = json.dumps([{"k": x, x: [x, {"n": None}]} for x in NASTY], ensure_ascii=False).encode()
    whole, outside, end = structure(text, OUT)
    assert end == OUT and whole.sum() == 0 and int((outside & (whole == 1)).sum()) == text.decode().count("{") + text.decode().count("[") - sum(
        json.dumps(x, ensure_ascii=False).count(c) * 3 for x in NASTY for c in "{["
    )
    for cut in range(len(text)):
        a, _, state = structure(text[:cut], OUT)
        b, _, last = structure(text[cut:], state)
        assert last == OUT and (list(a) + list(b)) == list(whole)
    assert structure(b'ab" {', IN)[2] == OUT and separators(b"[1,2]", OUT, 0)[0].tolist() == [0, 2]


@pytest.mark.parametrize("length,indent", [(7, None), (64, 2), (1 << 20, None)])
def test_records_equal_the_parsed_file(spark, folder, length, indent):
    rng = random.Random(length)
    rows = [{"id": i, "t": rng.choice(NASTY), "sub": {"a": [rng.choice(NASTY)]}} for i in range(12)]
    path = written(folder, "rows", rows, indent=indent, ensure_ascii=False)
    got = [json.loads(r.record) for r in json_records(spark, path, length).orderBy("position").collect()]
    assert got == rows
    keyed = {f"{i}{rng.choice(NASTY)}": r for i, r in enumerate(rows)}
    path = written(folder, "keyed", keyed, indent=indent)
    got = {}
    for r in json_records(spark, path, length).collect():
        assert r.opening == "{"
        got.update(json.loads("{" + r.record + "}"))
    assert got == keyed


def test_a_large_outfit_file_is_many_tasks(spark, folder):
    sets = [{"set_id": str(i), "items": [{"item_id": f"a{i}", "index": 1}, {"item_id": f"b{i}", "index": 2}]} for i in range(3000)]
    path = written(folder, "sets", sets)
    out = rd.read_outfits_json(spark, path, "train", 4096)
    assert out.rdd.getNumPartitions() > 20
    rows = {(r.set_id, r.ord): r.item_id for r in out.collect()}
    assert len(rows) == 6000 and rows["17", 1] == "b17"


@pytest.mark.parametrize("bad", [{"set_id": "1"}, [{"set_id": "1"}], [{"set_id": "1", "items": [{"x": 1}]}], [[1]], [5]])
def test_bad_shapes_raise(spark, folder, bad):
    with pytest.raises(Exception, match="expected shape"):
        rd.read_outfits_json(spark, written(folder, "bad", bad), "train", 8).collect()


def test_cut_off_files_raise_and_empty_ones_have_no_records(spark, folder):
    with open(f"{folder}/short.json", "w") as f:
        f.write('[{"set_id": "1", "items": [')
    with pytest.raises(ValueError, match="complete"):
        json_records(spark, f"{folder}/short.json", 5)
    assert json_records(spark, written(folder, "none", []), 5).count() == 0
