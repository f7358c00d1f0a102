import json
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from garderobe.operators import images as im
from garderobe.operators import wardrobe as w
from garderobe.sources import hooks
from garderobe.sources import readers as rd


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="garderobe-test-")


def png(path, width, height, pixel):
    rows = b"".join(b"\0" + bytes(c for x in range(width) for c in pixel(x, y)) for y in range(height))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_outfit_file(spark, folder):
    path = f"{folder}/train.json"
    with open(path, "w") as f:
        json.dump([{"set_id": "1", "items": [{"item_id": "a", "index": 1}, {"item_id": "b", "index": 2}]}, {"set_id": "2", "items": [{"item_id": "c"}]}], f)
    rows = rd.read_outfits_json(spark, path, "train").collect()
    assert [(r.set_id, r.ord, r.item_id) for r in rows] == [("1", 0, "a"), ("1", 1, "b")]
    with open(f"{folder}/bad.json", "w") as f:
        json.dump([{"set_id": "1"}], f)
    with pytest.raises(Exception, match="expected shape"):
        rd.read_outfits_json(spark, f"{folder}/bad.json", "train").collect()


def test_metadata_file(spark, folder):
    with open(f"{folder}/meta.json", "w") as f:
        json.dump({"a": {"semantic_category": "tops", "title": "x"}, "b": {"category_id": "7"}, "c": {"title": ""}}, f)
    got = {r.item_id: r.category for r in rd.read_item_metadata_json(spark, f"{folder}/meta.json").collect()}
    assert got == {"a": "tops", "b": "7", "c": "unknown"}


def test_pairs_csv(spark, folder):
    with open(f"{folder}/pairs.csv", "w") as f:
        f.write("item_a,item_b,label,split\na,b,1.0,train\nc, d ,0,\ne,f,2,\n")
    good, bad = rd.read_pairs_csv(spark, f"{folder}/pairs.csv", strict=False)
    assert [tuple(r) for r in good.collect()] == [("a", "b", 1, "train"), ("c", "d", 0, None)]
    assert bad.collect()[0].problem == "label must be 0 or 1, got 2"
    with pytest.raises(Exception, match="label must be 0 or 1"):
        rd.read_pairs_csv(spark, f"{folder}/pairs.csv")[0].collect()
    with open(f"{folder}/short.csv", "w") as f:
        f.write("item_a,label\na,1\n")
    with pytest.raises(ValueError, match="item_b"):
        rd.read_pairs_csv(spark, f"{folder}/short.csv")


def test_images(spark, folder):
    left = lambda x, y: (200, 20, 20) if 8 <= x < 56 and 8 <= y < 56 else (255, 255, 255)
    png(f"{folder}/a.png", 64, 64, left)
    png(f"{folder}/b.png", 64, 64, left)
    png(f"{folder}/c.png", 30, 40, lambda x, y: (x * 8, x * 8, x * 8))
    with open(f"{folder}/d.png", "wb") as f:
        f.write(b"not an image")
    found = rd.read_images(spark, folder)
    rows = {r.item_id: r for r in found.collect()}
    assert (rows["c"].width, rows["c"].height) == (30, 40) and rows["d"].width == -1 and rows["a"].sha1 == rows["b"].sha1
    codes = {r.item_id: r.dhash for r in im.dhash(found).collect()}
    assert codes["a"] == codes["b"] != codes["c"] and codes["c"] == "0" * 16 and "d" not in codes
    colours = {r.item_id: r.colors for r in im.dominant_colours(found).collect()}
    assert [(c.name, c.fraction) for c in colours["a"]] == [("red", 1.0)] and colours["a"][0].hex == "#c81414"
    raw = hooks.detect_with(found.filter("width > 0"), lambda row: [("shirt", 0.9, 1, 2, 30, 30)])
    assert raw.count() == 3 and raw.columns[:3] == ["image_id", "width", "height"]


def test_insert_of_a_known_id_is_an_error(spark):
    items = spark.createDataFrame([("a", "top")], "item_id string, category string")
    with pytest.raises(Exception, match="Item a already exists"):
        w.write_items(items, items).collect()
    fresh = spark.createDataFrame([("b", "shoes")], "item_id string, category string")
    assert w.write_items(items, fresh).count() == 2
    left, gone = w.delete_items(items, fresh)
    assert left.count() == 1 and gone.collect()[0].deleted == 0


def test_metadata_text_never_fails(spark):
    rows = spark.createDataFrame([(1, '{"label": "jeans", "odd": 3}'), (2, "{broken"), (3, "[1]"), (4, None)], "i int, metadata_json string")
    got = {r.i: r for r in rd.parse_item_metadata(rows).collect()}
    assert got[1].metadata.label == "jeans" and got[1].extra["odd"] == "3" and got[1].metadata_error is None
    assert got[2].metadata_error is not None and got[3].metadata_error is None and got[4].extra == {}


def test_vector_states(spark):
    unit = [1.0, 0.0]
    rows = [("ok", unit, "m", 2), ("none", None, "m", 2), ("old", unit, "x", 2), ("long", [2.0, 0.0], "m", 2), ("nan", [float("nan"), 0.0], "m", 2), ("dim", [1.0], "m", 2)]
    df = spark.createDataFrame(rows, "item_id string, embedding array<float>, embedding_model string, embedding_dim int")
    got = {r.item_id: r.health for r in w.with_health(df, "m", 2).collect()}
    assert got == {"ok": "ok", "none": "missing", "old": "stale", "long": "corrupt", "nan": "corrupt", "dim": "corrupt"}
    assert df.filter(F.lit(True)).count() == 6
