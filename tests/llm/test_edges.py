"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from garderobe.llm import debruijn, decontaminate, language, mixing, quality, rules, simhash, suffixes, tokens, toxicity
from tests.llm.test_queries import without_later_bytes, without_repeated_words

LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, f"{PASSAGE} first text", "en", "a"),
    (2, f"second {PASSAGE}", "en", "a"),
    (2, f"second {PASSAGE}", "en", "a"),
    (3, None, None, None),
    (4, "", "fr", "b"),
    (5, " \n\t ", "fr", "b"),
    (None, f"without id {PASSAGE}", "fr", None),
    (6, LONG, "en", "b"),
    (7, "buy now " * 100, None, "c"),
    (8, "12 34 !!", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = "row variant spans start starts bucket mix_size mix_copies quality_score kept_hash node fp component_id score item_id quality turn shard".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (7, 0, 1), (8, 0, 1), (8, 1, 1), (None, 1, 1), (4, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (None, "two words")], "item_id long, text string")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)


def test_one_row_for_each_document(docs, labels):
    for out in (
        quality.quality(docs, labels),
        toxicity.toxicity(docs, labels),
        language.languages(docs),
        rules.apply_rules(docs, labels),
        mixing.mixed_documents(docs),
        simhash.near_duplicates(docs),
        suffixes.remove_repeated_bytes(docs),
        debruijn.remove_repeated_words(docs),
    ):
        assert ids(out) == ALL


def test_empty_tables(empty, labels, bench):
    nothing, none = labels.limit(0), bench.limit(0)
    for out in (
        quality.quality(empty, nothing),
        toxicity.toxicity(empty, nothing),
        language.languages(empty),
        rules.apply_rules(empty, nothing),
        mixing.mixed_documents(empty),
        simhash.near_duplicates(empty),
        suffixes.remove_repeated_bytes(empty),
        debruijn.remove_repeated_words(empty),
        decontaminate.leaks(empty, bench),
        decontaminate.leaks(empty, none),
        tokens.training_order(empty),
    ):
        assert out.count() == 0


def test_without_labels(docs, labels, bench):
    nothing = labels.limit(0)
    assert {r["score"] for r in quality.quality(docs, nothing).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(docs, nothing).collect()} == {0}
    assert {r["lang_pred"] for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rules.apply_rules(docs, nothing).collect())


def test_no_row_is_rejected_without_a_model(docs, labels):
    for nothing in (labels.limit(0), labels.withColumn("doc_id", F.col("doc_id") + 1_000_000)):
        out = quality.drop_low_quality(docs, nothing)
        assert out.columns == docs.columns and ids(out) == ids(docs)


def test_scores(docs, labels):
    for r in quality.quality(docs, labels).collect() + toxicity.toxicity(docs, labels).collect() + language.languages(docs).collect():
        assert 0 <= r["score"] <= 1
    langs = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs).collect()}
    assert langs[3] == langs[4] == langs[5] == langs[8] == "und"


def test_repeats_with_nulls_and_ties(docs):
    largest = 1 << 60
    rows = [(largest if d is None else d, t) for d, t, *_ in ROWS]
    want = without_later_bytes(rows)
    got = {largest if r[0] is None else r[0]: tuple(r[1:]) for r in suffixes.remove_repeated_bytes(docs).collect()}
    assert got == want
    got = sorted((largest if r[0] is None else r[0], *r[1:]) for r in debruijn.remove_repeated_words(docs).collect())
    assert got == without_repeated_words(rows)


def test_one_id_with_different_texts(spark):
    docs = spark.createDataFrame([(1, f"a {PASSAGE}"), (1, f"b {PASSAGE} c"), (2, PASSAGE)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeated_bytes(docs).collect())
    assert [(d, n) for d, _, n in got] == [(1, 0), (1, 0), (2, len(PASSAGE))]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in debruijn.remove_repeated_words(docs).collect())
    assert got == [(1, 61, 60), (1, 62, 60), (2, 60, 60)]


def test_words_of_odd_texts(docs, labels):
    got = {r["doc_id"]: r for r in rules.apply_rules(docs, labels).collect()}
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0
    assert got[7]["n_repeat_words"] == 200 and got[7]["base_failed"] and not got[7]["kept"]
    assert got[6]["n_words"] == 120_000 and got[6]["n_repeat_words"] == 0


def test_components_of_blank_texts(docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got[3] == got[4] == got[5] == ("0" * 16, 3)
    assert got[2][1] == 1 and got[6][1] == 6


def test_leaks(docs, bench):
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted((str(d), i) for d in (1, 2, 2, None) for i in (1, 2))
    assert ids(decontaminate.drop_leaks(docs, bench)) == [3, 4, 5, 6, 7, 8]


def test_mix_keeps_columns_and_bounds(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    for r in mixing.mixed_documents(docs).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]


def test_near_duplicates_leave_one(docs):
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    left = ids(out)
    assert 1 in left and 2 not in left and None not in left and [3, 6, 7, 8] == [i for i in left if i in (3, 4, 5, 6, 7, 8)]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    """Null ids and an id with several texts: each group keeps one row, nothing else goes."""
    one, two, three, four = (" ".join(f"{name}{i}" for i in range(80)) for name in ("a", "b", "c", "d"))
    rows = [(2, one), (5, one), (5, two), (None, three), (None, four), (None, four), (None, one), (7, three)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, [(2, one), (5, two), (7, three), (None, four)]))


def test_tokens_of_odd_rows(docs):
    rows = tokens.training_order(docs).collect()
    ends = [r for r in rows if r["doc_id"] in (3, 4)]
    assert len(ends) == 2 and all(r["n_tokens"] == 1 for r in ends)
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}


def test_stages_on_odd_and_empty_documents(spark, docs, empty):
    sf_dir = "/root/testdata/sf0.001"
    for table in (docs, empty):
        held = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, sf_dir)
            assert out.columns == docs.columns
            held = spark.createDataFrame(out.collect(), out.schema)
        corpus_pipeline.STAGES[-1][1](spark, held, sf_dir).count()


def test_pipeline_follows_its_stages(spark):
    """Each stage against what its operator says of its input, on whole small tables."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = corpus_pipeline.STAGES
    good = first(spark, docs, sf_dir)
    assert ids(good) == ids(quality.quality(docs, labels).where("predicted = 1"))
    single = second(spark, good, sf_dir)
    groups = simhash.simhash_groups(good, k=5, similarity=0.8)
    assert ids(single) == sorted({r["component_id"] for r in groups.collect()}, key=str)
    clean = third(spark, single, sf_dir)
    leaked = {r["doc_id"] for r in decontaminate.leaks(single, bench).collect()}
    assert ids(clean) == [i for i in ids(single) if i not in leaked] and leaked
    mixed = fourth(spark, clean, sf_dir)
    times = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_counts(clean).collect()}
    assert ids(mixed) == sorted((d for d, n in times.items() for _ in range(n)), key=str)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in whole.collect()} == set(ids(mixed)) == {r["doc_id"] for r in fifth(spark, mixed, sf_dir).collect()}


def colliding_texts(spark, before, after):
    """Two texts with the passage given by ``before`` and without it, of one 32-bit Spark hash."""
    n = F.col("id").cast("string")
    one, two = F.concat(F.lit(before), n), F.concat(F.lit(after), n)
    ids = spark.range(300_000)
    pair = ids.select(one.alias("a"), F.hash(one).alias("h")).join(ids.select(two.alias("b"), F.hash(two).alias("h")), "h").first()
    return pair["a"], pair["b"]


def test_colliding_texts_of_one_id(spark):
    """Rows of one id (or of none) whose texts collide in 32 bits lose what is theirs, no more."""
    a, b = colliding_texts(spark, f"{PASSAGE} tail", " ".join(f"other{i}" for i in range(60)) + " tail")
    for shared in (None, 9):
        rows = [(1, PASSAGE), (shared, a), (shared, b), ((1 << 63) - 1, "largest id " * 3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in debruijn.remove_repeated_words(docs).collect()), key=str)
        assert got == sorted([("1", 60, 60), (str(shared), 61, 60), (str(shared), 61, 0), (str((1 << 63) - 1), 6, 0)], key=str)
        got = {(str(r["doc_id"]), r["n_bytes"]): r["n_removed"] for r in suffixes.remove_repeated_bytes(docs).collect()}
        assert got[str(shared), len(a)] >= len(PASSAGE) and got[str(shared), len(b)] == 0 and got["1", len(PASSAGE)] == 0


def test_mix_meets_its_targets_without_ids(spark):
    """Rows without id, with one id and equal rows draw each for itself; SQL says the same."""
    import duckdb

    rows = [(None, f"five words in row {i}", ("a", "b", "c")[i % 3]) for i in range(1500)] + [(7, "same text here", "a")] * 300 + [(i + 10, "one id each", "c") for i in range(250)]
    rows += [(None, None, None), (None, "", "b")]
    out = [tuple(r) for r in mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    targets, taken = {}, {}
    for _, _, source_size, target, words in out:
        targets[source_size] = target
        taken[source_size] = taken.get(source_size, 0) + words
    assert len(targets) == 4 and all(abs(taken[s] - targets[s]) <= 0.1 * targets[s] for s in targets)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    assert sorted(((d, n, s, round(t, 6), k) for d, n, s, t, k in want), key=str) == sorted(((d, n, s, round(t, 6), k) for d, n, s, t, k in out), key=str)


def test_windows_of_equal_hash_and_different_anchors_are_different():
    import numpy as np
    import pyarrow as pa

    from garderobe.llm.blocks import BLOCK_KINDS, Shape, pack, read_bucket

    def blob(rows):
        anchor, block, doc = (np.array([r[i] for r in rows]) for i in range(3))
        zero = np.zeros(len(rows), np.int64)
        columns = [anchor, block, doc, zero, zero, zero + 1]
        return pack([c.astype(k) for c, k in zip(columns, BLOCK_KINDS, strict=True)])

    def found(rows, hashes):
        table = pa.table({"blob": pa.array([blob(rows)], pa.binary()), "payload": pa.array([np.array(hashes, np.uint64).tobytes()], pa.binary())})
        return debruijn.resolve(read_bucket(table, Shape(35, 6, True), False)).column("doc_id").to_pylist()

    assert found([(5, 9, 1), (6, 9, 2)], [77, 77]) == []  # equal hashes of blocks and windows under two anchors
    assert found([(5, 9, 1), (5, 9, 2)], [77]) == [1, 2]
    assert found([(5, 8, 1), (5, 9, 2), (6, 9, 3)], [77, 77, 77]) == [1, 2]


def test_windows_with_few_shingles_of_items_get_no_fingerprint(monkeypatch):
    import numpy as np

    from garderobe.llm import decontaminate as dc
    from garderobe.llm.simhash import majority, shingle_hashes

    item = [f"w{i}" for i in range(40)]
    index = dc.Index([(1, " ".join(item)), (2, " ".join(item[:20] + [f"v{i}" for i in range(25)]))])
    far = " ".join([f"x{i}" for i in range(300)] + item[:12] + [f"y{i}" for i in range(300)])
    near = [" ".join([f"x{i}" for i in range(9)] + item[:cut] + ["z"] * 2 + item[cut + 1 :] + item[:7]) for cut in (2, 20, 39)]
    for text in near:
        hashes, want = shingle_hashes(text, dc.SHINGLE), {}
        for row, bag in enumerate(index.bags):
            n = min(sum(bag.values()), len(hashes))
            own = majority(np.array(list(bag.elements()), np.uint64))
            for start in range(len(hashes) - n + 1):
                window = hashes[start : start + n]
                value = index.similarity(window, row)
                if value >= 0.5 and int(own ^ majority(window)).bit_count() <= dc.RADIUS and value > want.get(row, (0.0, 0, 0))[0]:
                    want[row] = (value, start, n)
        assert index.find(text, 0.5) == [(index.ids[r], s, n, v) for r, (v, s, n) in sorted(want.items())] != []
    monkeypatch.setattr(dc.np, "unpackbits", None)
    assert index.find(far) == []
