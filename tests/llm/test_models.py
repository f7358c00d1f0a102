"""Trained operators: exact inference, held-out accuracy; the permutation and the token round trip."""

import numpy as np
import pytest

from garderobe.llm import crf, language, quality, tokens, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths, k = np.array([1, 3, 70, 2, 32, 33]), 3
    score, trans, start = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, at = crf.marginals(score, lengths, trans, start), 0
    for n in lengths:
        s = score[at : at + n]
        fore, back = [np.exp(start + s[0])], [np.ones(k)]
        for i in range(1, n):
            fore.append((fore[-1] @ np.exp(trans)) * np.exp(s[i]))
            back.append(np.exp(trans) @ (np.exp(s[n - i]) * back[-1]))
        p = np.array(fore) * np.array(back[::-1])
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def held_out_auc(rows, score, label):
    s, y = np.array([r[score] for r in rows]), np.array([r[label] for r in rows])
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(len(s))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(s) + 0.5


def test_quality_on_held_out(tables):
    docs, labels = tables
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert held_out_auc(rows, "score", "quality") > 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_toxicity_on_held_out(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert held_out_auc(rows, "score", "toxic") > 0.95
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.01 * len(rows)


def test_language_on_held_out(tables):
    rows = language.languages(tables[0]).join(tables[0].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98


def test_language_of_switched_words():
    texts = ["the cat and the dog were here"] * 5 + ["le chat et le chien sont ici"] * 5
    model = language.train(texts, ["en"] * 5 + ["fr"] * 5, rounds=40)
    share = model.words([b"the cat and the dog le chat et le chien".split()])
    assert share[:5].argmax(axis=1).tolist() == [0] * 5 and share[5:].argmax(axis=1).tolist() == [1] * 5


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(total):
    got = tokens.slots(np.arange(total), total, key=5)
    assert sorted(got.tolist()) == list(range(total))
    assert total < 60 or (got != tokens.slots(np.arange(total), total, key=6)).any()


def test_token_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ordered = tokens.training_order(docs, length=64, per_shard=128)
    tokens.write_shards(ordered, str(tmp_path / "shards"))
    rows = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(len(r["ids"]) == 128 and r["slot"] == r["shard"] * 128 + r["place"] for r in rows)
    encoding = tokens.load(open(tokens.VOCABULARY, "rb").read())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = np.frombuffer(r["ids"], np.uint16)[: r["n_tokens"]].tolist()
    for d in docs.collect():
        ids = [i for p in sorted(pieces[d["doc_id"]]) for i in pieces[d["doc_id"]][p]]
        assert ids[-1] == tokens.END and encoding.decode(ids[:-1]) == d["text"]
    again = {r["slot"]: (r["doc_id"], r["piece"]) for r in tokens.training_order(docs, length=64, per_shard=128).collect()}
    assert again == {r["slot"]: (r["doc_id"], r["piece"]) for r in rows}


def plain_features(word, lexicon):
    out = [language.slot(np.array([language.xxhash.xxh64_intdigest(word) >> 8], np.uint64), 1)[0]]
    says = lexicon[language.crc32(word) % language.LEXICON]
    out += [language.slot(np.array([says]), 12)[0]] if says else []
    value = lambda x: np.array([int.from_bytes(x, "big")], np.uint64)
    for n in range(1, 4):
        out += [language.slot(value(x), kind + n)[0] for x, kind in ((word[:n], 1), (word[-n:], 4)) if len(word) >= n]
    return sorted(out + [language.slot(value(word[i : i + n]), 6 + n)[0] for n in range(2, 5) for i in range(len(word) - n + 1)])


def test_features_of_whole_words(monkeypatch):
    """Short, long and very long words against one n-gram after another; a long word's middle counts."""
    monkeypatch.setattr(language, "STRETCH", 50)
    lexicon = np.zeros(language.LEXICON, np.int32)
    words = ["a", "été", "word", "w" * 48, "w" * 49, "ab" * 70 + "cd" * 30, "ภาษาไทยไม่มีช่องว่าง" * 9, "他们在这里写中文" * 12]
    words = [w.encode() for w in words]
    lexicon[[language.crc32(w) % language.LEXICON for w in words[::2]]] = 2
    for w in words:
        want = plain_features(w, lexicon)
        rows = [sorted(np.concatenate(list(language.long_features(w, lexicon))).tolist())] if len(w) >= 4 else []
        rows += [sorted(x for x in language.word_features([w], lexicon)[0].tolist() if x)]
        rows += [sorted(x for x in language.word_features([w, b"x" * 60], lexicon)[0].tolist() if x)]
        assert all([x for x in r if x] == want for r in rows)
    one, two = (b"begin" * 20 + m + b"end" * 30 for m in (b"middle", b"centre"))
    assert len(one) > 190 and plain_features(one, lexicon) != plain_features(two, lexicon)
    assert sorted(np.concatenate(list(language.long_features(one))).tolist()) != sorted(np.concatenate(list(language.long_features(two))).tolist())


def test_lexicon_counts_all_rows(spark):
    rows = [("the cat the dog the", "en"), ("le chat le chien le the", "fr"), ("le", "fr"), (None, "en"), ("rare", "en"), ("both both", "en"), ("both both", "fr")]
    lexicon = language.word_lexicon(spark.createDataFrame(rows, "text string, lang string").repartition(5), ["en", "fr"])
    says = {w: lexicon[language.crc32(w) % language.LEXICON] for w in (b"the", b"le", b"rare", b"both", b"cat")}
    assert says == {b"the": 0, b"le": 2, b"rare": 0, b"both": 0, b"cat": 0}


def test_texts_without_blanks():
    thai, chinese = "ภาษาไทยเขียนติดกันไม่มีช่องว่างระหว่างคำ", "中文句子里面没有空格所以一个词就是一整句话"
    model = language.train([thai * n for n in range(1, 6)] + [chinese * n for n in range(1, 6)], ["th"] * 5 + ["zh"] * 5)
    names, _ = language.label_texts(model, ["1" * 60 + thai[5:30] + "2" * 60, "1" * 60 + chinese[3:15] + "2" * 60, thai * 5000])
    assert names == ["th", "zh", "th"]


def test_shards_resume_in_the_middle(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ordered = tokens.training_order(docs, length=64, per_shard=32)
    want = [(r["slot"], bytes(r["ids"])) for r in ordered.orderBy("slot").select("slot", "ids").collect()]
    path = str(tmp_path / "shards")
    tokens.write_strides(ordered, path)
    sizes = {(r["shard"], len(r["tokens"]), r["count"]) for r in spark.read.parquet(path).collect()}
    assert all(n == 128 * c and (c == 32 or s == len(want) // 32) for s, n, c in sizes) and len(sizes) == -(-len(want) // 32)
    for slot in (0, 45, len(want) - 1):
        got = [(r["slot"], bytes(r["ids"])) for r in tokens.read_from(spark, path, slot, 32).collect()]
        assert got == want[slot:]
    assert tokens.read_from(spark, path, 45, 32, shards=1).count() == 64 - 45
