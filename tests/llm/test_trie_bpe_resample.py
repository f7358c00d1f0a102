"""Prefix trie, byte-level BPE in chunks and importance resampling against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from garderobe.llm import bpe, prefixes, resample
from garderobe.llm.common import Stash
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_importance_median"])
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), name, SF) is None


# --- prefixes


def plain_nodes(sequences):
    """{(conv_id, depth): the other columns} of {conv_id: [(role, text), ...]}, prefix by prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        s = tuple(sequences[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    out = {}
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[m[0], len(p)] = (members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], digest)
    return out


def got_nodes(df):
    rows = df.collect()
    out = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


def in_order(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}


def rebuild(original):
    out = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        out[c] = original.get(base, [])[:h] + own[h:]
    return out


CONV = "conv_id long, turn long, role string, text string"


def test_rebuilt_conversations_with_odd_rows(spark):
    rows = [(c, t, ("user", "bot")[t % 2], f"words of turn {t} {'x' if c % 7 else 'y'}") for c in range(60) for t in range(c % 6)]
    rows += [(0, None, None, None), (0, None, "user", ""), (40, 1, "bot", "words"), (40, 1, "bot", "words"), (41, 0, None, "a\tb\nc")]
    rows += [(None, 0, "user", "nobody"), (-5, 0, "user", "below"), (-5, 1, None, None), (1 << 40, 0, "user", "words"), (63, 7, "user", "alone")]
    df = spark.createDataFrame(rows, CONV).select("*", *[F.lit(1).alias(c) for c in ("low", "high", "print", "sid", "depth", "block")])
    assert got_nodes(prefixes.rebuilt_nodes(df)) == plain_nodes(rebuild(in_order(rows)))
    assert got_nodes(prefixes.conversation_nodes(df)) == plain_nodes(in_order(rows))
    assert prefixes.rebuilt_nodes(df.limit(0)).count() == 0


def test_deep_tries(spark, monkeypatch):
    """Long conversations over two kinds of turns branch off everywhere; windows of four turns, lists of three ids."""
    monkeypatch.setattr(prefixes, "SPAN", 4)
    monkeypatch.setattr(prefixes, "LISTED", 3)
    rng = random.Random(4)
    rows, spine = [], [rng.choice("ab") for _ in range(70)]
    for c in range(80):
        turns = spine[: rng.randrange(71)] + [rng.choice("ab") for _ in range(rng.randrange(4))] if c % 2 else [rng.choice("ab") for _ in range(rng.randrange(9))]
        rows += [(c, t, "user", x) for t, x in enumerate(turns)]
    rows += [(c, t, "user", x) for c in range(100, 120) for t, x in enumerate(spine)]
    df = spark.createDataFrame(rows, CONV)
    assert got_nodes(prefixes.conversation_nodes(df)) == plain_nodes(in_order(rows))


def test_fattest_number(spark):
    cases = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    df = spark.createDataFrame(cases, "low long, high long").select("low", "high", prefixes.fattest("low", "high").alias("f"))
    for r in df.collect():
        assert r["f"] == max(range(r["low"] + 1, r["high"] + 1), key=lambda x: x & -x)


# --- byte-level BPE


def plain_encoding():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


ODD_TEXTS = [
    None,
    "",
    " ",
    "  \n\n  ",
    "I'll we've don't 'twas it's 're 'r e",
    "a" * 5000,
    " " * 3000 + "x",
    "!?" * 700 + "'s" + "é" * 900,
    "naïve Größe 東京 ไทยภาษา 𝒳𝓎 ՘࢏ x౜y 🙂🙂 ١٢٣ ½",
    "tab\tand\r\nline  two   three    four  　 wide",
    "word " * 4000,
    "<|endoftext|>",
]


def digest(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("size,overlap", [(bpe.CHUNK, bpe.OVERLAP), (7, 3), (64, 16)])
def test_encoding_equals_the_library(spark, size, overlap):
    rng = random.Random(size)
    alphabet = ["  ", "\n", "a", "B", "'", "s", "'ll", "7", "é", "ß", "東", "!", " the", "՘", "🙂", "\t "]
    texts = ODD_TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(400))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id " * 30), (None, "no id " * 30), (3, "same id"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("ids", "key", "chunk", "ends", "start")])
    plain = plain_encoding()
    out = bpe.decode(bpe.encode(df, size=size, overlap=overlap)).collect()
    got = sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in out)
    assert got == sorted((str(d), plain.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert bpe.encode(df.limit(0), size=size, overlap=overlap).count() == 0


def test_registered_encoding_equals_the_library(spark):
    plain = plain_encoding()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (len(ids), digest(ids), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows for ids in [plain.encode_ordinary(t or "")]}
    got = {r[0]: tuple(r[1:]) for r in entrypoint.queries()["op12_chunked_bpe"](spark, SF).collect()}
    assert got == want


def test_decoding_of_other_numbers(spark):
    df = spark.createDataFrame([(1, [220, 220]), (2, []), (3, None)], "doc_id long, ids array<int>")
    ranks = {v: k for k, v in bpe.read_ranks(bpe.public_vocabulary()[0]).items()}
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df).collect()}
    assert got == {1: ranks[220] * 2, 2: b"", 3: None}


# --- importance resampling


def plain_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


def plain_draw(docs, bench):
    held = [(d, plain_buckets(t), len(plain_words(t))) for d, t in docs]
    source, target = Counter(b for _, f, _ in held for b in f), Counter(b for _, t in bench for b in plain_buckets(t))
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows, able = [], []
    for d, f, n in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None])
        able += [rows[-1]] if n >= 20 else []
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i in range(25 * len(able) // 100):
        able[i][4] = i + 1
    return sorted(map(tuple, rows), key=str)


def test_draw_equals_plain(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["Größe", "É", "東京", "it's", "9,5", "--"]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for d in range(900)]
    docs += [(None, "same words " * 20)] * 40 + [(5, "other words " * 15), (5, None), (None, None), (901, ""), (902, " \x00-" * 30), (903, "z" * 100)]
    docs += [(904, " ".join(rng.choices(vocabulary, k=200_000)))]
    bench = [(1, "w1 w2 w3 Größe w4"), (2, None), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("weight", "score", "rank", "k_id", "part", "bucket")])
    target = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, resample.drawn_documents(df, target).collect()), key=str)
    assert got == plain_draw(docs, bench)
    assert resample.drawn_documents(df.limit(0), target).count() == 0
    assert resample.drawn_documents(df, target.limit(0)).count() == len(docs)
    few = df.where("doc_id in (901, 902, 903)")
    assert {r["rank"] for r in resample.drawn_documents(few, target).collect()} == {None}


def test_features_of_pieces():
    text = ("The  quick-brown fox, 12 É東 " * 50).encode()
    whole = [sorted(h for part in resample.feature_hashes(text, size) for both in part for h in both.tolist()) for size in (1 << 20, 1, 7, 50)]
    w = plain_words(text.decode())
    assert all(x == sorted(zlib.crc32(f.encode()) for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]) for x in whole)


def test_cutoff_is_exact_with_ties(spark):
    rng = random.Random(1)
    keys = [(rng.choice([0, 0, 0, 1, 5, rng.randrange(1000)]), rng.randrange(2), rng.randrange(3), 0, i) for i in range(3000)]
    df = spark.createDataFrame(keys, ", ".join(f"{k} long" for k in resample.KEY)).repartition(7)
    stash = Stash(spark)
    df = stash.keep(df)
    order = sorted(keys)
    for want in (1, 2, 750, 1500, 2999, 3000):
        assert resample.cutoff(df, stash, want, few=1) == order[want - 1]
    assert resample.cutoff(df, stash, 0) is None and resample.cutoff(df, stash, 3001) is None
