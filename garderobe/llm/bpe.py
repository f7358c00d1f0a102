"""Byte-level BPE of whole texts: long texts are cut into overlapping chunks, which are cut into pre-tokens in parallel
and stitched where neighbours agree on a boundary again; token numbers turn back into bytes by concatenation."""

from __future__ import annotations

import base64
import re
from functools import cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm.common import Stash

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK = 16_384
OVERLAP = 512
#: Texts that don't agree within the overlap are cut again into chunks and overlaps larger by this factor.
GROW = 8
#: Pre-tokens whose numbers a task remembers; the memory is emptied beyond, which changes no result.
REMEMBERED = 100_000
LONGEST_REMEMBERED = 64
#: Rows of a batch that are encoded or decoded at once.
ROWS = 500
#: Before the end of an unfinished window a boundary may still move: the last two pre-tokens and three characters.
LOOSE_TOKENS, LOOSE_CHARACTERS = 2, 3


def public_vocabulary() -> tuple[str, str]:
    """Path of the public rank file on the driver, and the pattern that belongs to it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}


@cache
def stand_ins() -> dict[int, str]:
    """Characters that the two regular-expression libraries put into different classes, as their Unicode versions
    differ, and for each a character of the class that the encoding library sees."""
    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ours, theirs = {}, {}
    for kind, sample in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", " ")):
        encoding = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
        ours.update(dict.fromkeys(regex.findall(kind, every), sample))
        theirs.update(dict.fromkeys(bytes(encoding.encode_ordinary(every)).decode(), sample))
    return {ord(c): theirs.get(c, "#") for c in ours.keys() | theirs.keys() if ours.get(c) != theirs.get(c)}


class PreTokens:
    """Cuts texts at the matches of ``pattern``, which leave no gap."""

    def __init__(self, pattern: str, odd: dict[int, str]):
        import regex

        self.find, self.odd = regex.compile(pattern).findall, odd
        low = "".join(chr(c) for c in sorted(odd) if c <= 0xFFFF)  # a bit map; rare characters above are looked up one by one
        self.rare = [re.compile(f"[{low}]").search] * bool(low) + [re.compile("[\U00010000-\U0010ffff]").search] * bool(odd)

    def masked(self, text: str) -> str:
        if text.isascii() or not any(search(text) for search in self.rare):
            return text
        return text.translate(self.odd)

    def pieces(self, text: str) -> list[str]:
        masked = self.masked(text)
        found = self.find(masked)
        if masked is text:
            return found
        ends = list(accumulate(map(len, found)))
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ends(self, text: str) -> np.ndarray:
        return np.fromiter(accumulate(map(len, self.find(self.masked(text)))), np.int32)


class Numbers(dict):
    """Pre-token to its token numbers (int32 bytes), made on first use."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        super().__init__()
        self.encode = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.encode(piece), np.int32).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def each(self, pieces: list[str]) -> list[bytes]:
        return list(map(self.__getitem__, pieces))


def lists(blobs: list[bytes]) -> pa.ListArray:
    """int32 bytes of each row as one list column."""
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def cut_texts(batches, size: int, overlap: int):
    """(key, chunk, complete, text) of every chunk; ``complete`` if its window ends with the text."""
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            starts = range(0, len(text), size)
            for first in range(0, len(starts), 256):  # some megabytes at a time
                some = starts[first : first + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(some), pa.string()),
                        pa.array(range(first, first + len(some)), pa.int32()),
                        pa.array([s + size + overlap >= len(text) for s in some], pa.bool_()),
                        pa.array([text[s : s + size + overlap] for s in some], pa.string()),
                    ],
                    ["key", "chunk", "complete", "text"],
                )


def settled_ends(ends: np.ndarray, text: str, complete: bool) -> np.ndarray:
    if complete:
        return ends
    ends = ends[: max(0, len(ends) - LOOSE_TOKENS)]
    return ends[ends <= len(text) - LOOSE_CHARACTERS]


def in_parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_chunks(batches, ranks, odd, pattern: str, size: int, overlap: int):
    """Cuts each chunk into pre-tokens, finds ``sync``, the first boundary behind the next chunk's beginning on which both
    agree (null at the end of the text; ``open`` if the overlap has none), and numbers its pre-tokens up to there.

    From a common boundary on both find the same pre-tokens, for the pattern never looks back. ``head`` and ``before``
    hold the boundaries inside the chunk's own first ``overlap`` and the numbers ahead of each, so that the chunk's
    beginning can be dropped once the chunk before says where it ends.
    """
    cutter, numbers = PreTokens(pattern, odd.value), Numbers(ranks.value)
    for batch in in_parts(batches):
        columns = {c: [] for c in ("ids", "head", "before", "sync", "open")}
        for text, complete in zip(batch.column("text"), batch.column("complete").to_pylist(), strict=True):
            text = text.as_py()
            ends, sync, last = settled_ends(cutter.ends(text), text, complete), None, len(text) <= size
            if not last:
                beyond = text[size:]
                theirs = settled_ends(cutter.ends(beyond), beyond, complete)
                common = np.intersect1d(ends - size, np.concatenate([[0], theirs]))
                sync = int(common[0]) if len(common) else None
            stop = len(text) if last else -1 if sync is None else size + sync
            edges = [0, *ends[ends <= stop].tolist()]
            blobs = numbers.each([text[a:b] for a, b in zip(edges, edges[1:], strict=False)])
            heads = [e for e in edges if e <= overlap]
            counts = [0, *accumulate(len(b) // 4 for b in blobs[: len(heads) - 1])]
            for c, x in zip(columns, (b"".join(blobs), np.array(heads, np.int32).tobytes(), np.array(counts, np.int32).tobytes(), sync, not last and sync is None), strict=True):
                columns[c].append(x)
        arrays = [lists(columns[c]) for c in ("ids", "head", "before")] + [pa.array(columns["sync"], pa.int32()), pa.array(columns["open"], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), *arrays], ["key", "chunk", *columns])


def stitch(chunks: DataFrame) -> DataFrame:
    """(key, ids): the chunks of a text one after another, each from where the one before ends."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "sync", "head", "before", "ids")))

    def own(x, i):
        seam = F.get(F.col("parts"), i - 1)["sync"]
        skip = F.when(i == 0, 0).otherwise(F.get(x["before"], (F.array_position(x["head"], seam) - 1).cast("int")))
        return F.slice(x["ids"], skip + 1, F.size(x["ids"]))

    return chunks.groupBy("key").agg(parts.alias("parts")).select("key", F.flatten(F.transform("parts", own)).alias("ids"))


def encode_texts(batches, ranks, odd, pattern: str):
    cutter, numbers = PreTokens(pattern, odd.value), Numbers(ranks.value)
    for batch in in_parts(batches):
        blobs = [b"".join(numbers.each(cutter.pieces(text.as_py() or ""))) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(blobs)], ["doc_id", "ids"])


def encode_long(texts: DataFrame, ranks, odd, pattern: str, size: int, overlap: int) -> DataFrame:
    """(key, ids) of the distinct ``texts`` (key, text). Chunks of equal texts are one row from the start, and only they
    and their numbers travel. Texts with a seam that stays open are cut again, larger, until none is left: a text that is
    one chunk has no seam."""
    stash, pending, done = Stash(texts.sparkSession), texts, []
    while True:
        chunks = pending.mapInArrow(partial(cut_texts, size=size, overlap=overlap), "key string, chunk int, complete boolean, text string")
        chunks = chunks.groupBy("key", "chunk").agg(F.first("complete").alias("complete"), F.first("text").alias("text"))
        coded = chunks.mapInArrow(
            partial(encode_chunks, ranks=ranks, odd=odd, pattern=pattern, size=size, overlap=overlap),
            "key string, chunk int, ids array<int>, head array<int>, before array<int>, sync int, open boolean",
        )
        coded = stash.keep(coded)
        loose = coded.where("open").select("key").distinct()
        if coded.where("open").isEmpty():
            done.append(coded)
            break
        done.append(coded.join(loose, "key", "left_anti"))
        pending, size, overlap = pending.join(loose, "key", "left_semi"), size * GROW, overlap * GROW
    found = stitch(done[0])
    for more in done[1:]:
        found = found.unionByName(stitch(more))
    return found


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``, as the encoding library numbers its whole text.

    A text of one chunk is encoded where it lies. The chunks of longer ones are spread over all tasks, under the SHA-256
    of their text, so that copies are encoded once and neither ids nor their absence matter; the numbers of a text meet
    again in one row, like the text. Null counts as the empty text and has no numbers; null and repeated ids keep a row
    each; an empty table gives no rows; other columns are not read.
    """
    path, own_pattern = public_vocabulary() if vocabulary is None or pattern is None else (None, None)
    context = docs.sparkSession.sparkContext
    ranks = context.broadcast(read_ranks(vocabulary or path))  # fixed size: the vocabulary
    odd = context.broadcast(stand_ins())  # fixed size: characters of Unicode
    pattern = pattern or own_pattern
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wide = F.coalesce(F.length("text"), F.lit(0)) > size
    short = own.where(~wide).mapInArrow(partial(encode_texts, ranks=ranks, odd=odd, pattern=pattern), "doc_id long, ids array<int>")
    long = own.where(wide).withColumn("key", F.sha2("text", 256))
    found = encode_long(long.select("key", "text"), ranks, odd, pattern, size, overlap)
    return short.unionByName(long.select("doc_id", "key").join(found, "key").select("doc_id", "ids"))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the bytes of the numbers, one after another. Null ids give null; bytes
    need not be valid UTF-8 for numbers that don't come from a text."""
    table = {rank: token for token, rank in read_ranks(vocabulary or public_vocabulary()[0]).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        token = shared.value.__getitem__
        for batch in in_parts(batches):
            out = [b"".join(map(token, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else None for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def coded_documents(docs: DataFrame) -> DataFrame:
    """The digest of the registered query."""
    out = decode(encode(docs))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
