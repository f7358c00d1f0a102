"""Repeated windows by local anchors: the distributed part that substring and suffix-array removal share.

A window is ``width`` consecutive units (bytes or words) of one document. Its anchor is the smallest hash among its
runs of ``k`` units, so equal windows have equal anchors wherever they stand. Neighbouring windows with one anchor
form a block. Only anchors that occur twice anywhere can belong to repeated windows; they are found first, with hashes
alone, and only their blocks travel on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm.common import Stash, raw

PASS_UNITS = 1 << 20
CHUNK_ANCHORS = 1_000_000
#: Anchors per bucket aimed at; buckets grow with the input.
BUCKET_ANCHORS = 250_000
#: Anchors with so many different blocks in the sixteenth of the documents that is looked at are compared by window.
CROWD = 200
MOST_CROWDED = 10_000
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Shape:
    """What a window is: its width, the run length of its anchors, and the units of a text."""

    width: int
    k: int
    words: bool

    def units(self, text: str | None) -> np.ndarray:
        data = raw(text)
        if self.words:
            return np.array([xxhash.xxh64_intdigest(w) for w in data.split()], np.uint64)
        return np.frombuffer(data, np.uint8).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019))


def run_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive units, put together from runs of powers of two."""
    part, size, out, done = x, 1, None, 0
    while done < k:
        if k & size:
            if out is None:
                out = part
            else:
                n = max(0, min(len(out), len(part) - done))
                out = chain(out[:n], part[done : done + n])
            done += size
        if done < k:
            part = chain(part[: len(part) - size], part[size:]) if len(part) > size else part[:0]
            size *= 2
    return out


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n, done = len(x), 1
    if n < w:
        return x[:0]
    while done * 2 <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: n - w + 1], x[w - done :][: n - w + 1]) if done < w else x


def find_blocks(x: np.ndarray, lengths: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of documents laid end to end in ``x``: (anchor, document, start in it, windows in the block)."""
    ends = np.cumsum(lengths)
    low = slide_min(run_hashes(mix(x + np.uint64(1)), shape.k), shape.width - shape.k + 1)
    if not len(low):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[: len(low)] == owner[shape.width - 1 :][: len(low)]
    change = np.empty(len(low), bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | ~inside[1:] | ~inside[:-1]
    begin = np.flatnonzero(change)
    many = np.diff(np.append(begin, len(low)))
    begin, many = begin[inside[begin]], many[inside[begin]]
    pieces = (many - 1) // shape.width + 1  # a long run of one anchor, as in periodic text, is cut
    turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(begin, pieces) + turn * shape.width
    many = np.minimum(np.repeat(many, pieces) - turn * shape.width, shape.width)
    doc = owner[start]
    return low[start], doc, start - (ends - lengths)[doc], many


def self_repeats(x: np.ndarray, lengths: np.ndarray, doc: np.ndarray, start: np.ndarray, many: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether a block may hold one window twice: near equal runs inside it. Never false where it does."""
    runs = run_hashes(mix(x + np.uint64(1)), shape.k)
    twin = np.zeros(len(runs) + 1, np.int64)
    for step in range(1, min(shape.width, len(runs))):
        twin[1 : len(runs) - step + 1] |= runs[step:] == runs[:-step]
    twin = np.cumsum(twin)
    at = (np.cumsum(lengths) - lengths)[doc] + start
    return twin[np.minimum(at + many + shape.width - shape.k, len(runs))] > twin[at]


def passes(table, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Slices of a record batch of about PASS_UNITS units: (units, lengths, first row, row after the last)."""
    texts = table.column("text")
    held, size, first = [], 0, 0
    for i in range(len(texts)):
        held.append(shape.units(texts[i].as_py()))
        size += len(held[-1])
        if size >= PASS_UNITS or i == len(texts) - 1:
            yield np.concatenate(held), np.array([len(h) for h in held], np.int64), first, i + 1
            held, size, first = [], 0, i + 1


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, byte plane by byte plane: equal high bytes then cost nothing in a compressed shuffle."""
    head = np.array([len(columns[0]), *[c.dtype.itemsize for c in columns]], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, len(kinds) + 1)
    n, at, out = int(head[0]), 8 * (len(kinds) + 1), []
    for size, kind in zip(head[1:].tolist(), kinds, strict=True):
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any of the sorted ``keys``."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


KINDS = [np.uint64, np.int64, np.int64, np.int32, np.uint8]  # anchor, doc_id, variant, start, state
ONE, MANY, KNOWN = 0, 1, 2


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("variant").to_numpy(zero_copy_only=False)


def _anchor_rows(shape: Shape, buckets: int) -> Callable:
    """Anchors of a partition as blobs by bucket. Within a chunk an anchor goes out once, marked MANY if it came more
    often; its other places are then KNOWN to repeat and only pass through, dealt over all buckets. Repeats inside one
    document count for words only: bytes are compared between documents."""

    def flush(parts):
        anchor, doc, variant, start, again = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, doc, variant, start, again = anchor[order], doc[order], variant[order], start[order], again[order]
        new = first_of_runs(anchor)
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        state = np.full(len(anchor), KNOWN, np.uint8)
        state[new] = np.where((size > 1) | again[new], MANY, ONE)
        spread = np.where(state == KNOWN, mix(doc.view(np.uint64) + np.uint64(7)), mix(anchor))
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = np.split(order, cuts)
        blobs = [pack([anchor[r], doc[r], variant[r], start[r].astype(np.int32), state[r]]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[r[0]]) for r in rows], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, variants = _ids(batch)
            for x, lengths, first, last in passes(batch, shape):
                anchor, doc, start, many = find_blocks(x, lengths, shape)
                if len(anchor):
                    again = self_repeats(x, lengths, doc, start, many, shape) if shape.words else np.zeros(len(anchor), bool)
                    parts.append((anchor, ids[first:last][doc], variants[first:last][doc], start, again))
                    held += len(anchor)
            if held >= CHUNK_ANCHORS:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket, the places whose anchor occurs twice."""
    parts = [unpack(b.as_py(), KINDS) for b in table.column("blob")]
    anchor, doc, variant, start, state = (np.concatenate(c) for c in zip(*parts, strict=True))
    known = state == KNOWN
    order = np.argsort(anchor[~known], kind="stable")
    sent = np.flatnonzero(~known)[order]
    new = first_of_runs(anchor[sent])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1 + (state[sent] == MANY)) if len(sent) else np.empty(0)
    keep = np.concatenate([np.flatnonzero(known), sent[total[group] > 1]])
    return pa.table({"doc_id": doc[keep], "variant": variant[keep], "start": start[keep]})


def told_apart(docs: DataFrame, stash: Stash) -> DataFrame:
    """(doc_id, variant, text) with a null id as the largest. ``variant`` tells the texts of one id apart by numbers given
    once to each (id, SHA-256 of the text) and written down; it is 0 where an id has one text, and negative for rows
    without id. Equal rows are told apart nowhere; they get equal results."""
    nameless = F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long")
    slim = docs.select(F.coalesce("doc_id", F.lit(int(NO_ID))).cast("long").alias("doc_id"), nameless.alias("variant"), "text")
    seen = slim.select("doc_id", F.xxhash64("variant", "text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    clash = stash.keep(seen.where("lo <> hi").select("doc_id"))
    if not clash.head(1):
        return slim
    digest = F.when(F.col("clash"), F.coalesce(F.sha2("text", 256), F.lit("")))
    mixed = slim.join(clash.withColumn("clash", F.lit(True)), "doc_id", "left").select("doc_id", "variant", "text", digest.alias("digest"))
    names = mixed.where("digest is not null").select("doc_id", "variant", "digest").distinct()
    names = stash.keep(names.withColumn("number", F.monotonically_increasing_id() + 1))
    number = F.when(F.col("number").isNull(), F.col("variant")).when(F.col("variant") < 0, -1 - F.col("number")).otherwise(F.col("number"))
    return mixed.join(names, ["doc_id", "variant", "digest"], "left").select("doc_id", number.alias("variant"), "text")


def bucket_count(docs: DataFrame, shape: Shape) -> int:
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    per_block = (shape.width - shape.k + 2) / 2 * (6 if shape.words else 1)
    return max(8, int(total / per_block / BUCKET_ANCHORS) + 1)


def crowded_anchors(docs: DataFrame, shape: Shape, crowd: int = CROWD) -> np.ndarray:
    """Anchors that stand in very many different blocks, as inside a common short phrase. They are looked for in one
    sixteenth of the documents: the answer only decides how a block is compared, by window or whole, never whether."""

    def run(batches):
        for batch in batches:
            for x, lengths, _, _ in passes(batch, shape):
                anchor, doc, start, many = find_blocks(x, lengths, shape)
                if not len(anchor):
                    continue
                at = (np.cumsum(lengths) - lengths)[doc] + start
                whole = run_hashes(mix(x + np.uint64(1)), shape.width)
                block = chain(chain(whole[at], whole[at + many - 1]), many.astype(np.uint64))
                order = np.lexsort((block, anchor))
                new = first_of_runs(anchor[order], block[order])
                found, n = np.unique(anchor[order][new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], ["anchor", "n"])

    looked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0)
    counts = looked.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= crowd)
    rows = counts.orderBy(F.desc("n")).limit(MOST_CROWDED).collect()  # at most MOST_CROWDED numbers
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(np.uint64))


def one_by_one(anchor, doc, start, many, whole, base, crowded):
    """Blocks of crowded anchors taken apart: each window is a block of its own under a hash of itself and the anchor, so
    that equal ones of these new anchors and equal windows together still mean equal anchors."""
    if not len(crowded):
        return anchor, doc, start, many
    single = crowded[np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)] == anchor
    times = np.where(single, many, 1)
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    anchor, doc, start, many, single = (np.repeat(c, times) for c in (anchor, doc, start, many, single))
    start = start + np.where(single, turn, 0)
    return np.where(single, chain(anchor, whole[base[doc] + start]), anchor), doc, start, np.where(single, 1, many)


def _block_rows(shape: Shape, buckets: int, crowded: np.ndarray, slices: bool) -> Callable:
    """Of documents with the starts of their repeated blocks: those blocks by bucket of their anchor.

    A block of a crowded anchor goes out window by window, under a hash of anchor and window instead of the anchor.
    ``payload`` is the content: the bytes of a block, or the hashes of its windows. A block that comes several times
    in a batch of documents sends its content once.
    """

    def run(batches):
        for batch in batches:
            ids, variants = _ids(batch)
            starts = batch.column("starts")
            for x, lengths, first, last in passes(batch, shape):
                anchor, doc, start, many = find_blocks(x, lengths, shape)
                if not len(anchor):
                    continue
                wanted = [starts[i].values.to_numpy() if starts[i].is_valid else np.empty(0, np.int64) for i in range(first, last)]
                own = np.repeat(np.arange(last - first), [len(w) for w in wanted]) << 40 | np.concatenate(wanted).astype(np.int64)
                keep = np.isin((doc << 40) | start, own)
                anchor, doc, start, many = anchor[keep], doc[keep], start[keep], many[keep]
                if not len(anchor):
                    continue
                base = np.cumsum(lengths) - lengths
                whole = run_hashes(mix(x + np.uint64(1)), shape.width)
                anchor, doc, start, many = one_by_one(anchor, doc, start, many, whole, base, crowded)
                at = base[doc] + start
                block = chain(chain(whole[at], whole[at + many - 1]), many.astype(np.uint64))
                order = np.lexsort((start, variants[first:last][doc], ids[first:last][doc], block, anchor))
                anchor, block, doc, start, many, at = (c[order] for c in (anchor, block, doc, start, many, at))
                if slices:
                    data = x.astype(np.uint8).tobytes()
                    content = [data[a : a + m + shape.width - 1] for a, m in zip(at.tolist(), many.tolist(), strict=True)]
                else:
                    content = [whole[a : a + m].tobytes() for a, m in zip(at.tolist(), many.tolist(), strict=True)]
                new = first_of_runs(anchor, block)
                content = [c if n else b"" for c, n in zip(content, new.tolist(), strict=True)]
                bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
                blobs, texts = [], []
                for r in rows:
                    own = [content[i] for i in r.tolist()]
                    blobs.append(pack([anchor[r], block[r], ids[first:last][doc[r]], variants[first:last][doc[r]], start[r].astype(np.int32), many[r].astype(np.uint8)]))
                    texts.append(b"".join(own))
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[r[0]]) for r in rows], pa.int64()), pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "blob", "payload"])

    return run


BLOCK_KINDS = [np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8]


@dataclass
class Bucket:
    """Blocks of one bucket, sorted by anchor, block, document and place."""

    anchor: np.ndarray
    block: np.ndarray
    doc: np.ndarray
    variant: np.ndarray
    start: np.ndarray
    many: np.ndarray
    where: dict[int, tuple[int, int, int]]
    payloads: list[bytes]

    def content(self, anchor: int, block: int) -> bytes:
        i, at, size = self.where[anchor << 64 | block]
        return self.payloads[i][at : at + size]


def read_bucket(table: pa.Table, shape: Shape, slices: bool) -> Bucket:
    parts, where, payloads = [], {}, table.column("payload").to_pylist()
    for i, blob in enumerate(table.column("blob")):
        part, at = unpack(blob.as_py(), BLOCK_KINDS), 0
        new = first_of_runs(part[0], part[1])
        for a, b, m in zip(part[0][new].tolist(), part[1][new].tolist(), part[5][new].tolist(), strict=True):
            size = m + shape.width - 1 if slices else 8 * m
            where[a << 64 | b] = (i, at, size)
            at += size
        parts.append(part)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
    return Bucket(*[c[order] for c in columns], where, payloads)


def repeated_blocks(docs: DataFrame, shape: Shape, slices: bool, resolve: Callable[[Bucket], pa.Table], schema: str, stash: Stash, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(documents hashed by id and variant, what ``resolve`` makes of each bucket of repeated blocks)."""
    apart = told_apart(docs, stash)
    buckets = bucket_count(apart, shape)
    anchors = apart.mapInArrow(_anchor_rows(shape, buckets), "bucket long, blob binary")
    places = anchors.groupBy("bucket").applyInArrow(_repeated, "doc_id long, variant long, start int")
    places = stash.keep(places)
    crowded = crowded_anchors(apart, shape, crowd)
    starts = places.groupBy("doc_id", "variant").agg(F.collect_list("start").alias("starts"))
    joined = apart.join(starts, ["doc_id", "variant"])
    blocks = joined.select("doc_id", "variant", "text", "starts").mapInArrow(_block_rows(shape, buckets, crowded, slices), "bucket long, blob binary, payload binary")
    found = blocks.groupBy("bucket").applyInArrow(lambda t: resolve(read_bucket(t, shape, slices)), schema)
    return apart, found


OWNED_KINDS = [np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8]  # ..., windows, whether KNOWN
LOW_48 = np.uint64((1 << 48) - 1)


def _owned_rows(shape: Shape, buckets: int, crowded: np.ndarray) -> Callable:
    """All blocks of a partition as blobs by bucket: 48 bits of the anchor, 48 of the content, the place.

    Of equal blocks in a chunk only those of the smallest document go to the bucket of the anchor; the others are KNOWN
    to have an earlier owner and only pass through, dealt over all buckets. Rows stay in document order and documents
    are sent as differences, which the compressed shuffle makes small.
    """

    def flush(parts):
        anchor, block, doc, variant, start, many = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((doc, block, anchor))
        new = first_of_runs(anchor[order], block[order])
        owner = doc[order][new][np.cumsum(new) - 1]
        known = np.zeros(len(doc), np.uint8)
        known[order] = doc[order] > owner
        spread = np.where(known > 0, mix(np.arange(len(doc), dtype=np.uint64)), mix(anchor))
        anchor, block = np.where(known > 0, np.uint64(0), anchor & LOW_48), np.where(known > 0, np.uint64(0), block & LOW_48)
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        blobs = [pack([anchor[r], block[r], np.diff(doc[r], prepend=0), variant[r], start[r].astype(np.int32), many[r].astype(np.uint8), known[r]]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[r[0]]) for r in rows], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, variants = _ids(batch)
            for x, lengths, first, last in passes(batch, shape):
                anchor, doc, start, many = find_blocks(x, lengths, shape)
                if len(anchor):
                    base, whole = np.cumsum(lengths) - lengths, run_hashes(mix(x + np.uint64(1)), shape.width)
                    anchor, doc, start, many = one_by_one(anchor, doc, start, many, whole, base, crowded)
                    at = base[doc] + start
                    block = chain(chain(whole[at], whole[at + many - 1]), many.astype(np.uint64))
                    parts.append((anchor, block, ids[first:last][doc], variants[first:last][doc], start.astype(np.int32), many.astype(np.uint8)))
                    held += len(anchor)
                if held >= CHUNK_ANCHORS:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _owners(shape: Shape) -> Callable:
    """Of a bucket: blocks with an earlier owner of the same content (anchor null), and the owners' blocks of every
    anchor that has several contents (with the anchor)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py(), OWNED_KINDS) for b in table.column("blob")]
        for part in parts:
            part[2] = np.cumsum(part[2])
        anchor, block, doc, variant, start, many, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        passed = np.flatnonzero(known)
        sent = np.flatnonzero(known == 0)
        sent = sent[np.lexsort((doc[sent], block[sent], anchor[sent]))]
        head = first_of_runs(anchor[sent], block[sent])
        later = doc[sent] > doc[sent][head][np.cumsum(head) - 1] if len(sent) else np.empty(0, bool)
        group = np.cumsum(first_of_runs(anchor[sent])) - 1
        contents = np.bincount(group, weights=head) if len(sent) else np.empty(0)
        mixed = sent[~later & (contents[group] > 1)] if len(sent) else sent
        gone = np.concatenate([passed, sent[later]])
        rows = np.concatenate([gone, mixed])
        names = pa.array(np.concatenate([np.zeros(len(gone), np.int64), anchor[mixed].astype(np.int64)]), mask=np.arange(len(rows)) < len(gone))
        return pa.table({"doc_id": doc[rows], "variant": variant[rows], "start": start[rows].astype(np.int64), "size": many[rows].astype(np.int64) + shape.width - 1, "anchor": names})

    return run


def owned_blocks(docs: DataFrame, shape: Shape, stash: Stash, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(documents told apart, (doc_id, variant, start, size, anchor)): see ``_owners``. One shuffle of hashes and places."""
    apart = told_apart(docs, stash)
    buckets = bucket_count(apart, shape)
    crowded = crowded_anchors(apart, shape, crowd)
    rows = apart.mapInArrow(_owned_rows(shape, buckets, crowded), "bucket long, blob binary")
    found = rows.groupBy("bucket").applyInArrow(_owners(shape), "doc_id long, variant long, start long, size long, anchor long")
    return apart, stash.keep(found)


def slices(apart: DataFrame, places: DataFrame) -> DataFrame:
    """(anchor, doc_id, variant, start, content) of the places (doc_id, variant, start, size, anchor)."""

    def run(batches):
        for batch in batches:
            names = ["anchor", "doc_id", "variant", "start", "content"]
            out = [[] for _ in names]
            texts, starts, sizes, anchors = (batch.column(c) for c in ("text", "starts", "sizes", "anchors"))
            for i, (doc, variant) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("variant").to_pylist(), strict=True)):
                data = raw(texts[i].as_py())
                for a, s, n in zip(anchors[i].as_py(), starts[i].as_py(), sizes[i].as_py(), strict=True):
                    for column, value in zip(out, (a, doc, variant, s, data[s : s + n]), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    per = places.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "size", "anchor")).alias("at"))
    parts = [F.col(f"at.{n}").alias(f"{n}s") for n in ("start", "size", "anchor")]
    joined = apart.join(per, ["doc_id", "variant"]).select("doc_id", "variant", "text", *parts)
    return joined.mapInArrow(run, "anchor long, doc_id long, variant long, start long, content binary")


def finish(apart: DataFrame, spans: DataFrame, digest: Callable, schema: str) -> DataFrame:
    """Join the removed spans (doc_id, variant, start, size) to their documents and let ``digest`` read both."""
    grouped = spans.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = apart.join(grouped, ["doc_id", "variant"], "left")
    starts = F.transform("spans", lambda s: s["start"]).alias("starts")
    sizes = F.transform("spans", lambda s: s["size"]).alias("sizes")
    return joined.select(F.when(F.col("variant") >= 0, F.col("doc_id")).alias("doc_id"), "text", starts, sizes).mapInArrow(digest, schema)


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A flag for each of ``n`` units: whether a span covers it."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(starts, n), 1)
    np.add.at(steps, np.minimum(starts + sizes, n), -1)
    return np.cumsum(steps[:-1]) > 0


def span_arrays(row, column) -> np.ndarray:
    value = column[row]
    return value.values.to_numpy().astype(np.int64) if value.is_valid else np.empty(0, np.int64)
