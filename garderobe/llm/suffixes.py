"""Suffix-array removal: maximal repeats from common-prefix intervals of an enhanced suffix array, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.llm.blocks import NO_ID, Shape, covered, finish, first_of_runs, owned_blocks, slices, span_arrays
from garderobe.llm.common import Stash, raw

WIDTH = 50
ANCHOR = 20
#: Rows of blocks found for each bucket of slices.
SLICES_AT_ONCE = 200_000


def suffix_array(texts: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of at least ``width`` bytes of each text: (text, offset, common prefix with the one before, left byte).

    Texts of different groups have no common prefix. The left byte is -1 at the begin of a text.
    """
    longest = max(map(len, texts))
    pad = b"\0" * longest
    data = np.frombuffer(b"".join(t + pad for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes + longest) - (sizes + longest)
    many = np.maximum(sizes - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = base[text] + offset
    rows = np.empty((len(at), longest + 4), np.uint8)
    rows[:, :4] = group[text].astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, longest)[at]
    order = np.argsort(rows.view(f"S{longest + 4}").ravel(), kind="stable")
    rows, text, offset, at = rows[order], text[order], offset[order], at[order]
    differ = rows[1:] != rows[:-1]
    equal = np.where(differ.any(axis=1), differ.argmax(axis=1), longest + 4)
    left_over = sizes[text] - offset
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = np.where(equal < 4, 0, np.minimum(np.minimum(equal - 4, left_over[1:]), left_over[:-1]))
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    return text, offset, lcp, left


def maximal_repeats(lcp: list[int], left: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of sorted suffixes with a common prefix of ``width`` or more that can't be
    extended to the left. A stack scan closes an interval of the tree when the common prefix falls below its length;
    it is left-diverse when two left bytes differ or one occurrence begins a text."""

    def joined(a: int, b: int) -> int:
        return a if a == b and a >= 0 else -1

    n = len(lcp)
    stack: list[list[int]] = []  # length, first suffix, common left byte or -1
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        depth = depth if depth >= width else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            length, first, held = stack.pop()
            byte = joined(held, byte)
            if byte < 0:
                yield length, first, i - 1
        if stack and stack[-1][0] == depth:
            stack[-1][2] = joined(stack[-1][2], byte)
        elif depth:
            stack.append([depth, first, byte])


def repeat_groups(lcp: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, group, suffix): the maximal repeats with all their occurrences, group by group, as places in the suffix
    array. Only stretches of the array with long common prefixes are scanned."""
    long = np.flatnonzero(lcp >= width)
    found = []
    for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1) if len(long) else []:
        a = int(run[0]) - 1
        found += [(n, a + i, a + j) for n, i, j in maximal_repeats(lcp[a : a + len(run) + 1].tolist(), left[a : a + len(run) + 1].tolist(), width)]
    length, first, last = np.array(found, np.int64).reshape(-1, 3).T
    many = last - first + 1
    group = np.repeat(np.arange(len(many)), many)
    return length, group, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[group]


def later_parts(texts: list[bytes], group: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of the parts of each text that a maximal repeat shares with an owner before its own."""
    text, offset, lcp, left = suffix_array(texts, group, width)
    length, repeat, suffix = repeat_groups(lcp, left, width)
    if not len(length):
        return (np.empty(0, np.int64),) * 3
    has = owner[text[suffix]]
    first = np.minimum.reduceat(has, np.flatnonzero(first_of_runs(repeat)))
    loses = has > first[repeat]
    most = np.zeros(len(text), np.int64)
    np.maximum.at(most, suffix[loses], length[repeat[loses]])
    lost = np.flatnonzero(most)
    steps = np.zeros((len(texts), max(map(len, texts)) + 2), np.int32)
    np.add.at(steps, (text[lost], offset[lost] + 1), 1)
    np.add.at(steps, (text[lost], offset[lost] + 1 + most[lost]), -1)
    inside = np.cumsum(steps, axis=1) > 0
    row, begin = np.nonzero(inside[:, 1:] & ~inside[:, :-1])
    _, end = np.nonzero(inside[:, :-1] & ~inside[:, 1:])
    return row, begin, end - begin


def resolve(table: pa.Table) -> pa.Table:
    """Spans that owners lose, from a bucket of slices (anchor, doc_id, variant, start, content). Equal slices of an
    anchor are one text with one owner; the texts of an anchor meet in a suffix array."""
    anchor = table.column("anchor").to_numpy()
    contents = table.column("content").to_pylist()
    index: dict[tuple[int, bytes], int] = {}
    text_of = np.array([index.setdefault(k, len(index)) for k in zip(anchor.tolist(), contents, strict=True)], np.int64)
    keys = list(index)
    doc, variant, at = (table.column(c).to_numpy() for c in ("doc_id", "variant", "start"))
    owners = np.full(len(keys), NO_ID)
    np.minimum.at(owners, text_of, doc)
    names = np.array([a for a, _ in keys], np.int64)
    order = np.argsort(names, kind="stable")
    rows = np.argsort(text_of, kind="stable")
    first_row = np.searchsorted(text_of[rows], np.arange(len(keys)))
    many_rows = np.bincount(text_of, minlength=len(keys))
    out = [(doc[:0], variant[:0], at[:0], at[:0])]
    for batch in _batches(np.split(order, np.flatnonzero(np.diff(names[order])) + 1), 10_000):
        group = np.cumsum(first_of_runs(names[batch])) - 1
        text, start, size = later_parts([keys[b][1] for b in batch.tolist()], group, owners[batch], WIDTH)
        b = batch[text]
        times = many_rows[b]
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        own = rows[np.repeat(first_row[b], times) + turn]
        out.append((doc[own], variant[own], at[own] + np.repeat(start, times), np.repeat(size, times)))
    doc, variant, start, size = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"doc_id": doc, "variant": variant, "start": start.astype(np.int64), "size": size.astype(np.int64)})


def _batches(parts: list[np.ndarray], least: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _digest(batches):
    for batch in batches:
        texts, starts, sizes = batch.column("text"), batch.column("starts"), batch.column("sizes")
        ids, out = batch.column("doc_id").to_pylist(), []
        for i, doc_id in enumerate(ids):
            data = raw(texts[i].as_py())
            gone = covered(len(data), span_arrays(i, starts), span_arrays(i, sizes))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
            out.append((doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)


def repeated_bytes(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(documents told apart, spans (doc_id, variant, start, size) of bytes that a smaller doc_id has as well).

    Equal blocks are compared by hashes; all documents but the smallest lose them. Different blocks of one anchor are
    cut out of the owners' texts and meet in suffix arrays. The texts are hashed by document once: both joins of the
    plan use that exchange.
    """
    stash = Stash(docs.sparkSession)
    apart, found = owned_blocks(docs, Shape(WIDTH, ANCHOR, False), stash, **options)
    cut = slices(apart, found.where("anchor IS NOT NULL"))
    rest = cut.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(max(8, found.count() // SLICES_AT_ONCE)))).applyInArrow(resolve, "doc_id long, variant long, start long, size long")
    return apart, found.where("anchor IS NULL").drop("anchor").unionByName(rest)


def remove_repeated_bytes(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept_sha256, after removing every byte covered by a
    50-byte string that also starts in a document with a smaller doc_id.

    Null text is empty and nothing is removed from texts under 50 bytes. A null doc_id counts as the largest, so it
    loses what any other document has and rows without id keep what they share with each other. Rows that repeat an id
    don't remove each other. Very long texts are read in whole; an empty table gives no rows.
    """
    apart, spans = repeated_bytes(docs.select("doc_id", "text"), **options)
    return finish(apart, spans, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
