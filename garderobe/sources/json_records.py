"""One large JSON array or object as many partitions: a data source over byte ranges that cuts at the separators of the
outermost level, whatever stands inside strings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
#: States between two bytes: outside of strings, inside one, and inside one behind a backslash that escapes.
OUT, IN, ESCAPED = 0, 1, 2
SPACE = b" \t\r\n"


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    size: int
    state: int = OUT
    depth: int = 0


def opened(path: str):
    """(file system, path in it): local paths and what Arrow's file systems reach by a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def byte_ranges(path: str, length: int) -> list[ByteRange]:
    from pyarrow import fs

    files, place = opened(path)
    info = files.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else [x for x in files.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name[:1] not in "._"]
    out = []
    for f in sorted(found, key=lambda x: x.path):
        out += [ByteRange(f.path, s, min(s + length, f.size), f.size) for s in range(0, f.size, length)]
    return out


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(depth change at each byte, whether it stands outside of strings, state behind the last byte)."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    slash = x == 0x5C
    place = np.arange(n)
    last_other = np.maximum.accumulate(np.where(slash, -1, place)) if n else place
    run = place - last_other  # backslashes in a row up to here
    carried = (last_other < 0) & (state == ESCAPED)
    odd = (run + carried) % 2 == 1
    before = np.empty(n, bool)
    if n:
        before[0], before[1:] = state == ESCAPED, odd[:-1]
    quote = (x == 0x22) & ~before
    inside = (np.cumsum(quote) + (state != OUT)) % 2 == 1  # behind the byte
    outside = ~inside & ~quote
    step = np.where(outside & ((x == 0x7B) | (x == 0x5B)), 1, 0) - np.where(outside & ((x == 0x7D) | (x == 0x5D)), 1, 0)
    end = state
    if n:
        end = OUT if not inside[-1] else ESCAPED if odd[-1] else IN
    return step.astype(np.int64), outside, end


def separators(data: bytes, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places where a record may begin (behind the opening bracket or a comma of the outermost level) and where one ends
    (at such a comma or the closing bracket), with state and depth behind the last byte."""
    step, outside, end = structure(data, state)
    level = depth + np.cumsum(step)
    x = np.frombuffer(data, np.uint8)
    comma = outside & (x == 0x2C) & (level == 1)
    opening = (step == 1) & (level == 1)
    closing = (step == -1) & (level == 0)
    return np.flatnonzero(comma | opening), np.flatnonzero(comma | closing), end, int(level[-1]) if len(level) else depth


class JsonRecords(DataSource):
    """``path`` with ``mode`` "states" (how each byte range changes depth and string state) or "records"."""

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        if self.options.get("mode") == "states":
            return "path string, start long, state int, depth int, end int"
        return "path string, position long, opening string, record string"

    def reader(self, schema):
        return JsonReader(self.options)


class JsonReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        ranges = byte_ranges(self.options["path"], int(self.options["length"]))
        known = {(p, s): (state, depth) for p, s, state, depth in json.loads(self.options.get("known", "[]"))}
        for r in ranges:
            r.state, r.depth = known.get((r.path, r.start), (OUT, 0))
        return ranges

    def read(self, r: ByteRange) -> Iterator[tuple]:
        files, _ = opened(self.options["path"])
        with files.open_input_file(r.path) as f:
            f.seek(r.start)
            data = f.read(r.stop - r.start)
            if self.options.get("mode") == "states":
                for state in (OUT, IN, ESCAPED):
                    step, _, end = structure(data, state)
                    yield r.path, r.start, state, int(step.sum()), end
                return
            begins, ends, state, depth = separators(data, r.state, r.depth)
            f.seek(0)
            opening = f.read(64).lstrip(SPACE + b"\xef\xbb\xbf")[:1].decode("latin-1")
            f.seek(r.stop)
            while len(begins) and (not len(ends) or ends[-1] <= begins[-1]):  # the last record goes on behind the range
                more = f.read(1 << 20)
                if not more:
                    break
                _, further, state, depth = separators(more, state, depth)
                if len(further):
                    ends = np.append(ends, len(data) + further[0])
                data += more
            after = np.searchsorted(ends, begins, side="right")
            for b, a in zip(begins.tolist(), after.tolist(), strict=True):
                text = data[b + 1 : int(ends[a]) if a < len(ends) else len(data)].strip(SPACE)
                if text:
                    yield r.path, r.start + b, opening, text.decode("utf-8")


def json_records(spark: SparkSession, path: str, length: int = RANGE_BYTES) -> DataFrame:
    """(path, position, opening, record): the elements of the JSON array (``opening`` "[") or the members of the object
    ("{") in each file under ``path``, as text, one partition for ``length`` bytes.

    A first pass finds for each range how it changes nesting and string state, from any state it may begin in: three rows
    for a range, put together on the driver. Then every range knows where it begins and gives the records that begin in it.
    Text that never closes what it opens is an error.
    """
    spark.dataSource.register(JsonRecords)
    source = spark.read.format("json_records").option("path", path).option("length", str(length))
    moves: dict[str, dict[int, dict[int, tuple[int, int]]]] = {}
    for r in source.option("mode", "states").load().collect():
        moves.setdefault(r.path, {}).setdefault(r.start, {})[r.state] = (r.depth, r.end)
    known = []
    for name, ranges in moves.items():
        state, depth = OUT, 0
        for start in sorted(ranges):
            known.append((name, start, state, depth))
            change, state = ranges[start][state]
            depth += change
        if state != OUT or depth != 0:
            raise ValueError(f"{name} is not a complete JSON value")
    return source.option("mode", "records").option("known", json.dumps(known)).load()
