"""S3: files that are one JSON array (or an object that holds one), read by byte ranges.

A range in the middle of a file can't tell by itself whether it starts inside a string, or in which
array. Two passes over the same ranges settle that:

1. each range is scanned under both assumptions (starts outside or inside a string): whether its
   quotes change the side, how many brackets that were open before it closes, and which it leaves
   open, with their offsets. That is a row of a few numbers a range;
2. folding these rows in file order gives each range's true start: the side and the stack of open
   brackets. A task then emits every object of the wanted array that *begins* in its range, reading
   past the range's end for the last one.

A gzip file (``.gz``) is one range: it can be read from its start only, by one task, in steps.

Both passes are scans of the data source ``json_array``, whose partitions are the ranges. What reaches the
driver is the row of a range (files and ranges are listed there anyway). Backslashes count
only inside strings, where JSON has them. Of a file with unbalanced brackets, what balances is read.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
STEP_BYTES = 4 << 20  # of a range that are looked at together
_END = 1 << 62  # of a file whose length is not known before it is read
_LOOK_BACK = 1 << 16
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_SIGNS = np.zeros(256, np.int8)
_SIGNS[list(b"{[")], _SIGNS[list(b"}]")] = 1, -1


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _compressed(path: str) -> bool:
    return path.endswith(".gz")


@contextmanager
def _reading(path: str):
    """A data file's bytes, without their compression."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        yield gzip.GzipFile(fileobj=f) if _compressed(path) else f


def exists(path: str) -> bool:
    fs, name = _open(path)
    return fs.get_file_info(name).type != pafs.FileType.NotFound


def files_of(path: str) -> list[tuple[str, int]]:
    """Data files of a file or folder, with their sizes."""
    fs, name = _open(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    root = path.rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    return sorted((root + x.path[len(name.rstrip("/")):], x.size) for x in found if x.is_file and x.size and x.base_name[0] not in "._")


def _escaped(data: np.ndarray, before: int) -> np.ndarray:
    """Mask of bytes that an odd run of backslashes precedes; ``before`` backslashes stand right before the first."""
    slash = data == 0x5C
    last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))  # latest byte that is none
    runs = np.arange(len(data)) - last_other
    runs[last_other < 0] += before
    ahead = np.r_[before, runs[:-1]] if len(data) else runs
    return ahead % 2 == 1


def _tokens(data: bytes, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of brackets, and for each whether it is inside a string if the data start outside; the last
    entry stands for the end of the data."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 0x22)
    quotes = quotes[~_escaped(b, before)[quotes]] if len(quotes) else quotes
    at = np.r_[np.flatnonzero(_SIGNS[b]), len(b)]
    return at, np.searchsorted(quotes, at) % 2 == 1


def _effect(data: bytes, at: np.ndarray, start: int) -> tuple[int, list[tuple[str, int]]]:
    """Brackets closed that were open before, and brackets left open with their offsets."""
    closed, left = 0, []
    for p in at.tolist():
        c = data[p]
        if c in b"{[":
            left.append((chr(c), start + p))
        elif left:
            left.pop()
        else:
            closed += 1
    return closed, left


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool = False, stack: list | None = None):
        self.path, self.start, self.end, self.inside, self.stack = path, start, end, inside, stack or []


def _backslashes(f, start: int) -> int:
    f.seek(max(0, start - _LOOK_BACK))
    tail = f.read(min(start, _LOOK_BACK))
    return len(tail) - len(tail.rstrip(b"\\"))


class _Scan(DataSourceReader):
    """Pass 1: ``path, start, odd, outside, inside`` with the effects as JSON."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # no ranges
            return
        fs, name = _open(part.path)
        with fs.open_input_file(name) as f:
            before = _backslashes(f, part.start)
            f.seek(part.start)
            data = f.read(part.end - part.start)
        at, in_string = _tokens(data, before)
        outside = _effect(data, at[:-1][~in_string[:-1]], part.start)
        inside = _effect(data, at[:-1][in_string[:-1]], part.start)
        yield part.path, part.start, bool(in_string[-1]), json.dumps(outside), json.dumps(inside)


class _Objects(DataSourceReader):
    """Pass 2: the text of each object of the array that begins in the range."""

    def __init__(self, ranges: list[Range], key: str):
        self.ranges, self.key = ranges, key

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # no ranges
            return
        with _reading(part.path) as f:
            size = _END if _compressed(part.path) else f.size()
            before = _backslashes(f, part.start)
            start, stack, inside, begun = part.start, [tuple(x) for x in part.stack], part.inside, None
            wanted: dict[int, bool] = {}
            held, held_at = b"", part.start  # bytes from the open object's start on
            while start < size and (start < part.end or begun is not None):
                f.seek(start)
                stop = min(part.end, start + STEP_BYTES) if start < part.end else min(size, start + (1 << 20))
                data = f.read(stop - start)
                if not data:
                    return
                at, in_string = _tokens(data, before)
                side = in_string != inside
                for p in at[:-1][~side[:-1]].tolist():
                    c = data[p]
                    if c in b"{[":
                        if c == 0x7B and begun is None and start + p < part.end and self._is_element(f, stack, wanted):
                            begun, depth = start + p, len(stack)
                        stack.append((chr(c), start + p))
                    elif stack:
                        stack.pop()
                        if begun is not None and len(stack) == depth:
                            text = held[begun - held_at:] + data[:p + 1] if begun < start else data[begun - start:p + 1]
                            yield (text.decode("utf-8", "replace"),)
                            begun = None
                            if start + p + 1 >= part.end:
                                return
                inside = bool(side[-1])
                before = (len(data) - len(data.rstrip(b"\\"))) if data.rstrip(b"\\") else before + len(data)
                if begun is not None:
                    held, held_at = (held + data, held_at) if begun < start else (data[begun - start:], begun)
                start += len(data)

    def _is_element(self, f, stack: list, wanted: dict[int, bool]) -> bool:
        """Whether an object here is an element: of the outer array, or of the outer object's array ``key``."""
        kinds = "".join(k for k, _ in stack)
        if kinds == "[":
            return True
        if kinds != "{[":
            return False
        offset = stack[1][1]
        if offset not in wanted:
            here = f.tell()
            f.seek(max(0, offset - _LOOK_BACK))
            m = _KEY.search(f.read(min(offset, _LOOK_BACK)))
            f.seek(here)
            wanted[offset] = bool(m) and json.loads(b'"' + m[1] + b'"') == self.key
        return wanted[offset]


class JsonArraySource(DataSource):
    """``spark.read.format("json_array")``: rows ``value``, one object of the array each. Options: ``path`` (of
    ``load``), ``key`` of the array in an outer object, ``rangeBytes``; ``starts`` is set by ``read_json_array``."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        if self.options.get("scan") == "true":
            return "path string, start bigint, odd boolean, outside string, inside string"
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        if "starts" in self.options:
            return _Objects([Range(*x) for x in json.loads(self.options["starts"])], self.options.get("key", ""))
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        whole = self.options.get("scan") != "true"  # without known starts a file is one range
        files = files_of(self.options["path"])
        if whole:
            ranges = [Range(path, 0, _END if _compressed(path) else size) for path, size in files]
        else:
            ranges = [Range(path, s, min(s + step, size)) for path, size in files if not _compressed(path) for s in range(0, size, step)]
        return _Objects(ranges, self.options.get("key", "")) if whole else _Scan(ranges)


def read_json_array(spark: SparkSession, path: str, key: str = "training_data", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects (as JSON text, column ``value``) of the array files under ``path``: each file is an array, or an object
    with the array under ``key``. Files of any size are read by many tasks."""
    spark.dataSource.register(JsonArraySource)
    reader = spark.read.format("json_array").option("key", key).option("rangeBytes", range_bytes)
    files = files_of(path)
    sizes = {p: n for p, n in files if not _compressed(p)}
    if max(sizes.values(), default=0) <= range_bytes:
        return reader.load(path)  # a range a file: every start is known
    starts = [(p, 0, _END, False, []) for p, _ in files if _compressed(p)]
    rows = sorted(reader.option("scan", "true").load(path).collect(), key=lambda r: (r["path"], r["start"]))  # a row for each range
    for r in rows:
        if r["start"] == 0:
            inside, stack = False, []
        starts.append((r["path"], r["start"], min(r["start"] + range_bytes, sizes[r["path"]]), inside, stack))
        closed, left = json.loads(r["inside"] if inside else r["outside"])
        stack = [*stack[:max(0, len(stack) - closed)], *map(tuple, left)]
        inside ^= r["odd"]
    return spark.read.format("json_array").option("key", key).option("starts", json.dumps(starts)).load(path)
