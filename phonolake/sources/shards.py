"""Prediction shards as a data source, ``phonolake_shards``, for batches and streams.

    spark.dataSource.register(ShardSource)
    spark.read.format("phonolake_shards").load(folder)

Rows are (file, offset, sample_key, record): an entry of a line of JSON, the byte at which its line begins, its key (null for a flat record)
and the text of its record.  Files are those under a name that ends in ``jsonl``, in the folder or in folders of it, without
those with ``.cache`` or ``.error`` in their path below it.  A file is cut into ranges of bytes, and small files share a task.

Options: ``strict`` (``true``: a malformed line is an error that names its file and offset; else it is skipped), ``split_bytes``
(128 MB), ``pushdown`` (``true``: filters on ``sample_key`` drop lines before they are parsed; the session must have
``spark.sql.python.filterPushdown.enabled``).

A stream's offset is the number of bytes of each file up to its last line break: shards grow or appear, and are one for each worker of
a run, so an offset is as long as the run has workers.  A file that has become shorter than what was read is an error.  Paths are
those that Arrow's file systems open.

Empty lines, empty files and empty folders give no rows; a null record gives a row with the record ``null``; of equal keys of a line the
last one counts; a line of any length is held whole by one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..operators.merge import last_wins
from .predictions import RECORD, SKIPPED

NAME = "phonolake_shards"
SCHEMA = "file string, offset long, sample_key string, record string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("sample_key", pa.string()), ("record", pa.string())])
_BLOCK = 1 << 20
_BATCH_BYTES = 4 << 20
_SPACE = " \t\r\n"
_KEY = re.compile(r'[ \t\r\n]*\{[ \t\r\n]*"')
_COLON = re.compile(r"[ \t\r\n]*:[ \t\r\n]*")
_DECODER = json.JSONDecoder()


@dataclass
class Ranges(InputPartition):
    """(file, start, end) of the lines that begin there."""

    parts: list[tuple[str, int, int]]


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def list_shards(folder: str) -> dict[str, int]:
    """Sizes of the shards by path below the folder."""
    store, root = open_store(folder)
    root = root.rstrip("/")
    found = {}
    for info in store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
        below = info.path[len(root) + 1 :]
        names = below.split("/")
        shard = any(n.endswith("jsonl") for n in names) and not any(n.startswith(("_", ".")) for n in names)
        if info.type == pafs.FileType.File and shard and not any(s in below for s in SKIPPED):
            found[below] = info.size
    return found


def cut(ends: dict[str, tuple[int, int]], split: int) -> list[Ranges]:
    """Tasks of some ``split`` bytes that read each file from one place to another."""
    tasks, now, size = [], [], 0
    for file, (start, end) in sorted(ends.items()):
        while start < end:
            to = min(end, start + split - size)
            now.append((file, start, to))
            size += to - start
            start = to
            if size >= split:
                tasks.append(Ranges(now))
                now, size = [], 0
    return [*tasks, Ranges(now)] if now else tasks


def lines_of(stream: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range; a line is found to its end beyond the range."""
    at = max(0, start - 1)
    stream.seek(at)
    parts: list[bytes] = []
    skipping = start > 0  # the byte before a line is a line break
    while True:
        block = stream.read(_BLOCK)
        pieces = block.split(b"\n")
        for piece in pieces[:-1]:
            line = b"".join([*parts, piece])
            if not skipping:
                yield at, line
            at += len(line) + 1
            parts, skipping = [], False
            if at >= end:
                return
        parts.append(pieces[-1])
        if not block:
            line = b"".join(parts)
            if line and not skipping:
                yield at, line
            return


def last_line_break(stream: pa.NativeFile, size: int) -> int:
    """The number of bytes up to the last line break, looked for from the end."""
    while size:
        start = max(0, size - _BLOCK)
        stream.seek(start)
        found = stream.read(size - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        size = start
    return 0


def _only_entry(line: str) -> tuple[str, str] | None:
    """(key, text of the record) of a line ``{"key": record}``, parsed once; None for lines of another form."""
    if not (begin := _KEY.match(line)):
        return None
    key, end = scanstring(line, begin.end())
    if key in ("pred", "passthrough") or not (colon := _COLON.match(line, end)):
        return None
    _, end = _DECODER.raw_decode(line, colon.end())
    return (key, line[colon.end() : end]) if line[end:].strip(_SPACE) == "}" else None


def entries(line: str) -> list[tuple[str | None, str]]:
    """(key, text of the record) of a line, flat or keyed.  Raises ValueError unless it is an object."""
    if only := _only_entry(line):
        return [only]
    value = json.loads(line)
    if not isinstance(value, dict):
        raise ValueError("no object")
    if value.get("pred") is not None or value.get("passthrough") is not None:
        return [(None, line.strip(_SPACE))]
    return [(k, json.dumps(v, ensure_ascii=False)) for k, v in value.items()]


class _Lines:
    """What batch and stream readers share: reading a task's ranges."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.strict = options.get("strict", "false").lower() == "true"
        self.split = int(options.get("split_bytes", 128 << 20))
        self.wanted: set[str] | None = None

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.folder)
        marks = None if self.wanted is None else [json.dumps(k, ensure_ascii=False).encode("utf-8", "surrogatepass") for k in self.wanted]
        rows: list[tuple] = []
        held = 0
        for file, start, end in partition.parts:
            with store.open_input_file(f"{root.rstrip('/')}/{file}") as stream:
                for offset, raw in lines_of(stream, start, end):
                    # a key may be spelled in other ways with a backslash, and in one way without
                    if not raw.strip() or marks is not None and b"\\" not in raw and not any(m in raw for m in marks) and not self.strict:
                        continue
                    try:
                        found = entries(raw.decode("utf-8"))
                    except (ValueError, RecursionError) as e:
                        if self.strict:
                            raise ValueError(f"malformed JSON in {file} at byte {offset}: {raw[:80]!r}") from e
                        continue
                    rows += [(file, offset, k, r) for k, r in found if self.wanted is None or k in self.wanted]
                    held += len(raw)
                    if held >= _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class ShardReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return cut({f: (0, n) for f, n in list_shards(self.folder).items()}, self.split) or [Ranges([])]


class PushingShardReader(ShardReader):
    """A reader that takes filters on the key."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sample_key",):
                keys = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = keys if self.wanted is None else self.wanted & keys
            else:
                yield f


class ShardStreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_store(self.folder)
        ends = {}
        for file, size in sorted(list_shards(self.folder).items()):
            with store.open_input_file(f"{root.rstrip('/')}/{file}") as stream:
                ends[file] = last_line_break(stream, size)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        shorter = sorted(f for f, n in start.items() if end.get(f, 0) < n)
        if shorter:
            raise ValueError(f"shards have become shorter since they were read: {shorter[:5]}")
        return cut({f: (start.get(f, 0), n) for f, n in end.items()}, self.split) or [Ranges([])]

    def commit(self, end: dict) -> None:
        pass


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingShardReader if self.options.get("pushdown", "false").lower() == "true" else ShardReader)(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ShardStreamReader(self.options)


def parsed(rows: DataFrame) -> DataFrame:
    """(file, offset, sample_key, rec) with the record as a struct."""
    return rows.select("file", "offset", "sample_key", F.from_json("record", RECORD).alias("rec"))


def read_shards(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(sample_key, pred, passthrough), the last writer of a key winning in order of file and offset; flat records are left out."""
    spark.dataSource.register(ShardSource)
    rows = parsed(spark.read.format(NAME).options(**options).load(folder)).where("sample_key is not null")
    return last_wins(rows, ["sample_key"], ["file", "offset"]).select("sample_key", "rec.pred", "rec.passthrough")


def stream_shards(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(file, offset, sample_key, rec) of shards as they grow."""
    spark.dataSource.register(ShardSource)
    return parsed(spark.readStream.format(NAME).options(**options).load(folder))
