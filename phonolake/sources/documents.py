"""One large JSON document, read by many tasks.

A merged file holds one object or array on top, of any size and often without a line break.  It is read in ranges of bytes:
the text source cuts it behind every closing brace, so ranges begin at a brace wherever they fall.  What a piece of JSON does
to the state of a scan composes: it flips being in a string or not, and it moves the depth by one number if the piece
begins outside strings and by another if inside.  A first pass sums these facts for each range, one row a range; sums
over the ranges before give each range its state, and a second pass cuts it into the entries of the top level.  Entries over a
range's edge are put together from their parts.

Entries are whole or not at all: no task reads the document, and no entry is looked at twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from .predictions import lines_in_order

_CLOSE = b"}"
_MARKS = re.compile(rb'\\.|["{}\[\],]', re.DOTALL)
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_OPENERS, _CLOSERS = b"{[", b"}]"


def _unquoted(piece: bytes) -> tuple[bytes, bytes, bool]:
    """What lies outside strings if the piece begins outside one, if it begins inside one, and whether it ends in the other
    state.  No piece begins behind a backslash, as a brace is never escaped."""
    if b"\\" in piece:
        piece = _ESCAPED.sub(b"", piece)
    parts = piece.split(b'"')
    return b"".join(parts[0::2]), b"".join(parts[1::2]), len(parts) % 2 == 0


def _count(text: bytes, marks: bytes) -> int:
    return sum(text.count(bytes([m])) for m in marks)


class Effect:
    """What pieces, one after the other, do to a scan."""

    def __init__(self, flips: bool = False, outside: int = 0, inside: int = 0):
        self.flips, self.outside, self.inside = flips, outside, inside

    def add(self, piece: bytes) -> None:
        out, into, flips = _unquoted(piece)
        moves = [_count(t, _OPENERS) - _count(t, _CLOSERS) for t in (out, into)]
        if self.flips:
            moves.reverse()
        self.outside, self.inside, self.flips = self.outside + moves[0], self.inside + moves[1], self.flips != flips


class Cutter:
    """Cuts pieces into the entries of the top level, from a given state on."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth
        self.held: list[bytes] = []
        self.opened = False  # the entry that is held began in this range
        self.over = False

    def feed(self, piece: bytes) -> Iterator[tuple[bool, bytes]]:
        """(whether it began here, its end or all of it) of each entry that the piece ends."""
        if self.over:
            return
        out, into, flips = _unquoted(piece)
        seen = into if self.in_string else out
        if self.depth - _count(seen, _CLOSERS) >= 2:  # it stays below the top level
            self.held.append(piece)
            self.depth += _count(seen, _OPENERS) - _count(seen, _CLOSERS)
            self.in_string ^= flips
            return
        start = 0
        for m in _MARKS.finditer(piece):
            mark = m[0]
            if mark == b'"':
                self.in_string = not self.in_string
            elif self.in_string or mark[0] == 92:
                continue
            elif mark in _OPENERS:
                self.depth += 1
                if self.depth == 1:
                    self.held, self.opened, start = [], True, m.end()
            elif mark == b",":
                if self.depth == 1:
                    yield self.opened, b"".join([*self.held, piece[start : m.start()]])
                    self.held, self.opened, start = [], True, m.end()
            else:
                self.depth -= 1
                if self.depth == 0:
                    yield self.opened, b"".join([*self.held, piece[start : m.start()]])
                    self.held, self.over = [], True
                    return
        self.held.append(piece[start:])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for b in batches:
        values = b.column("value").cast(pa.binary())
        for file, split, value in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), values, strict=True):
            yield file, split, value.as_py() + _CLOSE  # behind the document's end one brace too many does no harm


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], Effect] = {}
    for file, split, piece in _pieces(batches):
        found.setdefault((file, split), Effect()).add(piece)
    rows = [{"file": f, "split": s, "flips": e.flips, "outside": e.outside, "inside": e.inside} for (f, s), e in found.items()]
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("flips", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64())])
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def states(effects: Iterable[tuple[str, int, bool, int, int]]) -> dict[tuple[str, int], tuple[bool, int]]:
    """(in a string, depth) at the beginning of each range of (file, start, flips, depth from outside, from inside)."""
    out, last = {}, None
    for file, split, flips, outside, inside in sorted(effects):
        if file != last:
            in_string, depth, last = False, 0, file
        out[file, split] = (in_string, depth)
        depth += inside if in_string else outside
        in_string ^= flips
    return out


_PART = pa.schema([("file", pa.string()), ("split", pa.int64()), ("seq", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("entry", pa.string())])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, entry): the entries of the object or array on top of each matching file, ``"key": value`` of an
    object and values of an array, with their place: where the range begins that they begin in, and their number in it.  The
    entries are written once to the shared folder.  One row a range of bytes reaches the driver."""
    lines = lines_in_order(spark.read.option("lineSep", _CLOSE.decode()).text(path)).select("file", F.col("line_no.split").alias("split"), "value")
    known = states(tuple(r) for r in lines.mapInArrow(_effects, "file string, split long, flips boolean, outside long, inside long").collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        here, cutter, seq, size = None, None, 0, 0

        def keep(opens: bool, closes: bool, text: bytes) -> None:
            nonlocal seq, size
            if not (opens and closes) or text.strip():
                rows.append({"file": here[0], "split": here[1], "seq": seq, "opens": opens, "closes": closes, "entry": text.decode("utf-8", "replace")})
                seq, size = seq + 1, size + len(text)

        def finish() -> None:
            # what is held at a range's end goes on in the next; before and behind the document nothing is
            if cutter is not None and not cutter.over and (cutter.opened or known[here][1] > 0):
                keep(cutter.opened, False, b"".join(cutter.held))

        for file, split, piece in _pieces(batches):
            if (file, split) != here:
                finish()
                here, cutter, seq = (file, split), Cutter(*known[file, split]), 0
                cutter.over = split > 0 and known[file, split][1] <= 0 and not known[file, split][0]
            for opened, text in cutter.feed(piece):
                keep(opened, True, text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, schema=_PART)
                rows, size = [], 0
        finish()
        yield pa.RecordBatch.from_pylist(rows, schema=_PART)

    folder = scratch_folder(spark, "entries")
    lines.mapInArrow(cut, "file string, split long, seq long, opens boolean, closes boolean, entry string").write.parquet(folder)
    parts = spark.read.parquet(folder)
    whole = parts.where("opens and closes").select("file", "split", "seq", "entry")
    # a few parts a range: each belongs to the last entry that was opened before it, or opens one
    order = Window.partitionBy("file").orderBy("split", "seq")
    numbered = parts.where("not (opens and closes)").withColumn("n", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("split", "seq", "entry"))).alias("p"))
    first = F.get("p", F.lit(0))
    mended = joined.select("file", first["split"].alias("split"), first["seq"].alias("seq"), F.array_join("p.entry", "").alias("entry"))
    return whole.unionByName(mended.where(~F.col("entry").rlike(r"^\s*$")))
