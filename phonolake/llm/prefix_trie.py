"""The prefix trie of conversations, by an external mergesort whose runs carry common prefixes.

A conversation is the sequence of its turns' 128-bit digests; a node of the trie is a distinct sequence of first turns.
Each task sorts the conversations that it has into runs.  A run's entry holds how many leading turns it shares with the one before
it (LCP) and only the turns beyond; equal conversations of a run are one entry with a count.  Sampled sequences cut the order
into ranges, and a range's pieces of all runs meet in one task.  There a loser tree merges them by LCPs: of two heads the one that
shares more turns with the last output comes first, so turns are compared only where both share as many, and none is
compared again.  The merged stream feeds a stack of the open path: what lies deeper than the next entry's LCP is
finished and emitted.

A node that may reach over a range's edge is a proper prefix of the sequence that cuts there.  Ranges emit such nodes as partial
sums; these are added up by key and their subtrees' sums are passed up the path, in a table no larger than the cutting
sequences.  Nodes below them learn their parent's smallest member by a join with it.  The list of members that end at a node,
of which a digest is given, is written in pieces by ranges of (node, id) and digested piece by piece, so copies of one
conversation are never held together.

Defined results: turns are ordered by turn number, null first, turns of one number by their digests; a null role or text is
empty; repeated rows are turns each; ids are whole numbers (others do not cast and are an error), as members are ordered by number
and named in decimal; rows without an id belong to no conversation and are left out; a conversation is a row of 20 bytes a turn
that one task holds, its texts are not; an empty table has no node, not even a root; columns other than the four named ones are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Boxed, stored, text_of, tidy

#: Bytes of a turn's digest.
WIDTH = 16
#: Conversations of a range at scale and in small inputs; sampled sequences for each range; turns of a sample that count.
RANGE_ROWS, LEAST_ROWS, SAMPLES, SAMPLE_TURNS = 200_000, 1024, 8, 128
#: Bytes of conversations that are sorted into one run, and entries of a piece of it.
RUN_BYTES, PIECE_ROWS = 1 << 25, 1024
#: Bytes of a piece of a list of members.
LIST_BYTES = 1 << 16
#: Of contract: conversations of a family, and the modulus of how many turns a branch takes over.
FAMILY, HEAD_MODULUS = 5, 9


def _digests(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(_conv, _turn): an orderable turn of its number, digest and bytes of text."""
    box = Boxed(turns)
    role, text, turn = text_of(box.col(role_col)), text_of(box.col(text_col)), box.col(turn_col).cast("long")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    item = F.struct(turn.isNotNull().alias("has"), F.coalesce(turn, F.lit(0)).alias("turn"), digest.alias("key"), F.octet_length(text).alias("size"))
    return box.df.select(box.col(conv_col).cast("long").alias("_conv"), item.alias("_turn")).where("_conv is not null")


def _sequence(conv: Column, turns: Column) -> list[Column]:
    return [conv.alias("conv_id"), F.unhex(F.array_join(F.transform(turns, lambda x: x["key"]), "")).alias("seq"), F.transform(turns, lambda x: x["size"]).alias("sizes")]


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, sizes): the digests of a conversation's turns in order, joined, and the bytes of their texts."""
    rows = _digests(turns, conv_col, turn_col, role_col, text_col)
    grouped = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return grouped.select(*_sequence(F.col("_conv"), F.col("_turns")))


def branched_sequences(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    family: int = FAMILY, modulus: int = HEAD_MODULUS,
) -> DataFrame:
    """``sequences`` in which conversation c begins with the first h turns of c - c % family and goes on with its own turns
    after its first h; h is the checksum of c modulo ``modulus``."""
    rows = _digests(turns, conv_col, turn_col, role_col, text_col)
    rows = rows.withColumn("_first", F.col("_conv") - F.col("_conv") % family).repartition("_first")
    grouped = rows.groupBy("_first", "_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    head = F.max(F.when(F.col("_conv") == F.col("_first"), F.slice("_turns", 1, modulus - 1))).over(Window.partitionBy("_first"))
    h = (F.crc32(F.col("_conv").cast("string").cast("binary")) % modulus).cast("int")
    mixed = grouped.withColumn("_head", head).withColumn("_h", h)
    taken = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("_turns", 1, 0))
    rebuilt = F.concat(taken, F.slice("_turns", F.col("_h") + 1, F.greatest(F.size("_turns"), F.lit(1))))
    return mixed.select("_conv", rebuilt.alias("_all")).select(*_sequence(F.col("_conv"), F.col("_all")))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many leading turns two sequences share, of which ``known`` need no look."""
    at, most = known, min(len(a), len(b)) // WIDTH
    while at < most and a[WIDTH * at : WIDTH * at + WIDTH] == b[WIDTH * at : WIDTH * at + WIDTH]:
        at += 1
    return at


# --- runs

_PIECE = pa.schema([
    ("_range", pa.int64()), ("_run", pa.string()), ("_part", pa.int64()), ("lcp", pa.list_(pa.int32())), ("tail", pa.list_(pa.binary())),
    ("sizes", pa.list_(pa.list_(pa.int32()))), ("n", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())),
])
_PIECE_TYPE = "_range long, _run string, _part long, lcp array<int>, tail array<binary>, sizes array<array<int>>, n array<long>, low array<long>"


def sorted_run(rows: list[tuple[bytes, int, list[int]]], cuts: list[bytes], run: str, piece_rows: int) -> Iterator[dict]:
    """The pieces of a run of (sequence, conversation, sizes).  The first entry of a piece holds all its turns."""
    rows.sort(key=lambda r: r[:2])
    piece: dict = {}
    before, part = None, 0
    for seq, conv, sizes in rows:
        if seq == before:
            piece["n"][-1] += 1
            continue
        where = bisect_right(cuts, seq)
        if piece and (where != piece["_range"] or len(piece["n"]) == piece_rows):
            yield piece
            part += 1
            before = before if where == piece["_range"] else None
            piece = {}
        lcp = 0 if before is None else shared_turns(before, seq)
        if not piece:
            piece = {"_range": where, "_run": run, "_part": part, "lcp": [], "tail": [], "sizes": [], "n": [], "low": []}
        known = lcp if piece["n"] else 0
        for name, value in (("lcp", lcp), ("tail", seq[WIDTH * known :]), ("sizes", sizes[known:]), ("n", 1), ("low", conv)):
            piece[name].append(value)
        before = seq
    if piece:
        yield piece


def _runs(convs: DataFrame, cuts: list[bytes], run_bytes: int, piece_rows: int) -> DataFrame:
    shared = convs.sparkSession.sparkContext.broadcast(cuts)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def flush(rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal n
            for piece in sorted_run(rows, shared.value, f"{task}-{n}", piece_rows):
                yield pa.RecordBatch.from_pylist([piece], schema=_PIECE)
            n += 1

        held, size = [], 0
        for b in batches:
            for conv, seq, sizes in zip(b.column("conv_id").to_pylist(), b.column("seq").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                held.append((seq, conv, sizes))
                size += 2 * len(seq) + 200
                if size >= run_bytes:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return convs.mapInArrow(tidy(sort), _PIECE_TYPE)


# --- merge


class Run:
    """The head of a run: its sequence, the turns it shares with the last output, and what the entry holds.  The sequence is
    None when the run is over."""

    def __init__(self, pieces: list[dict]):
        self.pieces, self.part, self.at, self.seq, self.lcp = pieces, 0, -1, b"", 0
        self.piece: dict = pieces[0]
        self.next()

    def next(self) -> None:
        """The next entry.  The one before was the last output, so their LCP is the run's own."""
        self.at += 1
        if self.at == len(self.piece["n"]):
            self.part, self.at = self.part + 1, 0
            if self.part == len(self.pieces):
                self.seq, self.lcp = None, -1
                return
            self.piece = self.pieces[self.part]
        p, at = self.piece, self.at
        self.lcp = p["lcp"][at]
        known = self.lcp if at else 0
        self.seq = (self.seq[: WIDTH * known] if known else b"") + p["tail"][at]
        self.sizes_from, self.sizes, self.n, self.low = known, p["sizes"][at], p["n"][at], p["low"][at]


class LoserTree:
    """Merges runs by the turns that their heads share with the last output."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.losers = [-1] * max(1, len(runs))
        winner_of: dict[int, int] = {}
        n = len(runs)
        for node in range(2 * n - 1, 0, -1):
            if node >= n:
                winner_of[node] = node - n
            else:
                winner_of[node], self.losers[node] = self._play(winner_of.pop(2 * node), winner_of.pop(2 * node + 1))
        self.winner = winner_of.get(1, 0)

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP is then that with the winner."""
        a, b = self.runs[i], self.runs[j]
        if a.lcp != b.lcp:  # also where one is over
            return (i, j) if a.lcp > b.lcp else (j, i)
        if a.seq is None:
            return i, j
        at = shared_turns(a.seq, b.seq, a.lcp)
        if a.seq[WIDTH * at : WIDTH * at + WIDTH] <= b.seq[WIDTH * at : WIDTH * at + WIDTH]:
            b.lcp = at
            return i, j
        a.lcp = at
        return j, i

    def __iter__(self) -> Iterator[tuple[bytes, int, int, list[int], int, int]]:
        """(sequence, turns shared with the one before, turns without sizes, sizes of the rest, count, smallest member)."""
        while (run := self.runs[self.winner]).seq is not None:
            yield run.seq, run.lcp, run.sizes_from, run.sizes, run.n, run.low
            run.next()
            best, node = self.winner, (self.winner + len(self.runs)) >> 1
            while node:
                best, self.losers[node] = self._play(best, self.losers[node])
                node >>= 1
            self.winner = best


# --- the open path

_NODE = pa.schema([
    ("_split", pa.bool_()), ("_key", pa.binary()), ("_parent", pa.binary()), ("_path", pa.list_(pa.binary())), *((c, pa.int64()) for c in (
        "depth", "size", "n_convs", "conv_id", "parent_conv_id", "n_children", "n_leaves", "saved_tokens", "n_ends", "end_id")),
])
_NODE_TYPE = "_split boolean, _key binary, _parent binary, _path array<binary>, " + ", ".join(f"{f.name} long" for f in list(_NODE)[4:])


class _Open:
    __slots__ = ("children", "end_id", "ends", "leaves", "low", "n", "pending", "saved", "size", "split")

    def __init__(self, size: int, split: bool):
        self.size, self.split = size, split
        self.n = self.ends = self.children = self.leaves = self.saved = 0
        self.low = self.end_id = None
        self.pending: list[dict] = []


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _key(seq: bytes, depth: int) -> bytes:
    return hashlib.md5(seq[: WIDTH * depth], usedforsecurity=False).digest()


def finished(merged: Iterator[tuple[bytes, int, int, list[int], int, int]], edges: list[bytes]) -> Iterator[dict]:
    """The nodes of a merged stream: whole ones, and sums of those that are proper prefixes of an edge of the range."""
    path: list[_Open] = []
    last = b""

    def close(depth: int) -> Iterator[dict]:
        """Closes what lies deeper than ``depth``."""
        while len(path) > depth + 1:
            node, d = path.pop(), len(path)
            above = path[-1] if path else None
            if above is not None:
                above.n, above.low = above.n + node.n, _least(above.low, node.low)
            row = {"_split": node.split, "depth": d, "size": node.size, "n_convs": node.n, "conv_id": node.low, "n_children": node.children, "n_ends": node.ends, "end_id": node.end_id}
            if node.split:
                keys = [_key(last, k) for k in range(d + 1)]
                row |= {"_key": keys[-1], "_parent": keys[-2] if d else None, "_path": keys, "n_leaves": node.leaves, "saved_tokens": node.saved + node.n * node.size}
                yield row
                continue
            row |= {"n_leaves": node.leaves or 1, "saved_tokens": node.saved + (node.n - 1) * node.size, "_key": _key(last, d) if node.ends > 1 else None}
            for child in node.pending:
                yield child | {"parent_conv_id": node.low}
            if above is None:
                yield row
                continue
            above.children += 1
            above.leaves += row["n_leaves"]
            above.saved += row["saved_tokens"]
            if above.split:
                yield row | {"_parent": _key(last, d - 1)}
            else:
                above.pending.append(row)

    for seq, lcp, sizes_from, sizes, n, low in merged:
        yield from close(lcp)
        split = max((min(shared_turns(seq, e), len(e) // WIDTH - 1) for e in edges), default=-1)
        for depth in range(len(path), len(seq) // WIDTH + 1):
            path.append(_Open(sizes[depth - 1 - sizes_from] if depth else 0, depth <= split))
        end = path[-1]
        end.n, end.low, end.ends, end.end_id = end.n + n, _least(end.low, low), end.ends + n, _least(end.end_id, low)
        last = seq
    yield from close(-1)


def _nodes(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    shared = runs.sparkSession.sparkContext.broadcast(cuts)
    dealt = runs.repartition("_range").sortWithinPartitions("_range", "_run", "_part")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value

        def nodes(where: int, runs: dict[str, list[dict]]) -> Iterator[pa.RecordBatch]:
            edges = cuts[max(0, where - 1) : where + 1]
            out = []
            for row in finished(iter(LoserTree([Run(p) for p in runs.values()])), edges):
                out.append(row)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=_NODE)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_NODE)

        where, held = None, {}
        for b in batches:
            for k in range(b.num_rows):
                piece = b.slice(k, 1).to_pylist()[0]
                if held and piece["_range"] != where:
                    yield from nodes(where, held)
                    held = {}
                where = piece["_range"]
                held.setdefault(piece["_run"], []).append(piece)
        if held:
            yield from nodes(where, held)

    return dealt.mapInArrow(tidy(merge), _NODE_TYPE)


def _cuts(convs: DataFrame, range_rows: int, least_rows: int) -> list[bytes]:
    """Sequences that cut the order into ranges, from a sample by hash; they decide where rows go, never a result."""
    n = convs.count()
    parts = max(-(-n // range_rows), min(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // least_rows))
    if parts <= 1:
        return []
    few = convs.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (SAMPLES * parts << 30) // n)))
    found = sorted(bytes(r[0]) for r in few.select(F.substring("seq", 1, WIDTH * SAMPLE_TURNS)).collect())
    return sorted({found[k * len(found) // parts] for k in range(1, parts)} - {b""}) if found else []


# --- nodes over edges, and ends


def _tops(partial: DataFrame) -> DataFrame:
    """Whole nodes from the sums of ranges, with their keys."""
    sums = partial.groupBy("_key").agg(
        *(F.max(c).alias(c) for c in ("_parent", "_path", "depth", "size")), *(F.min(c).alias(c) for c in ("conv_id", "end_id")),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")),
    )
    sums = stored(sums, "trie-tops")
    kids = sums.where("_parent is not null").groupBy(F.col("_parent").alias("_key")).agg(F.count("*").alias("_kids"))
    known = sums.join(kids, "_key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_kids")
    # a node's own share of its subtree's sums, passed to all nodes on its path
    leaf = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    shares = known.select(F.explode("_path").alias("_key"), leaf.alias("n_leaves"), (F.col("saved_tokens") - F.col("size")).alias("saved_tokens"))
    totals = shares.groupBy("_key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return known.drop("n_leaves", "saved_tokens", "_path").join(totals, "_key")


def _end_lists(convs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_key, _list): the digest of the ascending ids of the conversations that end at each of the wanted nodes."""
    ends = convs.select(F.unhex(F.md5("seq")).alias("_key"), "conv_id").join(wanted, "_key")
    ordered = stored(ends, "trie-ends").repartitionByRange("_key", "conv_id").sortWithinPartitions("_key", "conv_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, ids, size = ["_key", "_from", "_ids"], None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=names)

        for b in batches:
            for k, i in zip(b.column("_key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or size >= LIST_BYTES):
                    yield piece()
                    ids, size = [], 0
                key, size = k, size + 12
                ids.append(i)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, found: hashlib._Hash) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([found.hexdigest()], pa.string())], names=["_key", "_list"])

        key, found = None, None
        for b in batches:
            for k, ids in zip(b.column("_key").to_pylist(), b.column("_ids").to_pylist(), strict=True):
                if k == key:
                    found.update(f",{ids}".encode())
                    continue
                if found:
                    yield row(key, found)
                key, found = k, hashlib.sha256(ids.encode())
        if found:
            yield row(key, found)

    pieces = ordered.mapInArrow(tidy(write), "_key binary, _from long, _ids string")
    return pieces.repartition("_key").sortWithinPartitions("_key", "_from").mapInArrow(tidy(digest), "_key binary, _list string")


def prefix_nodes(
    convs: DataFrame, range_rows: int = RANGE_ROWS, least_rows: int = LEAST_ROWS, run_bytes: int = RUN_BYTES, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """The nodes of ``convs`` (conv_id, seq, sizes): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and n_ends, the members that end at the node."""
    convs = stored(convs, "sequences")
    cuts = _cuts(convs, range_rows, least_rows)
    nodes = stored(_nodes(_runs(convs, cuts, run_bytes, piece_rows), cuts), "trie-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "end_id", "_key"]
    whole = nodes.where("not _split")
    if cuts:
        tops = stored(_tops(nodes.where("_split")), "trie-whole-tops")
        above = tops.select(F.col("_key").alias("_above"), F.col("conv_id").alias("_above_id"))
        below = [x.withColumn("_of", F.col("_parent")).join(above, F.col("_of") == F.col("_above"), "left").withColumn("parent_conv_id", F.col("_above_id")) for x in (whole.where("_parent is not null"), tops)]
        rows = whole.where("_parent is null").select(*columns).unionAll(below[0].select(*columns)).unionAll(below[1].select(*columns))
    else:
        rows = whole.select(*columns)
    lists = _end_lists(convs, rows.where("n_ends > 1").select("_key"))
    one = F.sha2(F.when(F.col("n_ends") == 1, F.col("end_id").cast("string")).otherwise(""), 256)
    alone = rows.where("n_ends <= 1").withColumn("ends_sha256", one)
    many = rows.where("n_ends > 1").join(lists, "_key").withColumn("ends_sha256", F.col("_list"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends"]
    return alone.select(*out).unionAll(many.select(*out))
