"""Suffix-array dedup: bytes inside a long string that also starts elsewhere are removed.

An index of every suffix would be many times the text.  The index here holds the suffixes at *anchors*: of every window of
``WINDOW`` bytes, the position whose hash of ``GRAM`` bytes is least.  The choice depends on the window's bytes alone,
so equal windows have their anchors at the same place and no repeat is missed.  All windows with one anchor are a
*segment*.

The index is a logarithmic family of such sparse suffix arrays.  Documents are dealt into batches.  Each batch gets an array
of its sampled suffixes, dealt into buckets and, in each bucket, in the order of their bytes: by their first eight bytes,
then by a hash of their ``GRAM`` bytes, then by a hash of the whole segment (so equal suffixes are neighbours).  When a
batch arrives, its array is merge-scanned against every level of the family: entries that are equal to the segment's length
are repeats, whichever side they are on.  Then the array becomes a level, and levels of equal rank merge, two by
two, into one of the next rank, so there are at most log2(batches) + 1 levels.  Arrays and levels share their buckets, so scans
and merges are joins of sorted runs without an exchange.

Suffixes that are equal for ``GRAM`` bytes but not for the whole segment may match over some windows of it.  They are settled
exactly by hashes of windows, not by further comparison in the arrays.  Windows are grouped in nodes of ``NODE`` neighbours:
a node whose whole span is found twice is repeated; a node whose common core is found once only is not; what is left is
decided window by window.  Counts are plain sums of hashed keys with partial aggregation, so a string that a third of all
documents hold is a few rows, and no group of occurrences meets in one task.  Segments are equal if eight bytes and two 64-bit
hashes are, nodes if a 64-bit hash of the whole and one of a part are, single windows if 128 bits are.

Texts are stored once in the shared folder, dealt into buckets by document, and the passes that need bytes join that table
without a shuffle of texts.  What nothing reads any more is deleted; the texts and the spans stay until the application ends.

Defined results: null text is empty; matches never cross documents; rows that repeat an id are documents of their own
(and copies of one another if their text is equal); a null id is kept; texts shorter than a window stay whole; very long
texts are read in overlapping pieces of ``PIECE`` bytes, with the same result; an empty table gives an empty one; columns
other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Boxed, bucketed, discard, source_bytes, stored, text_of, tidy

WINDOW = 400
GRAM = 64
NODE = 32
BATCHES = 5
#: Bytes read at once; longer documents are read in overlapping pieces.
PIECE = 1 << 18
#: Bytes of the source's texts in one bucket, beyond those of as many buckets as an exchange has partitions.
BUCKET_BYTES = 1 << 27
_TABLE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)
KEY = ["dk", "th"]
#: The order of an array, and where one of a suffix's occurrences is.
ORDER = ["head", "gram", "seg"]
PLACE = ["dk", "th", "a", "p", "b"]


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) that start at each position."""
    h, power, size = _TABLE[raw], _BASE, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * power + h[size:]
            power = power * power
            size *= 2
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def _window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` positions, that of the least hash, the leftmost of equals."""
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    return (m & _LOW).astype(np.int64)


def segments(text: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first bytes, gram hash, segment hash, first window, anchor, last window) of one text; the first three as signed
    64-bit values, the first of them in the order of the bytes."""
    yield from _segments_of_many([text], window, gram)[0]


def _segments_of_many(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> list[list[tuple]]:
    out: list[list[tuple]] = [[] for _ in texts]
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        joined = b"".join(g[2] for g in group)
        raw = np.frombuffer(joined, np.uint8)
        h = _gram_hashes(raw, gram)
        anchors = _window_anchors(h, window - gram + 1)
        signed = h.view(np.int64)
        at = 0
        for k, first, part in group:
            own = anchors[at : at + len(part) - window + 1]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            begin = np.concatenate([[0], cuts])
            end = np.concatenate([cuts, [len(own)]]) - 1
            where = own[begin]
            grams = signed[where].tolist()
            for g, a, p, b in zip(grams, begin.tolist(), (where - at).tolist(), end.tolist(), strict=True):
                seg = xxhash.xxh3_64_intdigest(part[a : b + window], p - a)
                head = int.from_bytes(part[p : p + 8], "big") - (1 << 63)
                out[k].append((head, g, seg - (1 << 64) if seg >> 63 else seg, first + a, first + p, first + b))
            at += len(part)
        group, size = [], 0

    for k, text in enumerate(texts):
        for first in range(0, max(0, len(text) - window + 1), PIECE):
            part = text[first : first + PIECE + window - 1]
            group.append((k, first, part))
            size += len(part)
            if size >= PIECE:
                flush()
    flush()
    return out


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def store_texts(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(dk, th, id, text, batch): the texts in buckets by document, written once."""
    spark = docs.sparkSession
    box = Boxed(docs)
    base = box.df.select(box.col(id_col).cast("long").alias("id"), text_of(box.col(text_col)).alias("text"))
    base = base.select(F.coalesce("id", F.lit(-(2**63))).alias("dk"), F.xxhash64("text").alias("th"), "id", "text", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(batches)).cast("int").alias("batch"))
    # as many buckets as an exchange has partitions; fewer for small tables, more where buckets would be large
    size, most = source_bytes(base), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 16), min(most, size // BUCKET_BYTES) if size < 1 << 60 else 0)
    return bucketed(base.repartition(n, *KEY), "texts", n, KEY)


def suffixes(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(batch, dk, th, head, gram, seg, a, p, b): the sampled suffixes of all texts, in one pass over them."""
    names = ["batch", "dk", "th", "head", "gram", "seg", "a", "p", "b"]
    kinds = [pa.int32(), *[pa.int64()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                found = _segments_of_many(_bytes(b.column(3)), window, gram)
                own = zip(*(b.column(c).to_pylist() for c in range(3)), found, strict=True)
                yield _arrow([(k, d, t, *s) for k, d, t, ss in own for s in ss], names, kinds)

    long_enough = texts.where(F.octet_length("text") >= window).select("batch", *KEY, "text")
    return long_enough.mapInArrow(tidy(run), "batch int, dk long, th long, head long, gram long, seg long, a long, p long, b long")


class SuffixFamily:
    """The levels of the index: sorted, bucketed arrays whose ranks grow by one when two equals merge."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []

    def _sorted(self, rows: DataFrame, name: str) -> DataFrame:
        return bucketed(rows, name, self.buckets, ORDER, tuple(ORDER))

    def array_of(self, occurrences: DataFrame) -> DataFrame:
        """The suffix array of a batch: each distinct sampled suffix in order, its number and one occurrence."""
        rows = occurrences.groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in PLACE])
        return self._sorted(rows, "array")

    def scan(self, array: DataFrame) -> DataFrame:
        """(head, gram, seg) of the array's suffixes that occur twice in it or in some level: one merge for each level."""
        keys = array.select(*ORDER)
        found = [keys.join(level.select(*ORDER).hint("merge"), ORDER, "left_semi") for _, level in self.levels]
        return reduce(DataFrame.unionByName, found, array.where("n > 1").select(*ORDER)).distinct()

    def add(self, array: DataFrame) -> None:
        """Makes the array a level, and merges levels of equal rank."""
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, older = self.levels.pop()
            merged = self._sorted(_merged(older, array), "level")
            discard(older, array)
            array, rank = merged, rank + 1
        self.levels.append((rank, array))

    def take(self, occurrences: DataFrame) -> DataFrame:
        """Adds a batch; returns what ``scan`` finds for it."""
        array = self.array_of(occurrences)
        found = stored(self.scan(array), "found", few=True)
        self.add(array)
        return found

    def partly(self) -> DataFrame:
        """(dk, th, a, p, b): one occurrence of each suffix that shares its first ``GRAM`` bytes with another segment."""
        rows = reduce(DataFrame.unionByName, [x for _, x in self.levels])
        spread = rows.groupBy("head", "gram").agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
        # stored, so that a hot gram's side of the join is a plain exchange, which Spark can split
        shared = stored(spread.where("low <> high").select("head", "gram"), "grams", few=True)
        return rows.join(shared, ["head", "gram"], "left_semi").select(*PLACE)


def _merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two arrays as one: a merge of sorted runs in the same buckets."""
    rest = ["n", *PLACE]
    a = older.select(*ORDER, *[F.col(c).alias(f"{c}_a") for c in rest])
    b = newer.select(*ORDER, *[F.col(c).alias(f"{c}_b") for c in rest])
    both = a.join(b.hint("merge"), ORDER, "full_outer")
    n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    return both.select(*ORDER, n.alias("n"), *[F.when(F.col("n_a").isNotNull(), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c) for c in PLACE])


def _nodes(texts: DataFrame, partly: DataFrame, window: int, node: int) -> DataFrame:
    """(core, span, dk, th, lo, hi): the nodes of partly repeated segments; span is null where a segment's windows do
    not fill the node."""
    lists = partly.groupBy(*KEY).agg(F.collect_list(F.struct("a", "p", "b")).alias("segs"))
    names, kinds = ["core", "span", "dk", "th", "lo", "hi"], [pa.int64()] * 6
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = text.as_py().encode("utf-8")
                for s in segs.as_py():
                    a, p, z = s["a"], s["p"], s["b"]
                    for j in range((p - z) // node, (p - a) // node + 1):
                        top = p - node * j  # the node's last window starts here
                        low = top - node + 1
                        core = signed(xxhash.xxh3_64_intdigest(raw[top : low + window], j))
                        whole = a <= low and top <= z
                        span = signed(xxhash.xxh3_64_intdigest(raw[low : top + window], j)) if whole else None
                        rows.append((core, span, d, t, max(a, low), min(z, top)))
                if len(rows) > 100_000:
                    yield _arrow(rows, names, kinds)
                    rows = []
            yield _arrow(rows, names, kinds)

    joined = texts.select(*KEY, "text").join(lists.hint("shuffle_merge"), KEY).select(*KEY, "text", "segs")
    return joined.mapInArrow(tidy(run), "core long, span long, dk long, th long, lo long, hi long")


def _windows(texts: DataFrame, nodes: DataFrame, window: int) -> DataFrame:
    """(w1, w2, dk, th, i): 128-bit hashes of the windows of the given nodes."""
    lists = nodes.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    names, kinds = ["w1", "w2", "dk", "th", "i"], [pa.int64()] * 5

    def flush(digests: list[bytes], owners: list[tuple]) -> pa.RecordBatch:
        two = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        own = np.array(owners, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), *(pa.array(own[:, k]) for k in range(3))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, owners = [], []
            for d, t, text, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = text.as_py().encode("utf-8")
                starts = {i for r in ranges.as_py() for i in range(r["lo"], r["hi"] + 1)}
                for i in starts:
                    digests.append(xxhash.xxh3_128_digest(raw[i : i + window]))
                    owners.append((d, t, i))
                if len(digests) > 100_000:
                    yield flush(digests, owners)
                    digests, owners = [], []
            yield flush(digests, owners)

    joined = texts.select(*KEY, "text").join(lists.hint("shuffle_merge"), KEY).select(*KEY, "text", "ranges")
    return joined.mapInArrow(tidy(run), "w1 long, w2 long, dk long, th long, i long")


def _repeated_spans(texts: DataFrame, batches: int, window: int, gram: int, node: int) -> DataFrame:
    """(dk, th, spans): the maximal runs of repeated bytes of each document that has any, in order."""
    every = stored(suffixes(texts, window, gram), "suffixes", by="batch")
    family = SuffixFamily(texts.sparkSession)
    found = [family.take(every.where(F.col("batch") == k)) for k in range(batches)]
    whole = stored(reduce(DataFrame.unionByName, found).distinct(), "whole")
    of_segments = every.join(whole, ORDER, "left_semi").select(*KEY, F.col("a").alias("s"), (F.col("b") + window).alias("e"))

    nodes = stored(_nodes(texts, family.partly(), window, node), "nodes")
    twice = nodes.where("span is not null").groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo", "hi")).alias("one")).where("n > 1")
    twice = stored(twice, "twice", few=True)
    of_nodes = nodes.join(twice.select("core", "span"), ["core", "span"], "left_semi").select(*KEY, F.col("lo").alias("s"), (F.col("hi") + window).alias("e"))

    open_ = nodes.join(twice.select("core", "span"), ["core", "span"], "left_anti")
    cores = stored(nodes.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores", few=True)
    open_ = stored(open_.join(cores, "core", "left_semi"), "open", few=True)
    # a window may be repeated in a node that is settled: one such node of each kind stands in for all
    stand_in = twice.join(open_.select("core").distinct(), "core", "left_semi").select("one.*")
    windows = stored(_windows(texts, open_.select(*KEY, "lo", "hi").unionByName(stand_in), window), "windows")
    again = stored(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "again", few=True)
    of_windows = windows.join(again, ["w1", "w2"], "left_semi").select(*KEY, F.col("i").alias("s"), (F.col("i") + window).alias("e"))

    runs = stored(_runs(of_segments.unionByName(of_nodes).unionByName(of_windows)), "runs")
    discard(every, whole, *found, *(x for _, x in family.levels), nodes, twice, cores, open_, windows, again)
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _runs(spans: DataFrame) -> DataFrame:
    """Maximal runs of overlapping or touching spans of each document, merged by a sorted pass that can spill."""
    longest = spans.groupBy(*KEY, "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy(*KEY).orderBy("s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("begins", F.when(reach >= F.col("s"), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*KEY, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of ``raw`` without the runs, which are in order and do not touch."""
    left, at = [], 0
    for s, e in runs:
        left.append(raw[at:s])
        at = e
    left.append(raw[at:])
    return b"".join(left)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, node: int = NODE, batches: int = BATCHES, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text[, kept, spans]) for every row of ``docs``.

    ``text`` is what remains; of a character that was cut, the bytes that remain are left out of it, while ``kept`` has them.
    """
    if gram & (gram - 1) or window < gram + node:
        raise ValueError("gram must be a power of two and gram + node at most the window")
    texts = store_texts(docs, id_col, text_col, batches)
    lists = _repeated_spans(texts, batches, window, gram, node)
    joined = texts.select(*KEY, "id", "text").join(lists.hint("shuffle_merge"), KEY, "left").select("id", "text", "spans")
    extra = ", kept binary, spans array<struct<s: long, e: long>>" if with_kept else ""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    if with_kept:
        kinds += [pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        names += ["kept", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, text, found in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2), strict=True):
                raw, runs = text.as_py(), [(x["s"], x["e"]) for x in found.as_py() or ()]
                kept = cut(raw, runs)
                row = (d, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
                rows.append(row + (kept, [{"s": s, "e": e} for s, e in runs]) if with_kept else row)
            yield _arrow(rows, names, kinds)

    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" + extra)
