"""Target-distribution importance resampling: a draw of documents that looks like a target corpus.

Features are all runs of one and two consecutive words, hashed to ``BUCKETS`` counts.  Counts over the whole corpus and over
the whole target give each bucket a gain, the floored log ratio of the smoothed shares; an array of gains scores whole batches
of documents at once.  A document's weight is the floored mean of its features' gains; its score adds Gumbel noise made from
its id, so the highest scores are a weighted draw without replacement.

The draw is exact.  Each partition sorts its eligible documents into a run.  The histogram of scores, whose size is bounded
by the range of scores and not by the corpus, says which score the draw ends at, and cuts what lies above into ranges of
whole scores with known first ranks; runs are cut at the ranges.  A task merges the pieces of all runs in a range with a k-way
tournament tree: pieces arrive in the order of their first entries, so a piece enters the tree no sooner than its first entry
can win, and a run has one leaf.  The merge stops after the draw's exact count and emits ranks.  Only documents at or above the last
score are shuffled.

Equal entries of a run (rows of one id, score and weight) are one entry with a count, so a row repeated very often meets in one
task as a few entries; it is spread again when ranks are given to its rows.

Defined results: null text has no words; texts are read whole, long ones in blocks cut between words; rows of one id
with different texts are scored each on its own, ties in score go to the smaller id (null first), then to fewer
features, then to the smaller weight; repeated rows are drawn one by one; a null id draws its noise as the empty string; an
empty table gives an empty one, an empty target gives gains against no counts; columns other than id and text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Boxed, Growing, stored, text_of, tidy
from .words import BATCH_BYTES, MAX_WORD, Remembered

BUCKETS = 10_000
MIN_WORDS, PERCENT = 20, 25
#: Documents of a range, so far as whole scores allow, and entries of a piece of a run.
RANGE_ROWS, PIECE_ROWS = 4096, 1024
#: Rows with ranks that one entry of equal rows becomes in one task.
REPEAT_ROWS = 65_536
#: Words that a worker remembers before it starts afresh.
MAX_CACHED_WORDS = 900_000
#: Letters and digits of words: A-Z become a-z, bytes that belong to no word become zero.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)


def _shifts() -> np.ndarray:
    """``[n, place, byte]``: what a byte of a checksum becomes when n more bytes follow, so that the checksum of a joined
    string is that of its first part, shifted, xor that of its second."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ (np.uint32(0xEDB88320) * (one & 1))
    at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [at]
    for _ in range(MAX_WORD + 1):
        out.append((out[-1] >> 8) ^ one[out[-1] & 255])
    return np.stack(out)


def blocks(raw: bytes, size: int = BATCH_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """(the last word before, text) of a text's blocks, cut between words."""
    at, before = 0, b""
    while len(raw) - at > size:
        end = at + size
        inside = _FOLD[np.frombuffer(raw, np.uint8, size, at)] > 0
        while inside.all() and end < len(raw):  # one word so far
            more = _FOLD[np.frombuffer(raw, np.uint8, min(size, len(raw) - end), end)] > 0
            inside, end = np.append(inside, more), end + len(more)
        gaps = np.flatnonzero(~inside)
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        yield before, raw[at:end]
        kept = np.flatnonzero(inside[: end - at])
        if len(kept):
            last = int(kept[-1])
            lead = gaps[gaps < last]
            before = raw[at + (int(lead[-1]) + 1 if len(lead) else 0) : at + last + 1]
        at = end
    yield before, raw[at:]


class FeatureReader:
    """Buckets of the features of many texts at once; the checksums of words are remembered, those of pairs are composed."""

    def __init__(self, n_buckets: int = BUCKETS):
        self.n_buckets, self.shifts = n_buckets, _shifts()
        self.words = Remembered(_FOLD, MAX_CACHED_WORDS)
        self._reset()

    def _reset(self) -> None:
        self.words.reset()
        self.alone, self.behind = Growing("u4"), Growing("u4")

    def _learn(self, words: list[bytes]) -> None:
        low = [w.lower() for w in words]
        self.alone.extend(np.array([zlib.crc32(w) for w in low], np.uint32))
        self.behind.extend(np.array([zlib.crc32(b" " + w) for w in low], np.uint32))

    def read(self, parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (owner, last word before, text): the owners of the words, and owners and buckets of all features."""
        if self.words.full:
            self._reset()
        joined = b" ".join(before + b" " + text for _, before, text in parts)
        raw = np.frombuffer(joined, np.uint8)
        edges = np.diff((_FOLD[raw] > 0).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = end - start
        short = sizes <= MAX_WORD
        alone, behind = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
        known = self.words.numbers(joined, raw, start[short], end[short], self._learn)
        alone[short], behind[short] = self.alone.room[known], self.behind.room[known]
        for k in np.flatnonzero(~short).tolist():
            word = joined[start[k] : end[k]].lower()
            alone[k], behind[k] = zlib.crc32(word), zlib.crc32(b" " + word)
        bounds = np.cumsum([0, *(len(before) + len(text) + 2 for _, before, text in parts)])
        part = np.searchsorted(bounds, start, side="right") - 1
        seen = np.zeros(len(start), bool)  # words that the block before has counted
        first = np.flatnonzero(np.diff(part, prepend=-1))
        seen[first] = np.array([bool(before) for _, before, _ in parts], bool)[part[first]]
        left = np.flatnonzero(part[1:] == part[:-1])
        a, n = alone[left], np.minimum(sizes[left + 1], MAX_WORD) + 1
        pair = self.shifts[n, 0, a & 255] ^ self.shifts[n, 1, (a >> 8) & 255] ^ self.shifts[n, 2, (a >> 16) & 255] ^ self.shifts[n, 3, a >> 24] ^ behind[left + 1]
        for k in np.flatnonzero(~short[left + 1]).tolist():
            pair[k] = zlib.crc32(b" " + joined[start[left[k] + 1] : end[left[k] + 1]].lower(), int(a[k]))
        owner = np.array([o for o, _, _ in parts], np.int64)[part]
        own = owner[~seen]
        return own, np.concatenate([own, owner[left]]), np.concatenate([alone[~seen], pair]) % np.uint32(self.n_buckets)

    def batches(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0
        for k, text in enumerate(texts):
            for before, block in blocks(text):
                held.append((k, before, block))
                size += len(before) + len(block)
                if size >= BATCH_BYTES:
                    yield self.read(held)
                    held, size = [], 0
        yield self.read(held)


@cache
def _reader(n_buckets: int) -> FeatureReader:
    """One for each worker process, kept over tasks."""
    return FeatureReader(n_buckets)


def _raw(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() for x in column.cast(pa.binary()))


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column ``_text``, over all rows; as many sums as there are buckets reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for _, _, bucket in _reader(n_buckets).batches(_raw(b.column("_text"))):
                total += np.bincount(bucket, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in texts.select("_text").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored log ratio of each bucket's smoothed share of the target to its share of the corpus, in thousandths."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(texts: DataFrame, gain: np.ndarray, kind: str, seed: int) -> DataFrame:
    """(_id, n_features, n_words, weight, score) of ``texts`` (_id, _key, _text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for own, owner, bucket in _reader(len(gain)).batches(_raw(b.column("_text"))):
                words += np.bincount(own, minlength=n)
                features += np.bincount(owner, minlength=n)
                total += np.bincount(owner, weights=gain[bucket], minlength=n).astype(np.int64)  # whole numbers below 2^53: exact
            weight = total // np.maximum(features, 1)
            drawn = weight + np.array([noise(k, seed) for k in b.column("_key").to_pylist()], np.int64)
            cols = [b.column("_id"), *(pa.array(x, pa.int64()) for x in (features, words, weight, drawn))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "n_features", "n_words", "weight", "score"])

    return texts.mapInArrow(tidy(score), f"_id {kind}, n_features long, n_words long, weight long, score long")


class Tournament:
    """A tree whose root is the least of its leaves' keys; a leaf that is free has the key ``_LAST``."""

    _LAST = (math.inf,)

    def __init__(self):
        self.keys, self.free, self.tree = [self._LAST], [0], [0, 0]

    @property
    def winner(self) -> int:
        return self.tree[1]

    def best(self) -> tuple:
        return self.keys[self.tree[1]]

    def put(self, leaf: int, key: tuple) -> None:
        """Gives a leaf its next key and plays its matches up to the root again."""
        self.keys[leaf] = key
        tree, keys = self.tree, self.keys
        at = (leaf + len(keys)) >> 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = b if keys[b] < keys[a] else a
            at >>= 1

    def add(self, key: tuple) -> int:
        if not self.free:  # twice the leaves, and all matches again
            n = len(self.keys)
            self.free = list(range(2 * n - 1, n - 1, -1))
            self.keys += [self._LAST] * n
            self.tree = [0] * (2 * n) + list(range(2 * n))
            for at in range(2 * n - 1, 0, -1):
                a, b = self.tree[2 * at], self.tree[2 * at + 1]
                self.tree[at] = b if self.keys[b] < self.keys[a] else a
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    def drop(self, leaf: int) -> None:
        self.put(leaf, self._LAST)
        self.free.append(leaf)


def merge(pieces: Iterable[tuple[object, list[tuple]]]) -> Iterator[tuple]:
    """The entries of sorted runs, in order.  ``pieces``: (run, entries), in the order of their first entries; the pieces
    of a run follow each other.  No more entries are held than those of the pieces that have begun."""
    tree, leaf_of, cursor, waiting = Tournament(), {}, {}, {}
    coming = iter(pieces)
    piece = next(coming, None)
    while piece is not None or leaf_of:
        while piece is not None and (not leaf_of or piece[1][0] <= tree.best()):
            run, entries = piece
            if run in leaf_of:
                waiting.setdefault(run, deque()).append(entries)
            else:
                leaf = tree.add(entries[0])
                leaf_of[run], cursor[leaf] = leaf, (run, entries, 0)
            piece = next(coming, None)
        leaf = tree.winner
        run, entries, at = cursor[leaf]
        yield entries[at]
        at += 1
        if at == len(entries) and waiting.get(run):
            entries, at = waiting[run].popleft(), 0
        if at < len(entries):
            cursor[leaf] = (run, entries, at)
            tree.put(leaf, entries[at])
        else:
            tree.drop(leaf)
            del leaf_of[run], cursor[leaf]


class Ranges:
    """Ranges of whole scores from the top, each of ``rows`` documents or little more, as far as the draw goes."""

    def __init__(self, histogram: dict[int, int], draw: int, rows: int):
        self.low, self.base, total = [], [], 0
        for score in sorted(histogram, reverse=True):
            if total >= draw:
                break
            if not self.base or total - self.base[-1] >= rows:
                self.base.append(total)
                self.low.append(score)
            self.low[-1] = score
            total += histogram[score]
        self.up = -np.array(self.low, np.int64)

    def of(self, scores: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.up, -scores)


def _runs(candidates: DataFrame, kind: str, ranges: Ranges, piece_rows: int) -> DataFrame:
    """Each partition sorted, equal rows counted, cut at the ranges and into pieces."""
    entry = f"_range long, _run long, _head_score long, _head_id {kind}, ids array<{kind}>, n_features array<long>, weight array<long>, score array<long>, n array<long>"
    ordered = candidates.withColumn("_run", F.spark_partition_id().cast("long")).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("_id"), "n_features", "weight")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: pa.Schema | None = None

        def rows(held: list[list], where: int, run: int) -> pa.RecordBatch:
            ids, features, weights, scores, counts = zip(*held, strict=True)
            made = {"_range": where, "_run": run, "_head_score": scores[0], "_head_id": ids[0], "ids": ids, "n_features": features, "weight": weights, "score": scores, "n": counts}
            return pa.RecordBatch.from_pylist([made], schema=schema)

        held: list[list] = []
        where, run = -1, 0
        for b in batches:
            if schema is None:
                longs, own = pa.list_(pa.int64()), b.column("_id").type
                schema = pa.schema([("_range", pa.int64()), ("_run", pa.int64()), ("_head_score", pa.int64()), ("_head_id", own), ("ids", pa.list_(own)), *((k, longs) for k in ("n_features", "weight", "score", "n"))])
            at = ranges.of(b.column("score").to_numpy()).tolist()
            columns = [b.column(c).to_pylist() for c in ("_id", "n_features", "weight", "score", "_run")]
            for k, *row, run in zip(at, *columns, strict=True):  # noqa: B007
                if held and k == where and row == held[-1][:4]:
                    held[-1][4] += 1
                    continue
                if held and (k != where or len(held) == piece_rows):
                    yield rows(held, where, run)
                    held = []
                where = k
                held.append([*row, 1])
        if held:
            yield rows(held, where, run)

    return ordered.mapInArrow(tidy(cut), entry)


def _merged(runs: DataFrame, kind: str, ranges: Ranges, draw: int) -> DataFrame:
    """(_id, n_features, weight, score, _first, _n): entries with the rank of their first row, null beyond the draw."""
    dealt = runs.repartition("_range").sortWithinPartitions("_range", F.desc("_head_score"), F.asc_nulls_first("_head_id"))

    def entries(row: dict) -> list[tuple]:
        # a tuple that sorts as the draw ranks; the id itself comes after what tells null from others
        columns = (row[c] for c in ("score", "ids", "n_features", "weight", "n"))
        return [(-s, *((0, 0) if i is None else (1, i)), f, w, n) for s, i, f, w, n in zip(*columns, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: pa.DataType | None = None

        def stream() -> Iterator[dict]:
            nonlocal own
            for b in batches:
                own = b.column("_head_id").type
                for k in range(b.num_rows):
                    yield b.slice(k, 1).to_pylist()[0]

        rows = stream()
        row = next(rows, None)
        while row is not None:
            where = row["_range"]

            def pieces(where: int = where) -> Iterator[tuple[int, list[tuple]]]:
                nonlocal row
                while row is not None and row["_range"] == where:
                    mine, row = row, next(rows, None)
                    yield mine["_run"], entries(mine)

            rank, out = ranges.base[where], []
            coming = pieces()
            for minus, has, i, features, weight, n in merge(coming):
                drawn = max(0, min(n, draw - rank))
                row_id = i if has else None
                if drawn:
                    out.append((row_id, features, weight, -minus, rank + 1, drawn))
                if n > drawn:
                    out.append((row_id, features, weight, -minus, None, n - drawn))
                rank += n
                if len(out) >= 8192:
                    yield batch(out, own)
                    out = []
            if out:
                yield batch(out, own)

    def batch(out: list[tuple], own: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], own), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["_id", "n_features", "weight", "score", "_first", "_n"])

    return dealt.mapInArrow(tidy(work), f"_id {kind}, n_features long, weight long, score long, _first long, _n long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = 7, n_buckets: int = BUCKETS, range_rows: int = RANGE_ROWS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` is null for those that are not drawn."""
    box, wanted = Boxed(docs), Boxed(target)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = box.df.select(box.col(id_col).alias("_id"), text_of(box.col(id_col)).alias("_key"), text_of(box.col(text_col)).alias("_text"))
    gain = gains(bucket_counts(texts, n_buckets), bucket_counts(wanted.df.select(text_of(wanted.col(target_text_col)).alias("_text")), n_buckets))
    found = stored(scored(texts, gain, kind, seed), "scored")
    eligible = F.col("n_words") >= min_words
    histogram = {r["score"]: r["n"] for r in found.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()}
    draw = percent * sum(histogram.values()) // 100
    ranges = Ranges(histogram, draw, range_rows)
    columns = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return found.select(*columns, none)
    near = eligible & (F.col("score") >= ranges.low[-1])
    merged = stored(_merged(_runs(found.where(near).drop("n_words"), kind, ranges, piece_rows), kind, ranges, draw), "drawn")
    few = merged.where(F.col("_n") <= REPEAT_ROWS).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    many = merged.where(F.col("_n") > REPEAT_ROWS).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(REPEAT_ROWS)))).repartition("_b")
    many = many.withColumn("_k", F.explode(F.sequence("_b", F.least(F.col("_b") + REPEAT_ROWS, F.col("_n")) - 1))).drop("_b")
    ranked = few.unionAll(many).select(*columns, (F.col("_first") + F.col("_k")).alias("rank"))
    return found.where(~near).select(*columns, none).unionAll(ranked)
