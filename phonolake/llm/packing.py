"""Best-fit packing: documents as token sequences of a fixed length, best-two-fit.

Only the last piece of a document is shorter than a sequence, and a piece matters to the packing by its length alone.
So the plan is made over the histogram of lengths (at most ``seq_len`` counts, whatever the input): a bin is filled
greedily with the longest pieces that fit, then its smallest piece is replaced by two unpacked pieces that fill the
expanded gap more tightly; the finished bin is repeated as often as the counts allow.  A plan line thus stands for many
equal sequences, and the plan has no more lines than a few times ``seq_len``.

Pieces find their place by their rank among pieces of their length.  The rank is counted in hash buckets and the
buckets' sums are added up, so a length that a third of all pieces share is spread over all tasks.

Defined results: null text is empty and yields one piece with the single id 0; repeated rows are packed each on its own
(equal rows are interchangeable); a null id is kept; nothing is dropped or cut but documents longer than a sequence; very
long texts are read whole; an empty table gives an empty one; columns other than id and text are not read, whatever their
names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Boxed, Growing, stored, text_of, tidy
from .words import BATCH_BYTES, MAX_WORD, Remembered

SEQ_LEN = 2048
#: Pieces of words whose ids a worker remembers before it starts afresh.
MAX_CACHED_WORDS = 900_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Classes of bytes: white space, ASCII letters, digits, other ASCII, and what is never cut from its neighbours:
#: apostrophes (contractions) and all other bytes.
_GAP, _LETTER, _DIGIT, _SYMBOL, _JOINED = range(5)
_CLASS = np.array(
    [
        _GAP if c in b" \t\n\r\x0b\x0c" else _JOINED if c >= 128 or c == 39 else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SYMBOL
        for c in range(256)
    ],
    np.uint8,
)
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)])
#: _CUT[a, b]: whether the tokenizer cuts between bytes of these classes in any case.
_CUT = np.array([[a in (_GAP,) or b == _GAP or (_JOINED not in (a, b) and (a != b or a == _DIGIT)) for b in range(5)] for a in range(5)])
_SPECIAL = re.compile(rb"<\|(?:start|end)oftext\|>")
#: The normalizer and the pattern of words of a tokenizer file to which the cuts above apply.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(path: str) -> bool:
    """Whether the tokenizer of the file lowers letters and cuts words as ``WordTokenizer`` assumes."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    splits = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = (found.get("normalizer") or {}).get("normalizers") == _NORMAL and splits[0].get("pattern") == {"Regex": _PATTERN}
    known = all(_SPECIAL.fullmatch(t["content"].encode()) for t in found.get("added_tokens") or ())
    return same and splits[0].get("behavior") == "Removed" and known and found.get("post_processor") is None


class WordTokenizer:
    """Token ids of whole texts, by way of each text's words.

    The tokenizer drops white space, lowers all letters, and cuts between letters, digits and symbols before it merges.
    So texts are cut there, ASCII is lowered, and each distinct piece is encoded once and remembered; a text's ids are its
    pieces' ids one after the other.  Texts that hold a special token's string are encoded as they are, and so are all texts
    under a file with other rules.
    """

    def __init__(self, path: str):
        # one thread a task: more threads would take the cores of other tasks, and memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), cuts_words(path)
        self.words = Remembered(_FOLD, MAX_CACHED_WORDS)
        self._reset()

    def _reset(self) -> None:
        self.words.reset()
        self.start, self.count, self.flat = Growing("i8"), Growing("i8"), Growing("<u4")

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(pieces), 2048):  # an encoding is large; few are held at once
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces[at : at + 2048]], add_special_tokens=False)
            out += [x.ids for x in found]
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        ids = self._encode(pieces)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start.extend(self.flat.size + np.cumsum(count) - count)
        self.count.extend(count)
        self.flat.extend(np.fromiter(chain.from_iterable(ids), "<u4", int(count.sum())))

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of UTF-8 bytes."""
        if not self.by_words:
            return [np.array(x, "<u4") for x in self._encode(texts)]
        if self.words.full:
            self._reset()
        joined = b" ".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        kind = _CLASS[raw]
        begins = np.ones(len(raw), bool)
        begins[1:] = _CUT[kind[:-1], kind[1:]]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        real = kind[start] != _GAP
        start, end = start[real], end[real]
        short = end - start <= MAX_WORD
        at = self.words.numbers(joined, raw, start[short], end[short], self._learn)
        count, first, flat = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), self.flat.room
        count[short], first[short] = self.count.room[at], self.start.room[at]
        if not short.all():  # long pieces are encoded each time
            ids = self._encode([joined[a:b] for a, b in zip(start[~short].tolist(), end[~short].tolist(), strict=True)])
            sizes = np.cumsum([0, *map(len, ids)])
            count[~short], first[~short] = np.diff(sizes), self.flat.size + sizes[:-1]
            flat = np.concatenate([flat[: self.flat.size], np.fromiter(chain.from_iterable(ids), "<u4", int(sizes[-1]))])
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(first - (ends - count), count) + np.arange(total)]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at_text = np.concatenate([[0], ends])[np.searchsorted(start, bounds)]
        found = [out[a:b] for a, b in zip(at_text[:-1].tolist(), at_text[1:].tolist(), strict=True)]
        if b"oftext|>" in joined:
            for k, t in enumerate(texts):
                if _SPECIAL.search(t):
                    found[k] = np.array(self._encode([t])[0], "<u4")
        return found

    def encode(self, raw: bytes) -> np.ndarray:
        return self.encode_many([raw])[0]

    def encode_stream(self, texts: Iterator[bytes]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                yield from self.encode_many(held)
                held, size = [], 0
        yield from self.encode_many(held)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file, kept over tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    seq_len: int = SEQ_LEN, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut only if longer than
    ``seq_len``."""
    path = tokenizer or default_tokenizer()
    box = Boxed(docs)
    slim = box.df.select(box.col(id_col).cast("long").alias("doc_id"), text_of(box.col(text_col)).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            texts = (x.as_py() for x in batch.column(1).cast(pa.binary()))
            for doc_id, own in zip(batch.column(0).to_pylist(), words.encode_stream(texts), strict=True):
                ids = np.append(own, np.array([end_id], "<u4"))
                for piece, at in enumerate(range(0, len(ids), seq_len)):
                    part = ids[at : at + seq_len]
                    for k, v in zip(out, (doc_id, piece, at, len(part), zlib.crc32(part.tobytes()), part.astype("i4")), strict=True):
                        out[k].append(v)
            cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32())]
            cols += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return slim.mapInArrow(tidy(cut), schema)


def plan_bins(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, number of such bins)] that uses up the histogram of lengths, best-two-fit."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(k < 1 or k > seq_len for k in left):
        raise ValueError("a length is out of range")
    sizes = sorted(left)
    plan = []
    while sizes:
        used: Counter[int] = Counter()
        bin_, gap = [], seq_len

        def longest(most: int, sizes=sizes, used=used) -> int | None:
            i = bisect_right(sizes, most) - 1
            while i >= 0 and left[sizes[i]] <= used[sizes[i]]:
                i -= 1
            return sizes[i] if i >= 0 else None

        while gap and (x := longest(gap)) is not None:
            bin_.append(x)
            used[x] += 1
            gap -= x
        if gap and len(bin_) > 1:
            least = bin_[-1]
            used[least] -= 1
            free = [s for s in sizes if left[s] > used[s] and s <= gap + least]
            best = (least, None, None)
            if free:
                a = np.array(free)
                b = np.searchsorted(a, gap + least - a, side="right") - 1
                ok = (b >= 0) & (a >= a[b.clip(0)])
                # a length is its own partner only if two pieces of it are left; where it is and one is left, no longer partner
                # fits beside it, and shorter ones look at it themselves: the best of what remains is the best of all pairs
                two = np.array([left[s] - used[s] >= 2 for s in free])
                total = np.where(ok & ((b != np.arange(len(a))) | two), a + a[b.clip(0)], -1)
                i = int(total.argmax())
                if total[i] > least:
                    best = (int(total[i]), int(a[i]), int(a[b[i]]))
            if best[1] is None:
                used[least] += 1
            else:
                bin_[-1:] = [best[1], best[2]]
                used[best[1]] += 1
                used[best[2]] += 1
        times = min(left[x] // n for x, n in used.items() if n)
        plan.append((bin_, times))
        for x, n in used.items():
            left[x] -= n * times
        sizes = [s for s in sizes if left[s]]
    return plan


def pack(parts: DataFrame, seq_len: int = SEQ_LEN, rows_per_bucket: int = 200_000) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32 and others) with sequence_id and offset."""
    parts = stored(parts, "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # seq_len rows at most
    plan = plan_bins(counts, seq_len)
    # one entry for each line of the plan and length in it, sorted by length, then by the first rank that it takes
    entries, taken, base = [], Counter(), 0
    for lengths, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, own in offsets.items():
            entries.append((x, taken[x], base, own))
            taken[x] += len(own) * times
        base += times
    entries.sort(key=lambda e: e[:2])
    length_of = np.array([e[0] for e in entries], np.int64)
    rank_of = np.array([e[1] for e in entries], np.int64)
    base_of = np.array([e[2] for e in entries], np.int64)
    per_bin = np.array([len(e[3]) for e in entries], np.int64)
    offset_at = np.cumsum(per_bin) - per_bin
    offsets_flat = np.array([o for e in entries for o in e[3]], np.int64)
    key_of = (length_of << 44) + rank_of

    buckets = max(8, -(-sum(counts.values()) // rows_per_bucket))
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("_own", own - 1).join(sums, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket")
    names = [c for c in parts.columns]
    ranked = ranked.select(*names, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            j = np.searchsorted(key_of, (length << 44) + rank, side="right") - 1
            t = rank - rank_of[j]
            seq = base_of[j] + t // per_bin[j]
            off = offsets_flat[offset_at[j] + t % per_bin[j]]
            cols = [batch.column(n) for n in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(tidy(place), f"{fields}, sequence_id long, offset long")
