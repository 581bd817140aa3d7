"""Benchmark decontamination by template canonicalisation.

Texts are read as tokens (runs without ASCII white space, reduced to their letters and digits).  Numbers in digits or
English words, units after numbers, and names (capitalised words inside a sentence) become typed placeholders, so that a
question with other numbers or names has the same template; a run of name words without punctuation inside is one
placeholder, and so is a number of several words.  A capitalised word that begins a sentence may be a name or not: texts
are read both ways, and each window of an item is indexed with every choice.  Windows of ``WINDOW`` template tokens are
hashed and looked up in the windows of the benchmark.  Hits are aligned: those count together whose shifts against the item
differ by no more words than the item has, so that words put in between part nothing, and a stray phrase elsewhere adds
nothing.  An alignment that holds at least ``min_share`` of an item's windows is a copy if equal values in the item's slots
have equal values in the document's, over all slots of the windows that it holds (slot consistency).

The literal windows, lower-cased, are looked up beside the template windows, so that copies in another case or without
punctuation are found; they are a share of their own, under the same slot consistency.  A document that holds ``min_share`` of
them in pieces too far apart for an alignment is reported too.  Template windows short of ``MIN_LITERALS`` literals count as held where their literal windows are, in a third share over all windows;
shares of template windows alone leave them out, so that other numbers in them lose nothing.
The benchmark is a stated query set.  It is processed in blocks of bounded size against all documents, so its index in
memory is bounded whatever its size.  Documents are read once for each block and never shuffled; only hits are grouped.

Defined results: null texts have no tokens; an item with fewer tokens than a window is matched as one window of all its
tokens; items without tokens match nothing; repeated rows are reported once; a null id, of a document or an item, is reported
as null; very long texts are read whole; an empty table on either side gives an empty one; columns other than ids and texts
are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Boxed, Growing, tidy
from .words import BATCH_BYTES, MAX_WORD, Remembered

WINDOW = 5
MIN_SHARE = 0.8
#: A window with fewer literals says too little as a template; it is compared by its literal words, values included.
MIN_LITERALS = 2
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20
MAX_CACHED_WORDS = 400_000
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs hour hours day days week weeks year years percent"
    " dollars euros cents meters metres miles kilometers kilograms grams liters litres seconds minutes degrees".split()
)
_NUM, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"<number>", b"<unit>", b"<name>"))
#: Marks literal windows among the hashes and choices.
LITERAL = 1 << 40
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ENDS = (".", "!", "?", ":", "。")
CAP, DIGIT, IS_UNIT, ENDS, EMPTY, BREAK, WORDED = 1, 2, 4, 8, 16, 32, 64
#: Kinds of tokens; FIRST is a capitalised word at the beginning of a sentence.
PLAIN, NUMBER, NUMBER_WORD, IN_UNIT, NAME, FIRST = range(6)
_ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    " nineteen"
).split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_POWERS = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
NUMBER_WORDS = {w: n for n, w in enumerate(_ONES)} | {w: 20 + 10 * n for n, w in enumerate(_TENS)} | _POWERS
NUMBER_WORDS |= {t + o: 20 + 10 * n + k for n, t in enumerate(_TENS) for k, o in enumerate(_ONES[:10]) if k}
_NUMBER_OF = {xxhash.xxh64_intdigest(w.encode()): n for w, n in NUMBER_WORDS.items()}


def _word(raw: str) -> tuple[int, int]:
    """Hash of the literal token and its flags."""
    core = "".join(c for c in raw if c.isalnum())
    low = core.casefold()
    flags = 0
    if not core:
        flags |= EMPTY
    elif any(c.isdigit() for c in core):
        flags |= DIGIT
    elif low in NUMBER_WORDS:
        flags |= WORDED
    elif core[0].isupper():
        flags |= CAP
    if low in UNITS:
        flags |= IS_UNIT
    if raw.rstrip("\"')]»”’*#$%&!").endswith(_ENDS) or raw.endswith(("!", "?")):
        flags |= ENDS
    if not raw[-1].isalnum():
        flags |= BREAK
    return xxhash.xxh64_intdigest(low.encode()), flags


_GAP = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


class Reader:
    """Reads texts as hashed tokens, many at once; remembers words, as far as ``MAX_CACHED_WORDS`` allows."""

    def __init__(self) -> None:
        self.words = Remembered(None, MAX_CACHED_WORDS)
        self.hash, self.flags = Growing("u8"), Growing("u1")

    def _learn(self, words: list[bytes]) -> None:
        made = [_word(w.decode("utf-8")) for w in words]
        self.hash.extend(np.array([m[0] for m in made], np.uint64))
        self.flags.extend(np.array([m[1] for m in made], np.uint8))

    def read_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of UTF-8 texts, one text after the other: literal hash, kind, whether no punctuation stands
        between it and the token before; and where each text begins, with the end behind the last."""
        if self.words.full:
            self.__init__()
        joined = b" ".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        gap = np.concatenate([[True], _GAP[raw], [True]])
        start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        short = end - start <= MAX_WORD
        literal, flags = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint8)
        at = self.words.numbers(joined, raw, start[short], end[short], self._learn)
        literal[short], flags[short] = self.hash.room[at], self.flags.room[at]
        for k in np.flatnonzero(~short).tolist():
            literal[k], flags[k] = _word(joined[start[k] : end[k]].decode("utf-8"))
        ends = np.ones(len(start), bool)  # a token begins a sentence at the beginning and behind a token that ends one
        ends[1:] = (flags[:-1] & ENDS) > 0
        ends[bounds[:-1][bounds[:-1] < len(start)]] = True
        joins = np.zeros(len(start), bool)
        joins[1:] = (flags[:-1] & (BREAK | EMPTY)) == 0
        joins[bounds[:-1][bounds[:-1] < len(start)]] = False
        real = (flags & EMPTY) == 0
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        literal, flags, ends, joins = literal[real], flags[real], ends[real], joins[real]
        number = (flags & (DIGIT | WORDED)) > 0
        after = np.zeros(len(flags), bool)
        after[1:] = number[:-1]
        after[bounds[:-1][bounds[:-1] < len(flags)]] = False
        kind = np.where((flags & CAP) > 0, np.where(ends, np.uint8(FIRST), np.uint8(NAME)), np.uint8(PLAIN))
        kind[after & ((flags & IS_UNIT) > 0)] = IN_UNIT
        kind[(flags & DIGIT) > 0] = NUMBER
        kind[(flags & WORDED) > 0] = NUMBER_WORD
        return literal, kind, joins, bounds

    def read(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.read_many([raw or b""])[:3]


_READERS: list[Reader] = []


def worker_reader() -> Reader:
    """One for each worker process, kept over tasks."""
    if not _READERS:
        _READERS.append(Reader())
    return _READERS[0]


def template_of(literal: np.ndarray, kind: np.ndarray, joins: np.ndarray, named: bool) -> tuple[np.ndarray, np.ndarray]:
    """The template's tokens and the place of each one's first word; ``named``: words that begin sentences are names."""
    kind = np.where(kind == FIRST, np.uint8(NAME if named else PLAIN), kind)
    template = literal.copy()
    number = (kind == NUMBER) | (kind == NUMBER_WORD)
    template[number], template[kind == IN_UNIT], template[kind == NAME] = _NUM, _UNIT, _NAME
    head = np.ones(len(kind), bool)
    more = ((kind[1:] == NAME) & (kind[:-1] == NAME)) | ((kind[1:] == NUMBER_WORD) & number[:-1])
    head[1:] = ~(joins[1:] & more)
    at = np.flatnonzero(head)
    return template[at], at


def value_of(literal: list[int], kind: int) -> int:
    """What stands in a slot, given its words; a number in words is equal to the same number in digits."""
    if kind == NUMBER_WORD:
        total = part = 0
        for word in literal:
            n = _NUMBER_OF[word]
            if n == 100:
                part = max(part, 1) * 100
            elif n > 100:
                total, part = total + max(part, 1) * n, 0
            else:
                part += n
        return xxhash.xxh64_intdigest(str(total + part).encode())
    return literal[0] if len(literal) == 1 else hash(tuple(literal))


def windows(tokens: np.ndarray, size: int = WINDOW, seed: int = 0) -> np.ndarray:
    """Hashes of the windows."""
    n = len(tokens) - size + 1
    h = np.full(max(n, 0), size + seed, np.uint64)
    for i in range(size if n > 0 else 0):
        h = (h ^ tokens[i : n + i]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def _hash(tokens: list[int]) -> int:
    """``windows`` of one window."""
    h = len(tokens)
    for t in tokens:
        h = ((h ^ t) * int(_MUL)) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


class Index:
    """The benchmark items of one block: window hash -> (item, place, choices)."""

    def __init__(self, items: list[tuple[int | None, str]], size: int = WINDOW):
        reader = Reader()
        self.ids, self.tokens, self.size = [], [], size
        #: for each item and place: a window begins there; it counts, sentences' first words being plain; or being names
        self.begins, self.plain, self.named = [], [], []
        #: literal windows of each item
        self.lengths: list[int] = []
        self.sizes = {size}
        rows: set[tuple[int, int, int, int]] = set()
        for item_id, text in items:
            literal, kind, joins = reader.read(text.encode("utf-8", "replace"))
            n = len(literal)
            if not n:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.tokens.append((literal, kind, joins))
            begins, plain, named = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
            mine = set()
            for i in template_of(literal, kind, joins, False)[1].tolist():
                for bits, every, tokens in self._choices(k, i):
                    if len(tokens) < size and i:
                        continue
                    begins[i] |= not bits
                    if sum(t[1] in (PLAIN, FIRST) for t in tokens) < min(MIN_LITERALS, len(tokens)):
                        continue
                    plain[i] |= not bits
                    named[i] |= bits == every
                    self.sizes.add(len(tokens))
                    mine.add((_hash([t[0] for t in tokens]), k, i, bits))
            self.begins.append(begins)
            self.plain.append(plain)
            self.named.append(named)
            literals = windows(literal, min(size, n), LITERAL)
            self.sizes.add(min(size, n))
            self.lengths.append(len(literals))
            mine |= {(int(x), k, i, LITERAL) for i, x in enumerate(literals)}
            rows |= mine
        table = sorted(rows)
        self.hash = np.array([r[0] for r in table], np.uint64)
        self.item, self.place = (np.array([r[c] for r in table], np.int32) for c in (1, 2))
        self.bits = np.array([r[3] for r in table], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def _window(self, k: int, i: int, bits: int) -> tuple[list[tuple[int, int, int]], int]:
        """(template hash, kind, value) of the tokens of item k's window that begins at word i, and the number of words
        in it that begin a sentence; the bits tell which of those are names."""
        literal, kind, joins = self.tokens[k]
        out: list[tuple[int, int, list[int]]] = []
        used, before = 0, PLAIN
        for j in range(i, len(literal)):
            c, word = int(kind[j]), int(literal[j])
            first = c == FIRST
            if j > i and joins[j] and ((c == NAME and before == NAME) or (c == NUMBER_WORD and before in (NUMBER, NUMBER_WORD))):
                out[-1][2].append(word)
                before = c
                continue
            if len(out) == self.size:
                break
            if first:
                c = NAME if bits >> used & 1 else PLAIN
                used += 1
            before = c
            mark = {NUMBER: _NUM, NUMBER_WORD: _NUM, IN_UNIT: _UNIT, NAME: _NAME}.get(c, word)
            out.append((int(mark), c, [word]))
        return [(t, c, value_of(words, c)) for t, c, words in out], used

    def _choices(self, k: int, i: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(bits, bits if all are names, tokens) of the window at i, for every choice of names."""
        open_ = [(0, 0)]
        while open_:
            bits, known = open_.pop()
            tokens, used = self._window(k, i, bits)
            if used > known:
                open_ += [(bits, known + 1), (bits | 1 << known, known + 1)]
            else:
                yield bits, (1 << used) - 1, tokens

    def _streams(self, literal: np.ndarray, kind: np.ndarray, joins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(tokens, places, seed of their windows) of each way to read texts."""
        for named in (False, True):
            yield *template_of(literal, kind, joins, named), 0
        yield literal, np.arange(len(literal)), LITERAL

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes the items have."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.hash):
            return at[:0]
        place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        return at[self.hash[place] == h[at]]

    def candidates(self, literal: np.ndarray, kind: np.ndarray, joins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of many texts, those with a window that the items have."""
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = [np.zeros(0, np.int64)]
        for tokens, places, seed in self._streams(literal, kind, joins):
            own = text_of[places]
            for size in self.sizes:
                at = self._found(windows(tokens, size, seed))
                found.append(own[at[own[at] == own[at + size - 1]]])
        return np.unique(np.concatenate(found))

    def search(self, literal: np.ndarray, kind: np.ndarray, joins: np.ndarray, min_share: float) -> list[tuple]:
        """(item id, windows hit, windows, share, same values) of each item that the text holds."""
        # item -> place -> (word of the text, stream, place in the stream, choices)
        hits: dict[int, dict[int, list[tuple[int, int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        exact: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        streams = list(self._streams(literal, kind, joins))
        for s, (tokens, places, seed) in enumerate(streams):
            for size in self.sizes:
                h = windows(tokens, size, seed)
                at = self._found(h)
                lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
                for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    for r in range(a, b):
                        if seed:
                            if self.bits[r] == LITERAL:
                                exact[int(self.item[r])][int(self.place[r])].append(p)
                            continue
                        hits[int(self.item[r])][int(self.place[r])].append((int(places[p]), s, p, int(self.bits[r])))
        found = []
        for k in sorted(hits.keys() | exact.keys()):
            if copy := self._copy(k, hits[k], exact[k], streams, literal, kind, min_share):
                found.append((self.ids[k], *copy))
        return found

    def _copy(self, k: int, hits: dict, exact: dict, streams: list, literal: np.ndarray, kind: np.ndarray, min_share: float) -> tuple | None:
        """(windows hit, windows, share, same values) of the first alignment that is a copy, the one of most hits first; of
        the literal windows, if they are enough and no alignment is."""
        reach = len(self.tokens[k][0])
        # (shift, place, hit); literal hits have no slots to compare
        at = sorted([(one[0] - place, place, one) for place, some in hits.items() for one in some] + [(p - place, place, ()) for place, some in exact.items() for p in some])
        shifts = [x[0] for x in at]
        least = min_share * min([int(ok.sum()) for ok in (self.plain[k], self.named[k], self.begins[k]) if ok.any()] + [self.lengths[k]])
        wide: list[tuple[int, int]] = []  # (distinct places within reach, shift) of each shift that may hold enough of them
        inside: Counter[int] = Counter()
        lo = hi = 0
        for j, d in enumerate(shifts):
            if j and d == shifts[j - 1]:
                continue
            while hi < len(at) and shifts[hi] <= d + reach:
                inside[at[hi][1]] += 1
                hi += 1
            while shifts[lo] < d - reach:
                inside[at[lo][1]] -= 1
                if not inside[at[lo][1]]:
                    del inside[at[lo][1]]
                lo += 1
            if len(inside) >= least:
                wide.append((len(inside), d))
        aligned = False
        for _, d in sorted(wide, key=lambda x: (-x[0], x[1])):
            nearest: dict[int, tuple[int, tuple]] = {}
            literals: set[int] = set()
            for shift, place, one in at[bisect_left(shifts, d - reach) : bisect_right(shifts, d + reach)]:
                if not one:
                    literals.add(place)
                elif place not in nearest or abs(shift - d) < nearest[place][0]:
                    nearest[place] = (abs(shift - d), one)
            held = list(nearest)
            counts = [(int(ok[held].sum()), int(ok.sum())) for ok in (self.plain[k], self.named[k])]
            counts.append((len(literals), self.lengths[k]))
            begun = [p for p in nearest.keys() | literals if p < len(self.begins[k])]
            counts.append((int(self.begins[k][begun].sum()), int(self.begins[k].sum())))
            hit, all_ = max(counts, key=lambda c: c[0] / c[1] if c[1] else 0)
            if not all_ or hit < min_share * all_:
                continue
            aligned = True
            pairs: dict[int, int] = {}
            # where the words themselves are held, each slot holds its own value
            slots = [
                (mine, mine if place in literals else theirs)
                for place, (_, one) in nearest.items() for mine, theirs in self._values(k, place, *one[1:], streams, literal, kind)
            ]
            if all(pairs.setdefault(mine, theirs) == theirs for mine, theirs in slots):
                return hit, all_, hit / all_, all(mine == theirs for mine, theirs in slots)
        if not aligned and len(exact) >= min_share * self.lengths[k]:
            return len(exact), self.lengths[k], len(exact) / self.lengths[k], True
        return None

    def _values(self, k: int, place: int, s: int, p: int, bits: int, streams: list, literal: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
        """(value of the item, value of the text) in each slot of a window."""
        places = streams[s][1]
        for q, (_, c, mine) in enumerate(self._window(k, place, bits)[0], p):
            if c not in (PLAIN, FIRST):
                a, b = int(places[q]), int(places[q + 1]) if q + 1 < len(places) else len(literal)
                yield mine, value_of(literal[a:b].tolist(), int(kind[a]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_share: float = MIN_SHARE, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_hit, n_windows, share, same_values): every document and item that it holds."""
    found = _held(docs, benchmark, id_col, text_col, item_col, item_text_col, min_share, window, block_bytes)
    return found.drop("_th").distinct()


def _held(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
    min_share: float, window: int, block_bytes: int,
) -> DataFrame:
    """The columns of ``contaminated`` behind ``_th``, the text's hash, which tells rows of one id, or of none, apart."""
    box, bench = Boxed(docs), Boxed(benchmark)
    text = box.col(text_col).cast("string")
    slim = box.df.select(F.xxhash64(text).alias("_th"), box.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    items = bench.df.select(bench.col(item_col).cast("long").alias("i"), bench.col(item_text_col).cast("string").alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted(block.collect(), key=lambda r: (r["i"] is None, r["i"] or 0, r["t"]))
        index = Index([(r["i"], r["t"]) for r in rows], window)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reader, index = worker_reader(), shared.value
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            names = ["_th", "doc_id", "item_id", "n_hit", "n_windows", "share", "same_values"]

            def some(ids: list[tuple[int, int | None]], texts: list[bytes]) -> list[tuple]:
                literal, kind, joins, bounds = reader.read_many(texts)
                rows = []
                for k in index.candidates(literal, kind, joins, bounds).tolist():
                    own = slice(bounds[k], bounds[k + 1])
                    rows += [(*ids[k], *f) for f in index.search(literal[own], kind[own], joins[own], min_share)]
                return rows

            for b in batches:
                rows, ids, held, size = [], [], [], 0
                for h, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                    ids.append((h, d))
                    held.append(t.as_py() or b"")
                    size += len(held[-1])
                    if size >= BATCH_BYTES:
                        rows += some(ids, held)
                        ids, held, size = [], [], 0
                rows += some(ids, held)
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        found = slim.mapInArrow(tidy(look), "_th long, doc_id long, item_id long, n_hit long, n_windows long, share double, same_values boolean")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_share: float = MIN_SHARE, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows that share an id, or have none, are judged one by one."""
    held = _held(docs, benchmark, id_col, text_col, item_col, item_text_col, min_share, window, block_bytes)
    bad = held.select(F.col("doc_id").alias("_bad"), F.col("_th").alias("_bth")).distinct()
    box = Boxed(docs)
    base = box.df.withColumn("_id", box.col(id_col).cast("long")).withColumn("_th", F.xxhash64(box.col(text_col).cast("string")))
    return box.restore(base.join(bad, base["_id"].eqNullSafe(bad["_bad"]) & (base["_th"] == bad["_bth"]), "left_anti"), {})
