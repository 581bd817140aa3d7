"""Alignment of many rows at once.

Symbols become numbers.  A line of a pair's table of least edits is a few numbers of as many bits as the other side has places; of
these only a stretch is held where all would be too many, and a stretch is made again when the walk back comes to it, so memory
grows with the lengths and not with their product.  Prompts are placed on pairs within a band, many at once.  For weighted distances
rows are grouped by length, and a diagonal of all tables of a group is one step of numpy.  Equal rows of a batch are aligned once.
Results are those of the functions on single rows in ``align``.

The joint alignment of three sequences searches no cube.  Its first term is least exactly where prompt and uttered phones are
aligned at least cost, and its second where uttered and predicted phones agree most; both can be had at once, as a predicted
phone may always stand alone.  So a best path runs through places that lie on a best path of either pair, along moves that
keep both best; tables of the two pairs tell these places, and only they are visited, in the order of their sums, of which the
last three are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = "-"
#: Moves of a group of tables that are held at once, and places of joint alignments.
_CELLS = 1 << 25
_PLACES = 1 << 21
#: Places of prompts on pairs that are worked on together; a prompt with more is placed by itself, in less memory.
_LARGE = 1 << 17
#: Places of joint alignments whose moves are worked out at once.
_BULK = 1 << 16
DIAGONAL, DOWN, RIGHT = 0, 1, 2


class Ragged:
    """Rows of numbers of different lengths."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.size)

    def row(self, k: int) -> np.ndarray:
        return self.flat[self.start[k] : self.start[k] + self.size[k]]

    def padded(self, rows: np.ndarray, fill: int) -> np.ndarray:
        width = int(self.size[rows].max(initial=0))
        at = self.start[rows][:, None] + np.arange(width)
        inside = np.arange(width) < self.size[rows][:, None]
        return np.where(inside, self.flat[np.where(inside, at, 0)] if len(self.flat) else fill, fill)

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Ragged:
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows], np.int64))


def numbered(*columns: pa.Array) -> tuple[np.ndarray, list[Ragged]]:
    """Symbols by number, the blank being zero, and the columns of lists as numbers; null is empty."""
    flat = [c.flatten().cast(pa.string()) for c in columns]
    coded = pa.chunked_array(flat, pa.string()).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    number = np.arange(1, len(names) + 1)
    if BLANK in names:
        number[names.index(BLANK)] = 0
    codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
    table = np.array([BLANK, *names], object)
    out, at = [], 0
    for column, own in zip(columns, flat, strict=True):
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(Ragged(codes[at : at + len(own)], size))
        at += len(own)
    return table, out


def distinct(*columns: Ragged) -> tuple[list[Ragged], np.ndarray]:
    """The columns without repeated rows, and which of these each row is."""
    seen: dict[tuple[bytes, ...], int] = {}
    which = np.array([seen.setdefault(tuple(c.row(k).tobytes() for c in columns), len(seen)) for k in range(len(columns[0]))], np.int64)
    first = np.unique(which, return_index=True)[1]
    return [Ragged.of([c.row(k) for k in first]) for c in columns], which


#: Symbols of rows that are worked on together, whatever an Arrow batch holds.
_SYMBOLS = 1 << 18


def pieces(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of lists in rows of up to ``_SYMBOLS`` symbols, or a row, so that memory goes with these and not with a batch."""
    for columns in batches:
        size = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        whole, at = np.cumsum(size), 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + _SYMBOLS, side="right")))
            yield tuple(c.slice(at, end - at) for c in columns)
            at = end


#: What a step costs by itself, in cells.
_STEP = 8000


def _groups(a: np.ndarray, b: np.ndarray, room: Callable[[int, int, int], int]) -> Iterator[np.ndarray]:
    """Rows whose tables are made together: of like sizes, as far as padding costs less than steps of their own, and where
    ``room`` of their number and the largest sizes allows; or a row."""
    order = np.lexsort((a + b, np.log2(b + 8).astype(int), np.log2(a + 8).astype(int)))
    group: list[int] = []
    wide_a = wide_b = 0
    for k, n, m in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        to_a, to_b, count = max(wide_a, n), max(wide_b, m), len(group) + 1
        together = _STEP * (to_a + to_b) + count * to_a * to_b
        apart = _STEP * (wide_a + wide_b + n + m) + (count - 1) * wide_a * wide_b + n * m
        if group and (together > apart or room(count, to_a, to_b) > _CELLS):
            yield np.array(group)
            group, to_a, to_b = [], n, m
        group.append(k)
        wide_a, wide_b = to_a, to_b
    if group:
        yield np.array(group)


def _by_moves(n: int, wide_a: int, wide_b: int) -> int:
    """Two diagonals are held, and as many moves as there is room for."""
    return 256 * n * (wide_a + 1)


def _where(symbols: np.ndarray) -> dict[int, int]:
    """For each symbol the places where it stands, as bits of a number."""
    return {int(x): int.from_bytes(np.packbits(symbols == x, bitorder="little").tobytes(), "little") for x in np.unique(symbols)}


def _edit_steps(symbols: list[int], where: dict[int, int], full: int, up: int, down: int) -> Iterator[tuple[int, int, int, int]]:
    """A table of least edits, a line of it for each symbol as bits of four numbers, for the places of the other side: whether the step
    along the line rises or falls, whether the cell has a best path from the line before at the same place with an edit more, and whether
    it equals the one before on the diagonal (Hyyrö's bit-vectors)."""
    for x in symbols:
        same = where.get(x, 0)
        met = ((((same & up) + up) ^ up) | same | down) & full
        across = down | (full ^ (met | up))
        shifted = across << 1 | 1
        up, down = ((met & up) << 1 | full ^ ((met | shifted) & full)) & full, shifted & met
        yield up, down, across, met


def _steps_back(a: np.ndarray, b: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """The lines of a pair's table for the symbols of ``b``, over the places of ``a``, in stretches from the last one; of all others only
    the beginning is held meanwhile, so memory grows with the lengths."""
    symbols, where, full = b.tolist(), _where(a), (1 << len(a)) - 1
    height = max(1, 2 * _CELLS // (len(a) + 256))
    starts = [(full, 0)]
    for at in range(0, len(symbols), height):
        kept = []
        if at + height < len(symbols):
            for line in _edit_steps(symbols[at : at + height], where, full, *starts[-1]):
                pass
            starts.append(line[:2])
    for at in range((len(starts) - 1) * height, -1, -height):
        kept = list(_edit_steps(symbols[at : at + height], where, full, *starts.pop()))
        yield kept


def _moves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moves of ``align.align_pair``, walking back from the end: right first, then down."""
    i, out = len(a), bytearray()
    for lines in _steps_back(a, b):
        for up, _, across, _ in reversed(lines):
            while i and not across >> i - 1 & 1 and up >> i - 1 & 1:
                out.append(DOWN)
                i -= 1
            if not i or across >> i - 1 & 1:
                out.append(RIGHT)
            else:
                out.append(DIAGONAL)
                i -= 1
    out += bytes([DOWN]) * i
    return np.frombuffer(out, np.uint8)[::-1]


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``a`` the first and the last of ``b`` that a best path of the pair meets it at.  Best paths that cross share a
    place, so the outermost ones are found by taking the outermost move at each place."""
    low, high = np.full(len(a) + 1, len(b)), np.full(len(a) + 1, 0)
    left, right, j = len(a), len(a), len(b)
    high[right] = j
    x, y = a.tolist(), b.tolist()
    for lines in _steps_back(a, b):
        for up, _, across, met in reversed(lines):
            # to the right as far as can be: down, then the diagonal, then right
            while right and up >> right - 1 & 1:
                right -= 1
                high[right] = j
            if right and (x[right - 1] == y[j - 1] or not met >> right - 1 & 1):
                right -= 1
                high[right] = j - 1
            # to the left: right, then the diagonal, then down
            while left and not across >> left - 1 & 1 and x[left - 1] != y[j - 1] and met >> left - 1 & 1:
                low[left] = j
                left -= 1
            low[left] = j
            if left and not across >> left - 1 & 1:
                left -= 1
            j -= 1
            low[left] = j
    low[: left + 1] = 0
    return low, high


def pair_moves(a: Ragged, b: Ragged) -> list[np.ndarray]:
    """For each pair the moves of ``align.align_pair``: diagonal, down (a alone) or right (b alone)."""
    return [_moves(a.row(k), b.row(k)) for k in range(len(a))]


def _bits(lines: list[int], width: int) -> np.ndarray:
    size = (width + 7) // 8
    held = np.frombuffer(b"".join(x.to_bytes(size, "little") for x in lines), np.uint8).reshape(len(lines), size)
    return np.unpackbits(held, axis=1, count=width, bitorder="little")


def _table(a: np.ndarray, b: np.ndarray, agree: bool) -> np.ndarray:
    """Least edits of all beginnings of a pair; ``agree``: most agreements."""
    n, m = len(a), len(b)
    out = np.zeros((n + 1, m + 1), np.int16 if n + m < 30_000 else np.int32)
    where, full = _where(b), (1 << m) - 1
    if agree:
        still, lines = full, []
        for x in a.tolist():
            same = still & where.get(x, 0) if x else 0
            still = (still + same | still - same) & full
            lines.append(still)
        steps = 1 - _bits(lines, m)
    else:
        out[0], out[:, 0] = np.arange(m + 1), np.arange(n + 1)
        lines = list(_edit_steps(a.tolist(), where, full, full, 0))
        steps = (_bits([x[0] for x in lines], m) - _bits([x[1] for x in lines], m)).view(np.int8)
    np.cumsum(steps, axis=1, dtype=out.dtype, out=out[1:, 1:])
    if not agree:
        out[1:, 1:] += out[1:, :1]
    return out


def _best_places(a: np.ndarray, b: np.ndarray, agree: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A pair's table, and the places of it on a best path."""
    ahead, back = _table(a, b, agree), _table(a[::-1], b[::-1], agree)
    return ahead, ahead + back[::-1, ::-1] == ahead[-1, -1]


def _on_path(moves: np.ndarray, side: np.ndarray, skipped: int) -> np.ndarray:
    """The side's symbols along the moves, blank where the other stands alone."""
    out = np.zeros(len(moves), np.int64)
    out[moves != skipped] = side
    return out


def aligned_pairs(a: Ragged, b: Ragged) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(_on_path(m, a.row(k), RIGHT), _on_path(m, b.row(k), DOWN)) for k, m in enumerate(pair_moves(a, b))]


def edit_counts(hyp: Ragged, ref: Ragged) -> np.ndarray:
    """Rows of substitutions, insertions and deletions."""
    out = np.zeros((len(hyp), 3), np.int64)
    for k, moves in enumerate(pair_moves(ref, hyp)):
        r, h = _on_path(moves, ref.row(k), RIGHT), _on_path(moves, hyp.row(k), DOWN)
        insertion, deletion = r == 0, (r != 0) & (h == 0)
        out[k] = (~insertion & ~deletion & (r != h)).sum(), insertion.sum(), deletion.sum()
    return out


def _units(spans: list[int]) -> tuple[list[int], type]:
    """What one of each term counts if terms, the first the weightiest, are one number, and the type that holds it."""
    units = [1]
    for n in spans[:0:-1]:
        units.append(units[-1] * (n + 1))
    fits = units[-1] * (spans[0] + 1) < 1 << 62
    return units[::-1], np.int64 if fits else object


def _values(prompted: np.ndarray, uttered: np.ndarray, predicted: np.ndarray, units: list[int], kind: type) -> np.ndarray:
    """What rows of an alignment count behind the edits of prompt and uttered phones."""
    match, agree, far, length = units
    same = prompted == predicted
    return (~same).astype(kind) * far - (same & (predicted != 0)).astype(kind) * match - (uttered == predicted).astype(kind) * agree + length


def _band(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a prompt the first and last row of an alignment, of uttered phones, that it may meet.  As edits of prompted and
    uttered phones come first, these lie between the outermost of their best paths; rows without an uttered phone cost no edit."""
    if not p.all():
        return np.zeros(len(p) + 1, np.int64), np.full(len(p) + 1, len(u))
    low, high = _reach(p, u[u != 0])
    said = np.append(0, np.cumsum(u != 0))
    return np.searchsorted(said, low), np.searchsorted(said, high, side="right") - 1


def _place(p: np.ndarray, u: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A prompt placed on an aligned pair, as ``align.place_prompt`` does, within its band; all terms of a row are one number, and what a
    phone counts against all rows of the pair is worked out once for each distinct phone."""
    n, m = len(p), len(u)
    units, kind = _units([n + m, min(n, m), n + m, n + m, n + m])
    edit, *rest = units
    far = 1 << 62 if kind is not object else 1 << 200

    def value(phone: int, u: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (u != phone).astype(kind) * edit + _values(np.full(len(u), phone), u, h, rest, kind)

    nothing = np.zeros(1, np.int64)
    phones, which = np.unique(p, return_inverse=True)
    met = [value(x, u, h) for x in phones]
    above = [value(x, nothing, nothing)[0] for x in phones]
    reach = np.concatenate([np.zeros(1, kind), np.cumsum(value(0, u, h))])
    low, high = low.tolist(), high.tolist()
    which = which.tolist()
    table = [reach[: high[0] + 1]]
    for i, x in enumerate(which, 1):
        last, begin, end, before, ended = table[-1], low[i], high[i], low[i - 1], high[i - 1]
        row = np.full(end - begin + 1, far, kind)
        if begin <= ended:
            np.add(last[begin - before :], above[x], out=row[: ended - begin + 1])
        first, over = max(before, begin - 1), min(ended, end - 1)
        if first <= over:
            part = row[first + 1 - begin : over + 2 - begin]
            np.minimum(part, last[first - before : over + 1 - before] + met[x][first : over + 1], out=part)
        along = reach[begin : end + 1]
        table.append(np.minimum.accumulate(row - along) + along)
    moves, i, j = bytearray(), n, m
    while i or j:
        here = table[i][j - low[i]]
        if i and low[i - 1] < j <= high[i - 1] + 1 and table[i - 1][j - 1 - low[i - 1]] + met[which[i - 1]][j - 1] == here:
            moves.append(DIAGONAL)
        elif i and low[i - 1] <= j <= high[i - 1] and table[i - 1][j - low[i - 1]] + above[which[i - 1]] == here:
            moves.append(DOWN)
        else:
            moves.append(RIGHT)
        i, j = i - (moves[-1] != RIGHT), j - (moves[-1] != DOWN)
    path = np.frombuffer(moves, np.uint8)[::-1]
    return _on_path(path, p, RIGHT), _on_path(path, u, DOWN), _on_path(path, h, DOWN)


def _place_many(rows: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_place`` of several prompts: the places of all their bands by sums of indices, a sum at a time."""
    most = max(len(p) + len(u) for p, u, *_ in rows)
    units, kind = _units([most, max(min(len(p), len(u)) for p, u, *_ in rows), most, most, most])
    edit, *rest = units
    far = 1 << 62 if kind is not object else 1 << 200
    join = np.concatenate
    zero = np.zeros(1, np.int64)

    def value(*sides: np.ndarray) -> np.ndarray:
        p, u, h = np.broadcast_arrays(*sides)
        return (p != u).astype(kind) * edit + _values(p, u, h, rest, kind)

    # a line is a place of a prompt, with the places of its band side by side
    low, high = join([x[3] for x in rows]), join([x[4] for x in rows])
    size = high - low + 1
    base = np.cumsum(size) - size
    tall = np.array([len(x[0]) + 1 for x in rows])
    first = np.cumsum(tall) - tall
    i = np.arange(len(low)) - np.repeat(first, tall)
    line = np.repeat(np.arange(len(low)), size)
    r = np.arange(len(line)) - np.repeat(base - low, size)
    s = r + i[line]
    order = np.argsort(s.astype(np.int16 if most < 1 << 15 else np.int64), kind="stable")
    line, r, s = line[order], r[order], s[order]
    phone = join([np.append(0, x[0]) for x in rows])[line]
    wide = np.array([len(x[1]) + 1 for x in rows])
    at = np.repeat(np.cumsum(wide) - wide, tall)[line] + r
    u, h = (join([np.append(0, x[side]) for x in rows])[at] for side in (1, 2))
    # where moves come from, the last place for nowhere
    nowhere, above, starts = len(line), line - 1, i[line] == 0
    before, ended, offset = low[above], high[above], base[above] - low[above]
    origin = np.stack([
        np.where(starts | (r - 1 < before) | (r - 1 > ended), nowhere, offset + r - 1), np.where(starts | (r < before) | (r > ended), nowhere, offset + r),
        np.where(r == low[line], nowhere, base[line] + r - low[line] - 1),
    ])
    cost = np.stack([value(phone, u, h), value(phone, zero, zero), value(zero, u, h)])
    to = base[line] + r - low[line]
    values, taken = np.full(nowhere + 1, far, kind), np.zeros(nowhere, np.uint8)
    values[base[first]] = 0
    ends = np.searchsorted(s, np.arange(1, int(s[-1]) + 2)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        found = values[origin[:, a:b]] + cost[:, a:b]
        values[to[a:b]] = found.min(axis=0)
        taken[to[a:b]] = found.argmin(axis=0)
    out = []
    offset, moves = (base - low).tolist(), taken.tobytes()
    for (p, u, h, *_), top in zip(rows, first.tolist(), strict=True):
        path, i, j = bytearray(), len(p), len(u)
        while i or j:
            move = moves[offset[top + i] + j]
            path.append(move)
            i, j = i - (move != RIGHT), j - (move != DOWN)
        steps = np.frombuffer(path, np.uint8)[::-1]
        out.append((_on_path(steps, p, RIGHT), _on_path(steps, u, DOWN), _on_path(steps, h, DOWN)))
    return out


def strict(prompts: Ragged, uttered: Ragged, predicted: Ragged) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Uttered and predicted phones aligned, and the prompt placed on their rows."""
    out: list = [None] * len(prompts)
    waiting: list[tuple[int, tuple[np.ndarray, ...]]] = []
    held = 0

    def flush() -> None:
        for (k, _), found in zip(waiting, _place_many([w[1] for w in waiting]), strict=True):
            out[k] = found

    pairs = aligned_pairs(uttered, predicted)
    for k in np.argsort(prompts.size + np.array([len(x) for x, _ in pairs], np.int64), kind="stable").tolist():
        row = (prompts.row(k), *pairs[k])
        row += _band(*row[:2])
        places = int((row[4] - row[3] + 1).sum())
        if places > _LARGE:
            out[k] = _place(*row)
            continue
        if waiting and held + places > _LARGE:
            flush()
            waiting, held = [], 0
        waiting.append((k, row))
        held += places
    if waiting:
        flush()
    return out


# --- joint alignment


#: Moves in the order in which a walk through the cube meets their origins.
_MOVES = ((1, 1, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1))
#: How many of the three sides each of them leaves where it is.
_SKIPPED = tuple(3 - sum(m) for m in _MOVES)


class _Places:
    """The places of one joint alignment: where a place of prompt and uttered phones and one of uttered and predicted phones meet."""

    def __init__(self, p: np.ndarray, u: np.ndarray, h: np.ndarray, edits: np.ndarray, on_pu: np.ndarray, agreed: np.ndarray, on_uh: np.ndarray):
        self.p, self.u, self.h = p, u, h
        self.i, self.j = np.nonzero(on_pu)
        # what stands before a place and leads to it without leaving a best path, for (1, 1), (1, 0) and (0, 1); -1 for none
        number = np.full((len(p) + 2, len(u) + 2), -1, np.int32)
        number[self.i + 1, self.j + 1] = np.arange(len(self.i))
        steps = ((1, 1), (1, 0), (0, 1))
        self.before = [np.where(self._tight(edits, on_pu, p, u, *d, False)[self.i, self.j], number[self.i + 1 - d[0], self.j + 1 - d[1]], -1) for d in steps]
        # of uttered and predicted phones, bits: on a best path, a move that keeps it for each step, equal phones; above them the phone
        read = np.append(0, h)
        self.table = on_uh.astype(np.int32)
        for bit, d in enumerate(steps, 1):
            self.table |= self._tight(agreed, on_uh, u, h, *d, True).astype(np.int32) << bit
        self.table |= (np.append(0, u)[:, None] == read).astype(np.int32) << 4
        self.table |= (read << 5).astype(np.int32)
        first, last = on_uh.argmax(1), on_uh.shape[1] - 1 - on_uh[:, ::-1].argmax(1)
        self.low, self.high = (self.i + self.j + k[self.j] for k in (first, last))

    @property
    def size(self) -> int:
        """Numbers that are held."""
        return 16 * len(self.i) + self.table.size

    @staticmethod
    def _tight(table: np.ndarray, on: np.ndarray, x: np.ndarray, y: np.ndarray, dx: int, dy: int, agree: bool) -> np.ndarray:
        """The places that a move reaches from a place on a best path without leaving it."""
        out = np.zeros(on.shape, bool)
        n, m = on.shape
        if agree:
            gain = (x[:, None] == y) & (y != 0) if dx and dy else 0
        else:
            gain = x[:, None] != y if dx and dy else int(bool(dx or dy))
        out[dx:, dy:] = on[: n - dx, : m - dy] & on[dx:, dy:] & (table[: n - dx, : m - dy] + gain == table[dx:, dy:])
        return out


class _Walk:
    """Best paths over the places of several joint alignments, by sums of indices.

    A line is a place of prompt and uttered phones and all that the prediction has there; of a line one place at most has a given
    sum, and moves come from the last three sums, so values are held for four sums, by lines.  What moves count and where they come from
    is worked out for many places at once, so a sum is a few steps of numpy.  The moves are kept a byte each; where these would
    be too many, values at some sums are kept instead and the moves of a stretch are made again when the walk back comes to it."""

    def __init__(self, places: list[_Places]):
        self.places = places
        first = np.cumsum([0, *(len(x.i) for x in places)])
        join = np.concatenate
        self.n = int(first[-1])
        self.before = [join([np.where(x.before[d] < 0, self.n, x.before[d] + f) for x, f in zip(places, first.tolist(), strict=False)]).astype(np.int32) for d in range(3)]
        self.begin, self.end = first[:-1], (first[1:] - 1).tolist()
        self.last = [len(x.p) + len(x.u) + len(x.h) for x in places]
        self.i, self.j = join([x.i for x in places]), join([x.j for x in places])
        self.low, self.high = join([x.low for x in places]), join([x.high for x in places])
        total = max(self.last)
        changes = np.bincount(self.low, minlength=total + 2) - np.bincount(self.high + 1, minlength=total + 2)
        self.wide = np.cumsum(np.cumsum(changes))[: total + 1]  # lines that go through a sum or one before
        base = np.cumsum([0, *(x.table.size for x in places)])
        self.table = join([x.table.ravel() for x in places])
        self.at = join([f + x.j * x.table.shape[1] - x.i - x.j for x, f in zip(places, base.tolist(), strict=False)])
        # behind all terms the move, so that of equal ones the first is least
        units, kind = _units([min(max(len(x.p) for x in places), max(len(x.h) for x in places)), total, total, total, 7])
        self.match, self.agree, self.apart, self.length, _ = units
        self.kind, self.far = kind, 1 << 61 if kind is not object else 1 << 200
        prompted, uttered = (join([np.append(0, side)[index] for side, index in rows]) for rows in ([(x.p, x.i) for x in places], [(x.u, x.j) for x in places]))
        zero = np.zeros(1, np.int64)
        self.prompted = prompted
        values = lambda *rows: _values(*np.broadcast_arrays(*rows), units[:4], kind)
        self.alone = {1: values(prompted, uttered, zero) + 1, 3: values(prompted, zero, zero) + 3, 5: values(zero, uttered, zero) + 5}
        # what moves with a predicted phone count, by bits: those of a table, the phone is the prompted one, and blank
        match, agree, apart, length = units[:4]
        bits = np.arange(128)
        same, blank = (bits & 32) > 0, (bits & 64) > 0
        number = lambda x: np.asarray(x).astype(kind)
        barred = [number(np.where(bits & bit, 0, 1)) * self.far for bit in (2, 4, 8)]
        met = np.where(same, number(~blank) * -match, number(np.ones(128, int)) * apart)
        unmet = number(~blank) * apart
        agreed, silent = length - number((bits & 16) > 0) * agree, length - number(blank) * agree
        self.counts = {0: met + agreed + barred[0], 2: met + silent + 2 + barred[2], 4: unmet + agreed + 4 + barred[0], 6: unmet + silent + 6 + barred[2], 1: barred[1], 5: barred[1]}

    def _parts(self, low: int, high: int, most: int) -> list[int]:
        """Cuts of the sums from ``low`` to before ``high``, ``most`` lines through them or a single sum between two."""
        out = [low]
        while out[-1] < high:
            done = self.wide[out[-1] - 1] if out[-1] else 0
            out.append(min(high, max(out[-1] + 1, int(np.searchsorted(self.wide, done + most, side="right")))))
        return out

    def _places_of(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, sum and bits of the places with sums from ``low`` to before ``high``, in order of the sums."""
        lines = np.flatnonzero((self.low < high) & (self.high >= low)).astype(np.int32)
        begin = np.maximum(self.low[lines], low)
        size = np.minimum(self.high[lines], high - 1) - begin + 1
        x = np.repeat(lines, size)
        s = np.arange(len(x)) + np.repeat(begin - (np.cumsum(size) - size), size)
        told = self.table[self.at[x] + s]
        on = np.flatnonzero(told & 1)
        s = s[on]
        order = np.argsort((s - low).astype(np.int16 if high - low < 1 << 15 else np.int64), kind="stable")
        on = on[order]
        return x[on], s[order], told[on]

    def _moves_of(self, x: np.ndarray, s: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each move, by places, where among the values held it comes from and what it counts."""
        phone = told >> 5
        bits = told & 31 | (self.prompted[x] == phone).astype(np.int32) << 5 | (phone == 0).astype(np.int32) << 6
        cost, origin = np.empty((7, len(x)), self.kind), np.empty((7, len(x)), np.int32)
        for move, row in enumerate(cost):
            if move in (0, 2, 4, 6):
                np.take(self.counts[move], bits, out=row)
            else:
                np.take(self.alone[move], x, out=row)
        for move in (1, 5):
            cost[move] += self.counts[move][bits]
        s = s.astype(np.int32)
        held = np.int32(self.n + 1)
        rows = [None, *((s - np.int32(back) & np.int32(3)) * held for back in (1, 2, 3))]
        for d, pair in enumerate(((0, 1), (2, 3), (4, 5))):
            lines = self.before[d][x]
            for move in pair:
                np.add(lines, rows[3 - _SKIPPED[move]], out=origin[move])
        np.add(x, rows[1], out=origin[6])
        return origin, cost

    def _stretch(self, low: int, high: int, values: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The sums from ``low`` to before ``high``, behind those whose values are given: the values of the last four, and the moves by
        line and sum, with where those of a line begin."""
        size = np.maximum(np.minimum(self.high, high - 1) - np.maximum(self.low, low) + 1, 0) if keep else np.zeros(self.n, np.int64)
        first = np.cumsum(size) - size - np.maximum(self.low, low)
        kept = np.zeros(int(size.sum()), np.uint8)
        values = values.copy()
        cuts = self._parts(low, high, _BULK)
        for part, end in zip(cuts[:-1], cuts[1:], strict=True):
            x, s, told = self._places_of(part, end)
            origin, cost = self._moves_of(x, s, told)
            to = x + ((s % 4) * (self.n + 1))
            taken = np.zeros(len(x), np.uint8)
            ends = np.searchsorted(s, np.arange(part, end + 1)).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a < b:
                    found = values[origin[:, a:b]]
                    found += cost[:, a:b]
                    best = found.min(axis=0)
                    move = best & 7
                    values[to[a:b]] = best - move
                    taken[a:b] = move
            if keep:
                kept[first[x] + s] = taken
        return values, (kept, first)

    def paths(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        most = max(_CELLS, int(np.sqrt(32.0 * self.wide[-1] * (self.n + 1))))
        cuts = self._parts(1, len(self.wide), most)
        values = np.full(4 * (self.n + 1), self.far, self.kind)
        values[self.begin] = 0
        starts = [values]
        for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
            starts.append(self._stretch(low, high, starts[-1], keep=False)[0])
        taken: list[list[tuple[int, int, int]]] = [[] for _ in self.places]
        here = list(zip(self.end, self.last, strict=True))
        origin = [self.before[d] for d in (0, 0, 1, 1, 2, 2)]
        for low, high in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            kept, first = self._stretch(low, high, starts.pop(), keep=True)[1]
            for t, (line, s) in enumerate(here):
                while s >= low:
                    move = int(kept[first[line] + s])
                    taken[t].append((line, s, move))
                    line, s = line if move == 6 else int(origin[move][line]), s - 3 + _SKIPPED[move]
                here[t] = line, s
        return [self._sides(x, steps[::-1]) for x, steps in zip(self.places, taken, strict=True)]

    def _sides(self, x: _Places, steps: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line, s, move = np.array(steps, np.int64).reshape(-1, 3).T
        i, j = self.i[line], self.j[line]
        takes = np.array(_MOVES)[move]
        sides = []
        for d, (side, at) in enumerate(((x.p, i), (x.u, j), (x.h, s - i - j))):
            row = np.zeros(len(line), np.int64)
            used = takes[:, d] == 1
            row[used] = side[at[used] - 1]
            sides.append(row)
        return tuple(sides)


def joint(prompts: Ragged, uttered: Ragged, predicted: Ragged) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The alignments of ``align.align_joint``."""
    out: list = [None] * len(prompts)
    waiting: list[tuple[int, _Places]] = []
    held = 0

    def flush() -> None:
        for (k, _), found in zip(waiting, _Walk([w[1] for w in waiting]).paths(), strict=True):
            out[k] = found

    for k in np.argsort(prompts.size + uttered.size + predicted.size, kind="stable").tolist():
        sides = prompts.row(k), uttered.row(k), predicted.row(k)
        places = _Places(*sides, *_best_places(*sides[:2]), *_best_places(*sides[1:], agree=True))
        if waiting and held + places.size > _PLACES:
            flush()
            waiting, held = [], 0
        waiting.append((k, places))
        held += places.size
    if waiting:
        flush()
    return out


# --- slots


def _laid(moves: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each prompted phone its counterpart, blank for none; and the gaps and symbols of what is inserted."""
    before = np.cumsum(moves != RIGHT) - (moves != RIGHT)
    at = np.cumsum(moves != DOWN) - (moves != DOWN)
    phones = np.zeros(n, np.int64)
    pairs, inserted = moves == DIAGONAL, moves == RIGHT
    phones[before[pairs]] = other[at[pairs]]
    return phones, before[inserted], other[at[inserted]]


def _places_in(gaps: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each gap; gaps come sorted."""
    at = np.arange(len(gaps))
    return at - np.searchsorted(gaps, gaps)


def slot_table(prompts: Ragged, uttered: Ragged, predicted: Ragged) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``align.slot_rows`` of all triples, one below the other, as (slot, whether a phone, place in the gap, prompted,
    uttered, predicted), and how many each triple has."""
    sides = [pair_moves(prompts, other) for other in (uttered, predicted)]
    laid = [[_laid(side[k], other.row(k), int(prompts.size[k])) for k in range(len(prompts))] for side, other in zip(sides, (uttered, predicted), strict=True)]
    met = [np.intersect1d(u[1], h[1]) for u, h in zip(*laid, strict=True)]
    inserted = [[side[k][2][side[k][1] == gap] for k, gaps in enumerate(met) for gap in gaps] for side in laid]
    settled = iter(aligned_pairs(Ragged.of(inserted[0]), Ragged.of(inserted[1])))
    out = []
    for k, gaps in enumerate(met):
        n = int(prompts.size[k])
        zero = lambda m: np.zeros(m, np.int64)
        (u_phones, u_gaps, u_own), (h_phones, h_gaps, h_own) = laid[0][k], laid[1][k]
        parts = [np.stack([np.arange(n), np.ones(n, np.int64), zero(n), prompts.row(k), u_phones, h_phones])]
        for where, own, first in ((u_gaps, u_own, True), (h_gaps, h_own, False)):
            alone = ~np.isin(where, gaps)
            m = int(alone.sum())
            symbols = [own[alone], zero(m)]
            parts.append(np.stack([where[alone], zero(m), _places_in(where[alone]), zero(m), *(symbols if first else symbols[::-1])]))
        for gap in gaps:
            u, h = next(settled)
            parts.append(np.stack([np.full(len(u), gap), zero(len(u)), np.arange(len(u)), zero(len(u)), u, h]))
        rows = np.concatenate(parts, axis=1)
        out.append(rows[:, np.lexsort((rows[2], rows[1], rows[0]))])
    return np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64), np.array([x.shape[1] for x in out], np.int64)


def weighted_distances(a: Ragged, b: Ragged, cost: np.ndarray, gap: float) -> np.ndarray:
    """The least costs of turning rows of ``a`` into rows of ``b``; ``cost`` is of pairs of symbols."""
    out = np.zeros(len(a))
    for rows in _groups(a.size, b.size, _by_moves):
        x, back = a.padded(rows, 0).T, np.ascontiguousarray(b.padded(rows, 0)[:, ::-1].T)
        n, m = len(x), len(back)
        scaled = np.ascontiguousarray(x) * cost.shape[1]
        flat = np.ascontiguousarray(cost).ravel()
        before, row = np.full((n + 1, len(rows)), np.inf), np.full((n + 1, len(rows)), np.inf)
        row[0] = 0
        last, every = a.size[rows] + b.size[rows], np.arange(len(rows))
        for k in range(n + m + 1):
            done = last == k
            if done.any():
                out[rows[done]] = row[a.size[rows][done], every[done]]
            low, high, ended = max(0, k + 1 - m), min(k + 1, n), min(k, n)
            begin = max(low, 1)
            new = np.full_like(row, np.inf)
            new[low : ended + 1] = row[low : ended + 1] + gap
            np.minimum(new[begin : high + 1], row[begin - 1 : high] + gap, out=new[begin : high + 1])
            pairs = scaled[begin - 1 : ended] + back[m - k - 1 + begin : m - k + ended]
            np.minimum(new[begin : ended + 1], before[begin - 1 : ended] + flat[pairs], out=new[begin : ended + 1])
            before, row = row, new
    return out
