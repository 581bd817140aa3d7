"""Alignment of phone sequences.

Rows are aligned in Arrow batches, without a shuffle: the columns' functions at the end go by ``align_batch``, which aligns many
rows at once.  The functions on single rows say what an alignment is, a table or a grid at a time.  Edit distances that need
no path are Spark's own levenshtein over one letter a phone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import align_batch

BLANK = "-"
Row = tuple[str, str, str]


#: From so many symbols on, a row of a table is one step of numpy.
_WIDE = 24


def edit_table(a: Sequence[str], b: Sequence[str], same: Callable[[int, int], bool] | None = None) -> list[list[int]]:
    """Unit-cost edit distances of all prefixes."""
    if len(b) >= _WIDE:
        if same:
            unequal = np.array([[not same(i, j) for j in range(len(b))] for i in range(len(a))], bool).reshape(len(a), len(b))
        else:
            x, y = _codes(a, b)
            unequal = x[:, None] != y[None, :]
        steps = np.arange(len(b) + 1)
        rows = [steps]
        for i in range(len(a)):
            t = rows[-1] + 1
            t[1:] = np.minimum(t[1:], rows[-1][:-1] + unequal[i])
            rows.append(np.minimum.accumulate(t - steps) + steps)  # insertions, each a step to the right
        return [r.tolist() for r in rows]
    same = same or (lambda i, j: a[i] == b[j])
    table = [list(range(len(b) + 1))]
    for i in range(len(a)):
        above, row = table[-1], [i + 1]
        for j in range(len(b)):
            row.append(min(above[j] + (not same(i, j)), above[j + 1] + 1, row[j] + 1))
        table.append(row)
    return table


def _codes(*sides: Sequence[str]) -> list[np.ndarray]:
    """Numbers for symbols; the blank is zero."""
    known = {BLANK: 0}
    return [np.array([known.setdefault(s, len(known)) for s in side], np.int64) for side in sides]


def _units(most: Sequence[int]) -> list[int]:
    """What one of each term counts if terms, the first the weightiest, are packed in one number: sums of them compare as the
    sums of the terms do, one after the other, where the sum of a term spans no more than ``most``."""
    units = [1]
    for n in most[:0:-1]:
        units.append(units[-1] * (n + 1))
    return units[::-1]


def _fits(most: Sequence[int]) -> bool:
    return _units([*most])[0] * (most[0] + 1) < 1 << 62


def _packed(terms: Sequence[np.ndarray | int], units: Sequence[int]) -> np.ndarray:
    return sum(np.asarray(t, np.int64) * np.int64(u) for t, u in zip(terms, units, strict=True))


def align_pair(a: Sequence[str], b: Sequence[str], blank: str = BLANK) -> list[tuple[str, str]]:
    """One best alignment: walking back from the end, a tie goes to an insertion, then a deletion, then the diagonal."""
    table, i, j, out = edit_table(a, b), len(a), len(b), []
    while i or j:
        here = table[i][j]
        if j and table[i][j - 1] + 1 == here:
            j -= 1
            out.append((blank, b[j]))
        elif i and table[i - 1][j] + 1 == here:
            i -= 1
            out.append((a[i], blank))
        else:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
    return out[::-1]


def edit_counts(hyp: Sequence[str], ref: Sequence[str]) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions that turn ``ref`` into ``hyp`` along the chosen alignment."""
    sub = ins = dele = 0
    for r, h in align_pair(ref, hyp):
        if r == BLANK:
            ins += 1
        elif h == BLANK:
            dele += 1
        elif r != h:
            sub += 1
    return sub, ins, dele


def bucket(prompted: str, uttered: str, predicted: str) -> str:
    """TA, FR, FA, CD or DE, by who agrees with the prompt and with whom."""
    if uttered == prompted:
        return "TA" if predicted == prompted else "FR"
    if predicted == prompted:
        return "FA"
    return "CD" if uttered == predicted else "DE"


def _best_path(sizes: tuple[int, ...], moves: list[tuple[int, ...]], value: Callable[[tuple[int, ...], tuple[int, ...]], tuple[int, ...]], terms: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """The (place, move) steps of the lexicographically least path through a grid; of equal paths to a place the one
    found first stays, places being visited in order and moves as listed."""
    start = (0,) * len(sizes)
    best: dict[tuple[int, ...], tuple[tuple[int, ...], tuple | None]] = {start: ((0,) * terms, None)}
    for at in product(*(range(n + 1) for n in sizes)):
        score = best[at][0]
        for move in moves:
            to = tuple(x + m for x, m in zip(at, move, strict=True))
            if any(x > n for x, n in zip(to, sizes, strict=True)):
                continue
            total = tuple(map(sum, zip(score, value(at, move), strict=True)))
            if to not in best or total < best[to][0]:
                best[to] = (total, (at, move))
    steps, at = [], tuple(sizes)
    while best[at][1] is not None:
        steps.append(best[at][1])
        at = best[at][1][0]
    return steps[::-1]


def place_prompt(prompted: Sequence[str], rows: Sequence[tuple[str, str]]) -> list[Row]:
    """The canonical sequence placed on an alignment of uttered and predicted phones.

    Terms, in order: edits against the uttered phones, exact matches with the predicted ones, rows that are TA or CD,
    edits against the predicted ones, length.
    """

    if len(rows) >= _WIDE and _fits(_place_spans(len(prompted), len(rows))):
        return _place_wide(prompted, rows)

    def symbols(at: tuple[int, ...], move: tuple[int, ...]) -> Row:
        u, h = rows[at[1]] if move[1] else (BLANK, BLANK)
        return (prompted[at[0]] if move[0] else BLANK, u, h)

    def value(at: tuple[int, ...], move: tuple[int, ...]) -> tuple[int, ...]:
        p, u, h = symbols(at, move)
        return (int(p != u), -int(p == h != BLANK), -int(bucket(p, u, h) in ("TA", "CD")), int(p != h), 1)

    steps = _best_path((len(prompted), len(rows)), [(1, 1), (0, 1), (1, 0)], value, 5)
    return [symbols(*s) for s in steps]


def _place_spans(n: int, m: int) -> list[int]:
    return [n + m, min(n, m), n + m, n + m, n + m]


def _place_wide(prompted: Sequence[str], rows: Sequence[tuple[str, str]]) -> list[Row]:
    """``place_prompt``, a row of the grid at a time."""
    p, u, h = _codes(prompted, [r[0] for r in rows], [r[1] for r in rows])
    units = _units(_place_spans(len(prompted), len(rows)))

    def value(p: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
        return _packed((p != u, -((p == h) & (h != 0)).astype(np.int64), -np.asarray(u == h).astype(np.int64), p != h, 1), units)

    both = value(p[:, None], u[None, :], h[None, :])
    right, down = value(np.int64(0), u, h), value(p, np.int64(0), np.int64(0))
    reach = np.concatenate([[0], np.cumsum(right)])
    best = [reach]
    for i in range(len(prompted)):
        t = best[-1] + down[i]
        t[1:] = np.minimum(t[1:], best[-1][:-1] + both[i])
        best.append(np.minimum.accumulate(t - reach) + reach)
    out, i, j = [], len(prompted), len(rows)
    while i or j:
        here = best[i][j]
        if i and j and best[i - 1][j - 1] + both[i - 1, j - 1] == here:
            i, j = i - 1, j - 1
            out.append((prompted[i], *rows[j]))
        elif i and best[i - 1][j] + down[i - 1] == here:
            i -= 1
            out.append((prompted[i], BLANK, BLANK))
        else:
            j -= 1
            out.append((BLANK, *rows[j]))
    return out[::-1]


def align_strict(prompted: Sequence[str], uttered: Sequence[str], predicted: Sequence[str]) -> list[Row]:
    """Uttered and predicted are aligned first, then the prompt is placed on their rows."""
    return place_prompt(prompted, align_pair(uttered, predicted))


def align_joint(prompted: Sequence[str], uttered: Sequence[str], predicted: Sequence[str]) -> list[Row]:
    """All three at once; cubic in the length.

    Terms, in order: edits of prompt and uttered, agreement of uttered and predicted, exact matches of prompt and
    predicted, rows that are TA or CD, edits of prompt and predicted, length, rows without a prompt.
    """
    sides = (prompted, uttered, predicted)
    if _fits([sum(map(len, sides))] * 7):
        return _joint_packed(*sides)

    def symbols(at: tuple[int, ...], move: tuple[int, ...]) -> Row:
        return tuple(s[i] if m else BLANK for s, i, m in zip(sides, at, move, strict=True))

    def value(at: tuple[int, ...], move: tuple[int, ...]) -> tuple[int, ...]:
        p, u, h = symbols(at, move)
        return (int(p != u), -int(u == h != BLANK), -int(p == h != BLANK), -int(bucket(p, u, h) in ("TA", "CD")), int(p != h), 1, 1 - move[0])

    moves = [(1, 1, 1), (0, 1, 1), (0, 0, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, 0)]
    return [symbols(*s) for s in _best_path(tuple(map(len, sides)), moves, value, 7)]


def _joint_packed(prompted: Sequence[str], uttered: Sequence[str], predicted: Sequence[str]) -> list[Row]:
    """``align_joint``, a line of the grid along the predicted phones at a time."""
    p, u, h = _codes(prompted, uttered, predicted)
    units = _units([len(p) + len(u) + len(h)] * 7)

    def value(p: np.ndarray, u: np.ndarray, h: np.ndarray, prompt: bool) -> np.ndarray:
        matches = (-((u == h) & (h != 0)).astype(np.int64), -((p == h) & (h != 0)).astype(np.int64), -np.asarray(u == h).astype(np.int64))
        return _packed((p != u, *matches, p != h, 1, int(not prompt)), units)

    none, far = np.int64(0), np.int64(2**62)
    right = value(none, none, h, False)
    reach = np.concatenate([[0], np.cumsum(right)])
    ph, uh = value(p[:, None], none, h[None, :], True), value(none, u[:, None], h[None, :], False)
    pu, only_p, only_u = value(p[:, None], u[None, :], none, True), value(p, none, none, True), value(none, u, none, False)
    all_ = value(p[:, None, None], u[None, :, None], h[None, None, :], True)
    best: list[list[np.ndarray]] = []
    for i in range(len(p) + 1):
        best.append([])
        for j in range(len(u) + 1):
            t = np.full(len(h) + 1, far)
            if not i and not j:
                t[0] = 0
            if i and j:
                t = np.minimum(t, best[i - 1][j - 1] + pu[i - 1, j - 1])
                t[1:] = np.minimum(t[1:], best[i - 1][j - 1][:-1] + all_[i - 1, j - 1])
            if i:
                t = np.minimum(t, best[i - 1][j] + only_p[i - 1])
                t[1:] = np.minimum(t[1:], best[i - 1][j][:-1] + ph[i - 1])
            if j:
                t = np.minimum(t, best[i][j - 1] + only_u[j - 1])
                t[1:] = np.minimum(t[1:], best[i][j - 1][:-1] + uh[j - 1])
            best[i].append(np.minimum.accumulate(t - reach) + reach)
    out, (i, j, k) = [], map(len, (p, u, h))
    while i or j or k:
        here = best[i][j][k]
        # predecessors in the order in which the grid is walked; the first that explains the score
        for di, dj, dk in ((1, 1, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1)):
            if di > i or dj > j or dk > k:
                continue
            x, y, z = (p[i - 1] if di else none), (u[j - 1] if dj else none), (h[k - 1] if dk else none)
            if best[i - di][j - dj][k - dk] + value(x, y, z, bool(di)) == here:
                break
        out.append((prompted[i - 1] if di else BLANK, uttered[j - 1] if dj else BLANK, predicted[k - 1] if dk else BLANK))
        i, j, k = i - di, j - dj, k - dk
    return out[::-1]


def slots(prompted: Sequence[str], other: Sequence[str]) -> tuple[list[str], list[list[str]]]:
    """For each prompted phone its counterpart, and the insertions before, between and behind them."""
    phones, gaps = [], [[]]
    for p, o in align_pair(prompted, other):
        if p == BLANK:
            gaps[-1].append(o)
        else:
            phones.append(o)
            gaps.append([])
    return phones, gaps


def slot_rows(prompted: Sequence[str], uttered: Sequence[str], predicted: Sequence[str]) -> list[tuple[str, int, int | None, str, str, str]]:
    """(slot type, slot, place in the gap, prompted, uttered, predicted); a gap's rows come before its phone's."""
    (u_phones, u_gaps), (h_phones, h_gaps) = slots(prompted, uttered), slots(prompted, predicted)
    out: list[tuple[str, int, int | None, str, str, str]] = []
    for k in range(len(prompted) + 1):
        out += [("gap", k, g, BLANK, u, h) for g, (u, h) in enumerate(align_pair(u_gaps[k], h_gaps[k]))]
        if k < len(prompted):
            out.append(("phone", k, None, prompted[k], u_phones[k], h_phones[k]))
    return out


def flap_phones(canonical: Sequence[str], phones: Sequence[str], is_flap: Sequence[bool]) -> list[str]:
    """``phones`` with each flap as the t or d that it is aligned with, else t.  Of equal costs a match wins, then a
    deletion, then an insertion, then a substitution; a flap matches t and d."""
    if not any(is_flap):
        return list(phones)

    def same(i: int, j: int) -> bool:
        return canonical[i] == phones[j] or (is_flap[j] and canonical[i] in ("t", "d"))

    table, i, j = edit_table(canonical, phones, same), len(canonical), len(phones)
    context: list[str | None] = [None] * len(phones)
    while i or j:
        here = table[i][j]
        match = bool(i and j) and same(i - 1, j - 1)
        if match and table[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
            context[j] = canonical[i]
        elif i and table[i - 1][j] + 1 == here:
            i -= 1
        elif j and table[i][j - 1] + 1 == here:
            j -= 1
        else:
            i, j = i - 1, j - 1
            context[j] = canonical[i]
    return [(c if c in ("t", "d") else "t") if f else p for p, f, c in zip(phones, is_flap, context, strict=True)]



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
MDD_TYPE = _struct(
    **dict.fromkeys(("TR", "TA", "FR", "FA", "CD", "DE"), _LONG), **dict.fromkeys(("corr_U", "corr_P", "prompted", "uttered", "predicted"), _TEXT)
)
SLOT_TYPE = T.ArrayType(_struct(slot_type=_TEXT, slot_index=_INT, gap_pos=_INT, prompted=_TEXT, uttered=_TEXT, predicted=_TEXT))


def _marks(same: np.ndarray) -> str:
    """``C`` and ``E`` with spaces between them."""
    out = np.full(max(0, 2 * len(same) - 1), ord(" "), np.uint8)
    out[::2] = np.where(same, ord("C"), ord("E"))
    return out.tobytes().decode()


def _summary(names: np.ndarray, p: np.ndarray, u: np.ndarray, h: np.ndarray) -> dict:
    """Counts and texts of the rows of an alignment, whose symbols are numbers of ``names``."""
    as_said, as_read, agree = u == p, h == p, u == h
    cd, de = int((~as_said & ~as_read & agree).sum()), int((~as_said & ~as_read & ~agree).sum())
    return {
        "TR": cd + de, "TA": int((as_said & as_read).sum()), "FR": int((as_said & ~as_read).sum()), "FA": int((~as_said & as_read).sum()), "CD": cd, "DE": de,
        "corr_U": _marks(as_said), "corr_P": _marks(as_read), "prompted": " ".join(names[p]), "uttered": " ".join(names[u]), "predicted": " ".join(names[h]),
    }


_MDD = pa.struct([*((k, pa.int64()) for k in ("TR", "TA", "FR", "FA", "CD", "DE")), *((k, pa.string()) for k in ("corr_U", "corr_P", "prompted", "uttered", "predicted"))])


_PAIRS, _TRIPLES = Iterator[tuple[pa.Array, pa.Array]], Iterator[tuple[pa.Array, pa.Array, pa.Array]]


def _triple_udf(align: Callable[..., list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> Callable[..., Column]:
    """Of (canonical, uttered, predicted) phones; equal triples of a piece are aligned once."""

    def run(batches: _TRIPLES) -> Iterator[pa.Array]:
        for piece in align_batch.pieces(batches):
            names, columns = align_batch.numbered(*piece)
            few, which = align_batch.distinct(*columns)
            found = pa.array([_summary(names, *rows) for rows in align(*few)], _MDD)
            yield found.take(pa.array(which))

    run.__annotations__ = {"batches": _TRIPLES, "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MDD_TYPE)


strict_mdd = _triple_udf(align_batch.strict)
joint_mdd = _triple_udf(align_batch.joint)


def _sub_ins_del(batches: _PAIRS) -> Iterator[pa.Array]:
    """Edit counts of (hyp, ref)."""
    for piece in align_batch.pieces(batches):
        _, columns = align_batch.numbered(*piece)
        few, which = align_batch.distinct(*columns)
        counts = align_batch.edit_counts(*few)[which].reshape(-1, 3)
        yield pa.StructArray.from_arrays([pa.array(counts[:, k]) for k in range(3)], names=["sub", "ins", "del"])


def _slot_table(batches: _TRIPLES) -> Iterator[pa.Array]:
    """The rows of ``slot_rows`` of (canonical, uttered, predicted) phones."""
    for piece in align_batch.pieces(batches):
        names, columns = align_batch.numbered(*piece)
        rows, size = align_batch.slot_table(*columns)
        slot, is_phone, place, *symbols = rows
        shown = pa.array(names, pa.string())
        fields = [
            pa.array(["gap", "phone"]).take(pa.array(is_phone)), pa.array(slot, pa.int32()), pa.array(place, pa.int32(), mask=is_phone == 1), *(shown.take(pa.array(s)) for s in symbols)
        ]
        made = pa.StructArray.from_arrays(fields, names=["slot_type", "slot_index", "gap_pos", "prompted", "uttered", "predicted"])
        yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), made)


_sub_ins_del.__annotations__ = {"batches": _PAIRS, "return": Iterator[pa.Array]}
_slot_table.__annotations__ = {"batches": _TRIPLES, "return": Iterator[pa.Array]}
sub_ins_del = F.arrow_udf(_sub_ins_del, _struct(**{"sub": _LONG, "ins": _LONG, "del": _LONG}))
slot_table = F.arrow_udf(_slot_table, SLOT_TYPE)


@F.pandas_udf(T.ArrayType(_TEXT))
def resolve_flaps(c: pd.Series, p: pd.Series, f: pd.Series) -> pd.Series:
    """Of (canonical, phones, is_flap); null phones stay null, so rows without flaps cost nothing."""
    return pd.Series([None if y is None else flap_phones(list(x), list(y), list(z)) for x, y, z in zip(c, p, f, strict=True)], dtype=object)
