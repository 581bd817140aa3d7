from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.operators import align

# canonical, uttered, predicted, (TA, FR, FA, CD, DE), corr_U, corr_P
STRICT = [
    ("abcd", "acd", "axcdy", (3, 2, 0, 1, 0), "CCECCC", "CEECCE"),
    ("abcd", "abxde", "abd", (3, 0, 1, 0, 1), "CCECE", "CCECC"),
    ("ab", "axb", "axb", (2, 0, 0, 1, 0), "CEC", "CEC"),
    ("ab", "axb", "ayb", (2, 0, 0, 0, 1), "CEC", "CEC"),
    ("abc", "axbc", "abyc", (3, 1, 1, 0, 0), "CECCC", "CCCEC"),
    ("abc", "ac", "ac", (2, 0, 0, 1, 0), "CEC", "CEC"),
    ("", "a", "ab", (0, 1, 0, 1, 0), "EC", "EE"),
]


def counts(rows):
    found = [align.bucket(*r) for r in rows]
    return tuple(found.count(k) for k in ("TA", "FR", "FA", "CD", "DE"))


@pytest.mark.parametrize("c,u,h,expected,corr_u,corr_p", STRICT)
def test_strict_goldens(c, u, h, expected, corr_u, corr_p):
    rows = align.align_strict(list(c), list(u), list(h))
    assert counts(rows) == expected
    assert "".join("C" if p == x else "E" for p, x, _ in rows) == corr_u
    assert "".join("C" if p == x else "E" for p, _, x in rows) == corr_p


def test_mixed_summary():
    total = [0] * 5
    for c, u, h, *_ in (STRICT[0], STRICT[1], ("ab", "axb", "axb")):
        for i, n in enumerate(counts(align.align_strict(list(c), list(u), list(h)))):
            total[i] += n
    assert total == [8, 2, 1, 2, 1]


def test_joint_golden():
    rows = align.align_joint("p ɛ ŋ ɡ w ɪ n".split(), "p ɪ m w ɪ n".split(), "p ɹ ɪ m w ɪ n".split())
    assert counts(rows) == (4, 1, 0, 3, 0)
    assert [" ".join(r[i] for r in rows) for i in range(3)] == ["p - ɛ ŋ ɡ w ɪ n", "p - - ɪ m w ɪ n", "p ɹ - ɪ m w ɪ n"]
    assert counts(align.align_joint(["s"], [], ["s"])) == (0, 0, 1, 0, 0)
    assert counts(align.align_joint(["a", "b"], ["a"], ["a", "b"])) == (1, 0, 1, 0, 0)


word = st.lists(st.sampled_from("abc"), max_size=5)


@settings(max_examples=150, deadline=None)
@given(word, word, word)
def test_alignments_keep_their_sequences_and_the_best_cost(c, u, h):
    for rows in (align.align_strict(c, u, h), align.align_joint(c, u, h)):
        for side, own in zip((c, u, h), zip(*rows) if rows else ((), (), ()), strict=True):
            assert [x for x in own if x != "-"] == side
        assert sum(counts(rows)) == len(rows)
    joint = align.align_joint(c, u, h)
    assert sum(p != x for p, x, _ in joint) == align.edit_table(c, u)[-1][-1]


@settings(max_examples=150, deadline=None)
@given(word, word)
def test_edit_counts_add_up(hyp, ref):
    sub, ins, dele = align.edit_counts(hyp, ref)
    assert sub + ins + dele == align.edit_table(ref, hyp)[-1][-1]
    assert ins - dele == len(hyp) - len(ref)


@settings(max_examples=100, deadline=None)
@given(word, word, word)
def test_slots_hold_everything(c, u, h):
    rows = align.slot_rows(c, u, h)
    assert [r[3] for r in rows if r[0] == "phone"] == c
    assert sorted(r[4] for r in rows if r[4] != "-") == sorted(u)
    assert sorted(r[5] for r in rows if r[5] != "-") == sorted(h)


def test_flaps_take_their_phone_from_the_context():
    assert align.flap_phones(["t", "d", "k"], ["t", "t", "t"], [True] * 3) == ["t", "d", "t"]
    assert align.flap_phones(["d"], ["t"], [True]) == ["d"]
    assert align.flap_phones([], ["t"], [True]) == ["t"]


def test_udfs(spark):
    df = spark.createDataFrame([(list(c), list(u), list(h)) for c, u, h, *_ in STRICT[:6]], "c array<string>, u array<string>, h array<string>")
    out = df.select(align.strict_mdd("c", "u", "h").alias("m"), align.sub_ins_del("h", "u").alias("e"), F.size(align.slot_table("c", "u", "h")).alias("n")).collect()
    assert [(r.m.TA, r.m.FR, r.m.FA, r.m.CD, r.m.DE) for r in out] == [x[3] for x in STRICT[:6]]
    assert all(r.m.TR == r.m.CD + r.m.DE for r in out)
    assert all(r.n >= len(x[0]) for r, x in zip(out, STRICT, strict=False))


def by_the_grid(monkeypatch, call):
    """The result of the plain walk through the grid, symbol by symbol."""
    with monkeypatch.context() as m:
        m.setattr(align, "_WIDE", 10**9)
        m.setattr(align, "_joint_packed", lambda *sides: slow_joint(*sides))
        return call()


def slow_joint(*sides):
    def symbols(at, move):
        return tuple(s[i] if m else align.BLANK for s, i, m in zip(sides, at, move, strict=True))

    def value(at, move):
        p, u, h = symbols(at, move)
        blank = align.BLANK
        return (int(p != u), -int(u == h != blank), -int(p == h != blank), -int(align.bucket(p, u, h) in ("TA", "CD")), int(p != h), 1, 1 - move[0])

    moves = [(1, 1, 1), (0, 1, 1), (0, 0, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, 0)]
    return [symbols(*s) for s in align._best_path(tuple(map(len, sides)), moves, value, 7)]


@pytest.mark.parametrize("seed", range(60))
def test_rows_at_a_time_give_the_same_paths(seed, monkeypatch):
    r = random.Random(seed)
    text = lambda most: [r.choice("abc" if seed % 2 else "abcdefgh") for _ in range(r.randint(0, most))]
    a, b, c = text(60), text(60), text(60)
    monkeypatch.setattr(align, "_WIDE", 1)
    wide = (align.edit_table(a, b), align.align_pair(a, b), align.align_strict(a, b, c), align.flap_phones(a, b, [x == "b" for x in b]))
    short = text(7), text(7), text(7)
    joint = align.align_joint(*short)
    plain = by_the_grid(monkeypatch, lambda: (align.edit_table(a, b), align.align_pair(a, b), align.align_strict(a, b, c), align.flap_phones(a, b, [x == "b" for x in b])))
    assert wide == plain
    assert joint == slow_joint(*short)


def test_feature_distance_by_cells():
    from phonolake.operators import features

    def slow(a, b, gap=1.0):
        row = [gap * j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            above, row = row, [gap * i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j - 1] + features.hamming(x, y), above[j] + gap, row[j - 1] + gap))
        return row[-1]

    r = random.Random(3)
    symbols = [*list(features.VECTORS)[:12], "Q", "?", "!"]
    for _ in range(60):
        a, b = ([r.choice(symbols) for _ in range(r.randint(0, 20))] for _ in range(2))
        assert features.feature_distance(a, b) == pytest.approx(slow(a, b), abs=1e-9)
