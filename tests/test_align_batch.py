"""Alignment of many rows at once gives what the functions on single rows give."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.operators import align, align_batch, features

PHONES = "p b t d k ɡ s z".split()
SEQ = st.lists(st.sampled_from(PHONES[:4]), max_size=9)


def columns(rows):
    return align_batch.numbered(*[pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in range(len(rows[0]))])


def shown(names, sides):
    return list(zip(*[names[s].tolist() for s in sides], strict=True))


@pytest.fixture(params=["one group", "many stretches"])
def room(request, monkeypatch):
    if request.param != "one group":
        monkeypatch.setattr(align_batch, "_CELLS", 300)
        monkeypatch.setattr(align_batch, "_PLACES", 200)


def test_rows_of_many_lengths(room):
    r = random.Random(1)
    rows = [tuple([r.choice("abcde") for _ in range(r.randint(0, 7 if k % 5 else 40))] for _ in range(3)) for k in range(150)] + [([], [], [])]
    names, (c, u, h) = columns(rows)
    assert [shown(names, x) for x in align_batch.aligned_pairs(u, h)] == [align.align_pair(y, z) for _, y, z in rows]
    assert [tuple(x) for x in align_batch.edit_counts(h, u)] == [align.edit_counts(z, y) for _, y, z in rows]
    assert [shown(names, x) for x in align_batch.strict(c, u, h)] == [align.align_strict(*x) for x in rows]
    assert [shown(names, x) for x in align_batch.joint(c, u, h)] == [align.align_joint(*x) for x in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SEQ, SEQ, SEQ), min_size=1, max_size=6))
def test_joint_and_slots(rows):
    names, (c, u, h) = columns(rows)
    assert [shown(names, x) for x in align_batch.joint(c, u, h)] == [align.align_joint(*x) for x in rows]
    table, size = align_batch.slot_table(c, u, h)
    at = 0
    for x, n in zip(rows, size, strict=True):
        slot, phone, place, *symbols = table[:, at : at + n]
        got = [("phone" if f else "gap", int(s), None if f else int(g), *own) for s, f, g, own in zip(slot, phone, place, shown(names, symbols), strict=True)]
        assert got == align.slot_rows(*x)
        at += n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([*PHONES, "?", "!"]), max_size=30), SEQ), min_size=1, max_size=6))
def test_feature_distances(rows):
    names, (a, b) = columns(rows)
    known = np.array([features._PHONES.get(p, len(features._PHONES)) for p in names])
    cost = np.where(np.eye(len(names), dtype=bool), 0.0, features._COST[known[:, None], known])
    got = align_batch.weighted_distances(a, b, cost, 1.0)
    assert got.tolist() == pytest.approx([features.feature_distance(x, y) for x, y in rows], abs=1e-9)


def test_long_rows_of_the_joint_alignment():
    """Places that are visited, not the cube: three sequences of 300 phones."""
    r = random.Random(4)
    base = [r.choice(PHONES) for _ in range(300)]
    near = lambda: [p if r.random() < 0.9 else r.choice(PHONES) for p in base if r.random() < 0.95]
    rows = [(base, near(), near())]
    names, cols = columns(rows)
    found = shown(names, align_batch.joint(*cols)[0])
    assert [[x for x in side if x != "-"] for side in zip(*found, strict=True)] == [list(x) for x in rows[0]]
    edits = lambda a, b: align.edit_table(a, b)[-1][-1]
    assert sum(p != u for p, u, _ in found) == edits(rows[0][0], rows[0][1])


def test_null_rows_and_an_empty_batch():
    names, (a, b) = align_batch.numbered(pa.array([None, ["a"]], pa.list_(pa.string())), pa.array([["a"], None], pa.list_(pa.string())))
    assert [shown(names, x) for x in align_batch.aligned_pairs(a, b)] == [[("-", "a")], [("a", "-")]]
    _, (a, b) = align_batch.numbered(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string())))
    assert align_batch.pair_moves(a, b) == [] and align_batch.joint(a, a, b) == [] and len(align_batch.slot_table(a, a, b)[1]) == 0
