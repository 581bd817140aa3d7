"""Alignments by bits, within bands, and over places that are worked out once."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from phonolake.functions import phones
from phonolake.operators import align, align_batch, scoring


def made(seed, longest=40, letters="abcd-"):
    rng = random.Random(seed)
    return [[rng.choice(letters) for _ in range(rng.randrange(longest))] for _ in range(3)]


def ragged(*sides):
    return [align_batch.Ragged.of([x]) for x in align._codes(*sides)]


@pytest.mark.parametrize("seed", range(12))
def test_tables_and_reach(seed, monkeypatch):
    monkeypatch.setattr(align_batch, "_CELLS", [1 << 25, 300][seed % 2])
    a, b, _ = made(seed)
    (x, y), plain = align._codes(a, b), np.array(align.edit_table(a, b))
    assert (align_batch._table(x, y, False) == plain).all()
    back = np.array(align.edit_table(a[::-1], b[::-1]))[::-1, ::-1]
    on = plain + back == plain[-1, -1]
    low, high = align_batch._reach(x, y)
    assert low.tolist() == on.argmax(1).tolist() and high.tolist() == (len(b) - on[:, ::-1].argmax(1)).tolist()
    agreed = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a, 1):
        for j, q in enumerate(b, 1):
            agreed[i][j] = max(agreed[i - 1][j], agreed[i][j - 1], agreed[i - 1][j - 1] + (p == q != "-"))
    assert align_batch._table(x, y, True).tolist() == agreed


@pytest.mark.parametrize("large", [1 << 17, 400, 0])
def test_prompts_are_placed_alike_together_and_alone(monkeypatch, large):
    monkeypatch.setattr(align_batch, "_LARGE", large)
    rows = [made(seed, letters="abc-" if seed % 3 else "abc") for seed in range(20)]
    codes = {s: k for k, s in enumerate("-abc")}
    sides = [align_batch.Ragged.of([np.array([codes[s] for s in row[side]], np.int64) for row in rows]) for side in range(3)]
    for row, found in zip(rows, align_batch.strict(*sides), strict=True):
        assert [tuple("-abc"[x] for x in r) for r in zip(*found, strict=True)] == align.align_strict(*row)


@pytest.mark.parametrize("wide", [False, True])
def test_each_place_of_a_joint_alignment_is_worked_out_once(monkeypatch, wide):
    """Also with numbers that no 64 bits hold."""
    seen, real, units = [], align_batch._Walk._moves_of, align_batch._units
    monkeypatch.setattr(align_batch._Walk, "_moves_of", lambda self, x, s, told: seen.extend(zip(x.tolist(), s.tolist(), strict=True)) or real(self, x, s, told))
    if wide:
        monkeypatch.setattr(align_batch, "_units", lambda spans: ([u << 70 for u in units(spans)[0][:-1]] + [1], object))
    p, u, h = made(5, letters="abcd")
    found = align_batch.joint(*ragged(p, u, h))[0]
    names = np.array(list(dict.fromkeys(["-", *p, *u, *h])), object)
    assert [tuple(names[x] for x in r) for r in zip(*found, strict=True)] == align.align_joint(p, u, h)
    assert seen and len(seen) == len(set(seen))


def test_flaps_are_looked_for_only_where_a_letter_tells(spark):
    """Rows with any flap are settled as before; the others are not segmented for it, as their letters tell."""
    assert all(re.search(phones.FLAP_LETTERS, f) for f in phones.FLAPS) and not any(re.search(phones.FLAP_LETTERS, x) for x in phones.INVENTORY)
    rows = [("æ d ɪ", f"æ {f} ɪ", f"æ {f} {f}") for f in phones.FLAPS] + [("æ d ɪ", "æ t ɪ", "")]
    out = scoring.project_triplet(spark.createDataFrame(rows, "canonical string, transcription string, prediction string"))
    assert [r["u"] for r in out.collect()] == [["æ", "d", "ɪ"]] * len(phones.FLAPS) + [["æ", "t", "ɪ"]]
