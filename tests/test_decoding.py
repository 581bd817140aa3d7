"""Beam search against the sum over all paths, and against a plain search where the beam is narrow."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.operators import decoding


def log_probs(r, frames, symbols):
    z = r.normal(size=(frames, symbols)) * 2
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def all_paths(x, blank=0):
    mass = defaultdict(float)
    for path in itertools.product(range(x.shape[1]), repeat=len(x)):
        spelled = tuple(k for k, _ in itertools.groupby(path) if k != blank)
        mass[spelled] += math.exp(sum(x[t, s] for t, s in enumerate(path)))
    return mass


def plain_search(x, width, n, blank=0):
    beams = {(): (0.0, -math.inf)}
    for f in x:
        new = defaultdict(lambda: [-math.inf, -math.inf])
        for p, (b, o) in beams.items():
            for s, v in enumerate(f):
                if s == blank:
                    new[p][0] = np.logaddexp(new[p][0], np.logaddexp(b, o) + v)
                elif p and s == p[-1]:
                    new[p][1] = np.logaddexp(new[p][1], o + v)
                    new[(*p, s)][1] = np.logaddexp(new[(*p, s)][1], b + v)
                else:
                    new[(*p, s)][1] = np.logaddexp(new[(*p, s)][1], np.logaddexp(b, o) + v)
        beams = {p: tuple(v) for p, v in sorted(new.items(), key=lambda k: -np.logaddexp(*k[1]))[:width]}
    return sorted(((list(p), np.logaddexp(*v)) for p, v in beams.items()), key=lambda k: -k[1])[:n]


def test_a_wide_beam_sums_all_paths():
    r = np.random.default_rng(1)
    frames = [log_probs(r, int(r.integers(0, 6)), 3) for _ in range(60)]
    for x, found in zip(frames, decoding.search(frames, 200, 5), strict=True):
        want = sorted(all_paths(x).items(), key=lambda k: -k[1])[:5]
        assert [tuple(ids) for ids, _ in found] == [p for p, _ in want]
        assert [s for _, s in found] == pytest.approx([math.log(v) for _, v in want])


@pytest.mark.parametrize("width", [1, 3, 8])
def test_a_narrow_beam(width, monkeypatch):
    monkeypatch.setattr(decoding, "_CELLS", 500)  # many groups
    r = np.random.default_rng(2)
    frames = [log_probs(r, int(r.integers(0, 30)), 6) for _ in range(60)]
    n = min(width, 3)
    for x, found in zip(frames, decoding.search(frames, width, n), strict=True):
        want = plain_search(x, width, n)
        assert [ids for ids, _ in found] == [p for p, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])


def test_column(spark):
    a, b = [math.log(x) for x in (0.1, 0.8, 0.1)], [math.log(x) for x in (0.7, 0.2, 0.1)]
    rows = [(1, [a, a, b, a]), (2, None), (3, []), (4, [b])]
    df = spark.createDataFrame(rows, "k int, f array<array<double>>")
    got = {r.k: r.s for r in df.select("k", decoding.nbest(F.col("f"), 4, 2).alias("s")).collect()}
    assert got[1][0].ids == [1, 1] and got[2] is None and [(x.ids, x.score) for x in got[3]] == [([], 0.0)] and got[4][0].ids == [] and len(got[4]) == 2
    longer = df.select("k", decoding.nbest(F.col("f"), 4, bonus=2.0).alias("s")).where("k = 4").first().s
    assert longer[0].ids == [1] and longer[0].score == pytest.approx(math.log(0.2) + 2)
    with pytest.raises(ValueError):
        decoding.nbest(F.col("f"), 2, 3)
    with pytest.raises(Exception, match="score for each symbol"):
        spark.createDataFrame([([[0.0], [0.0, 1.0]],)], "f array<array<double>>").select(decoding.nbest(F.col("f"), 2)).collect()


def test_empty_table(spark):
    assert spark.createDataFrame([], "f array<array<double>>").select(decoding.nbest(F.col("f"), 2)).collect() == []
