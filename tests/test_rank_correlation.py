"""Kendall's tau by blocks against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.operators import labels


def by_hand(pairs):
    s = tt = tp = 0
    for k, (t1, p1) in enumerate(pairs):
        for t2, p2 in pairs[:k]:
            s += ((t1 > t2) - (t1 < t2)) * ((p1 > p2) - (p1 < p2))
            tt += t1 == t2
            tp += p1 == p2
    n = len(pairs) * (len(pairs) - 1) / 2
    return s / math.sqrt((n - tt) * (n - tp)) if n > tt and n > tp else 0.0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3)), max_size=30))
def test_inversions(rows):
    v, w = np.array([r[0] for r in rows], float), np.array([float(r[1]) for r in rows])
    assert labels.inversions(v, w) == sum(w[i] * w[j] for j in range(len(v)) for i in range(j) if v[i] > v[j])


@pytest.mark.parametrize(("block_rows", "cuts", "few"), [(4096, 512, 0), (20, 512, 0), (5, 7, 0), (4096, 512, 1024)])
def test_blocks_of_any_size(spark, block_rows, cuts, few):
    r = random.Random(block_rows)
    # a third of the rows have one value on a side
    pairs = [(5.0 if k % 3 == 0 else r.random() * 10, 2.0 if k % 3 == 1 else r.choice([r.random(), 3.0, -1.0])) for k in range(300)]
    df = spark.createDataFrame(pairs, "t double, p double")
    got = labels.kendall_tau_b(labels.confusion(df, "p", "t"), block_rows, cuts, few).first().kendall_tau
    assert got == pytest.approx(by_hand(pairs), abs=1e-12)


def test_few_values_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 1.0)], "t double, p double")
    assert labels.kendall_tau_b(labels.confusion(df, "p", "t")).first().kendall_tau == 0.0
    assert labels.kendall_tau_b(labels.confusion(df.limit(0), "p", "t")).first().kendall_tau == 0.0
