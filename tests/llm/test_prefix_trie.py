from __future__ import annotations

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
SMALL = {"least_rows": 10, "range_rows": 40, "run_bytes": 4000, "piece_rows": 3}


def by_hand(rows, branch):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {k: [(role, text) for *_, role, text in sorted(v)] for k, v in found.items()}
    if branch:
        h = {k: zlib.crc32(str(k).encode()) % 9 for k in convs}
        convs = {k: convs.get(k - k % 5, [])[: h[k]] + v[h[k] :] for k, v in convs.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for k, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(k)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))

    @functools.cache
    def sums(node):
        below = [sums(x) for x in kids[node]]
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        return sum(x for x, _ in below) or 1, own + sum(x for _, x in below)

    out = []
    for node, own in [*members.items()]:
        ends = sorted(k for k in own if len(convs[k]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(kids[node]), *sums(node), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(), len(ends)))
    return sorted(map(str, out))


def nodes(spark, rows, branch, **limits):
    df = spark.createDataFrame(rows, SCHEMA)
    made = prefix_trie.branched_sequences(df) if branch else prefix_trie.sequences(df)
    return sorted(str(tuple(r)) for r in prefix_trie.prefix_nodes(made, **limits).collect())


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    out = [(c, t, r.choice("ua"), r.choice("xyz") * (r.randint(0, 2) if r.random() < 0.3 else 1)) for c in range(200) for t in range(r.randint(1, 9))]
    return [*out, (None, 1, "a", "b"), (1, None, None, None), (1, None, None, None), (5, 3, "a", "b"), (500, 1, "u", None)]


@pytest.mark.parametrize("branch", [True, False])
def test_nodes_over_many_ranges_are_those_by_hand(spark, talks, branch):
    assert nodes(spark, talks, branch, **SMALL) == by_hand(talks, branch)


def test_one_range(spark, talks):
    assert nodes(spark, talks, True) == by_hand(talks, True)


def test_long_shared_beginnings_and_copies(spark):
    rows = [(c, t, "u", str(min(t, c % 3) if t > 20 else t)) for c in range(120) for t in range(30)]
    assert nodes(spark, rows, False, **SMALL) == by_hand(rows, False)


def test_empty_and_null(spark):
    assert nodes(spark, [], True) == nodes(spark, [(None, 1, "u", "x")], True) == []


def test_other_columns_and_names(spark, talks):
    df = spark.createDataFrame([(a, b, c, d, 1, "x") for a, b, c, d in talks], "id long, seq long, who string, conv_id string, sizes int, _conv string")
    made = prefix_trie.sequences(df, "id", "seq", "who", "conv_id")
    assert sorted(str(tuple(r)) for r in prefix_trie.prefix_nodes(made).collect()) == by_hand(talks, False)


def test_a_list_of_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 40)
    rows = [(c, 0, "u", "x") for c in range(300)]
    assert nodes(spark, rows, False, **SMALL) == by_hand(rows, False)


KEYS = st.lists(st.sampled_from([bytes([k]) * prefix_trie.WIDTH for k in range(3)]), max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(KEYS, min_size=1, max_size=8), min_size=1, max_size=5), st.integers(1, 3))
def test_the_merge_keeps_order_and_common_prefixes(dealt, piece_rows):
    runs, n = [], 0
    for k, own in enumerate(dealt):
        rows = [(b"".join(x), n + i, [i] * len(x)) for i, x in enumerate(own)]
        n += len(own)
        runs.append(prefix_trie.Run(list(prefix_trie.sorted_run(rows, [], str(k), piece_rows))))
    before, out = b"", []
    for seq, lcp, sizes_from, sizes, count, _ in prefix_trie.LoserTree(runs):
        assert lcp == prefix_trie.shared_turns(before, seq) and sizes_from <= lcp and len(sizes) == len(seq) // prefix_trie.WIDTH - sizes_from
        out += [seq] * count
        before = seq
    assert out == sorted(b"".join(x) for own in dealt for x in own)
