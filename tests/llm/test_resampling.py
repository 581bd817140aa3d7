from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.llm import resampling

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER).decode())
    return words, [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def by_hand(docs, target, percent=25, min_words=20):
    read = [(i, *features(t)) for i, t in docs]
    corpus, wanted = Counter(b for *_, f in read for b in f), Counter(b for t in target for b in features(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, words, f in read:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    eligible = sorted((o for o in out if o[5] >= min_words), key=lambda o: (-o[3], o[0] is not None, o[0] if o[0] is not None else 0, o[1], o[2]))
    for k, o in enumerate(eligible[: percent * len(eligible) // 100]):
        o[4] = k + 1
    return sorted([tuple(o[:5]) for o in out], key=str)


def drawn(docs, target, **limits):
    return sorted(map(tuple, resampling.resample(docs, target, **limits).collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert drawn(docs, target) == want
    assert drawn(docs.repartition(7), target, range_rows=4, piece_rows=2) == want


def test_repeated_rows_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "REPEAT_ROWS", 16)
    rows = [(1, "Red fox " * 30)] * 90 + [(None, "blue sky " * 15)] * 3 + [(1, "red hen " * 20), (2, None), (3, ""), (4, "x" * 700 + " y" * 40), (5, "ÄÖ é " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("red fox",), (None,)], "text string")
    for percent in (25, 100, 0):
        assert drawn(docs, target, percent=percent, range_rows=8, piece_rows=2) == by_hand(rows, ["red fox"], percent)


def test_string_ids_other_columns_and_empty_tables(spark):
    rows = [(f"d{k}", f"word {k} " * (k % 30)) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "key string, body string, score int, _id string")
    target = spark.createDataFrame([("word 3", 1)], "body string, text int")
    want = by_hand(rows, ["word 3"])
    got = resampling.resample(docs, target, "key", "body", "body")
    assert got.columns == ["key", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*w[:2], *w[2:]) for w in want], key=str)
    assert resampling.resample(docs.limit(0), target, "key", "body", "body").collect() == []
    assert drawn(docs.selectExpr("key doc_id", "body text"), target.limit(0).selectExpr("body text")) == by_hand(rows, [])


PIECES = ["a", "Zz", "é9", " ", "\n", "'", "-", "x" * 300, "日本", "\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=6), st.integers(1, 40))
def test_features_of_blocks_are_those_of_whole_texts(texts, size):
    reader = resampling.FeatureReader()
    parts = [(k, before, block) for k, t in enumerate(texts) for before, block in resampling.blocks(t.encode(), size)]
    own, owner, bucket = reader.read(parts or [(0, b"", b"")])
    for k, t in enumerate(texts):
        words, want = features(t)
        assert Counter(bucket[owner == k].tolist()) == Counter(want) and int((own == k).sum()) == len(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), max_size=9), st.integers(1, 4))
def test_the_tournament_merges_pieces_as_they_come(runs, size):
    pieces = []
    for k, run in enumerate(runs):
        run = [(x,) for x in sorted(run)]
        pieces += [(run[a], k, a, run[a : a + size]) for a in range(0, len(run), size)]
    got = list(resampling.merge((k, entries) for _, k, _, entries in sorted(pieces, key=lambda p: p[:3])))
    assert got == sorted((x,) for run in runs for x in run)


def test_ranges_hold_whole_scores():
    ranges = resampling.Ranges({5: 3, 4: 2, 1: 9, 0: 1, -7: 4}, draw=10, rows=4)
    assert (ranges.low, ranges.base) == ([4, 1], [0, 5])
