from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.llm import queries, simhash, suffix_dedup


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(n))


def repeats_by_hand(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + window] for x in raw for i in range(len(x) - window + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    shared, other = words(150, 1), words(120, 2)
    made = [
        words(200, 3), words(40, 4) + shared + words(40, 5), shared, shared + other, words(30, 6) + other + words(9, 7) + other, None, "", "short", "ab" * 500, "x" * 1200, "xy" + "x" * 450,
        words(200, 3)[:-1], words(200, 3)[:300] + "ZZ" + words(200, 3)[300:], shared[5:420], shared[:399], shared[:400], shared[1:401] + other[7:433],
    ]
    return made + [words(3, i) + shared[i : i + 401 + i] + words(4, 50 + i) for i in range(12)]


@pytest.mark.parametrize("batches", [1, 5])
def test_suffix_dedup_by_hand(spark, batches):
    made = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, batches=batches).collect()}
    assert [got[i] for i in range(len(made))] == repeats_by_hand(made, 400)


def test_suffix_dedup_small_windows(spark):
    made = [words(60, i % 5)[: 150 + 13 * i] for i in range(25)] + ["ab" * 90, "ba" * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    out = suffix_dedup.dedup(df, window=50, gram=8, node=16, with_kept=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(made))] == repeats_by_hand(made, 50)
    assert all(sum(s.e - s.s for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in rows.values())


def test_suffix_dedup_past_a_piece(spark):
    """Texts longer than PIECE, with a repeat over a piece's edge, periodic ones, and one of 40,000 equal bytes."""
    shared, edge = words(3000, 21), suffix_dedup.PIECE
    made = [words(60_000, 22), words(52_000, 23), "x" * 40_000, "abc" * 30_000]
    made = [made[0][: edge - 3000] + shared + made[0][edge - 3000 :], shared[2000:9000] + made[1], *made[2:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.dedup(df, with_kept=True).collect()}
    assert max(len(t.encode()) for t in made) > edge
    assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(made))] == repeats_by_hand(made, 400)
    assert all(rows[i].kept.decode("utf-8", "ignore") == rows[i].text for i in range(len(made)))


def test_suffix_dedup_leaves_nothing_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    suffix_dedup.dedup(made).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_suffix_dedup_odd_tables(spark):
    t = words(100, 9)
    df = spark.createDataFrame([(1, t, 3), (1, t, 4), (None, None, 5)], "doc_id long, text string, dk int")
    rows = sorted(((r.doc_id or 0), r.n_removed, r.n_bytes) for r in suffix_dedup.dedup(df).collect())
    n = len(t.encode())
    assert rows == [(0, 0, 0), (1, n, n), (1, n, n)]
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400))
def test_every_window_is_in_one_segment(text):
    found = sorted(s[3:] for s in suffix_dedup.segments(text, 50, 8))
    covered = [i for a, _, b in found for i in range(a, b + 1)]
    assert covered == list(range(max(0, len(text) - 49)))
    assert all(i <= p <= i + 42 for a, p, b in found for i in (a, b))
    heads = [s[0] for s in suffix_dedup.segments(text, 50, 8)]
    starts = [text[s[4] : s[4] + 8] for s in suffix_dedup.segments(text, 50, 8)]
    assert [x for _, x in sorted(zip(heads, starts, strict=True))] == sorted(starts)


def batch_of(spark, texts, first=0):
    df = spark.createDataFrame([(0, first + i, 0, t) for i, t in enumerate(texts)], "batch int, dk long, th long, text string")
    return suffix_dedup.suffixes(df)


def test_levels_merge_geometrically(spark):
    family = suffix_dedup.SuffixFamily(spark)
    ranks, sizes = [], []
    for i in range(5):
        family.take(batch_of(spark, [words(150, i)], i))
        ranks.append([r for r, _ in family.levels])
        sizes.append(sum(x.count() for _, x in family.levels))
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]
    assert sizes[-1] == sum(len(list(suffix_dedup.segments(words(150, i).encode()))) for i in range(5))
    level = family.levels[0][1]
    for part in level.select("head", "gram", "seg").rdd.glom().collect():
        assert part == sorted(part)


def test_a_batch_is_scanned_against_every_level(spark):
    family, passage, other = suffix_dedup.SuffixFamily(spark), words(400, 77), words(300, 78)
    for i in range(3):
        extra = passage if i == 1 else other if i == 2 else ""
        assert family.take(batch_of(spark, [words(40, i) + extra + words(200, 20 + i)], i)).count() == 0
    assert [r for r, _ in family.levels] == [1, 0]
    new = [words(30, 5) + passage + words(30, 6), words(300, 8), other]
    found = {tuple(r) for r in family.scan(family.array_of(batch_of(spark, new, 9))).collect()}
    inside = [{s[:3] for s in suffix_dedup.segments(t.encode())} for t in (passage, other)]
    assert found and found <= inside[0] | inside[1] and all(len(found & x) >= len(x) - 4 for x in inside)


def test_scans_and_merges_need_no_exchange(spark):
    from tests.test_plans import plan

    family = suffix_dedup.SuffixFamily(spark)
    a, b = (family.array_of(batch_of(spark, [words(150, i)], i)) for i in (1, 2))
    both = a.select(*suffix_dedup.ORDER).join(b.select(*suffix_dedup.ORDER).hint("merge"), suffix_dedup.ORDER, "left_semi")
    for text in (plan(both), plan(suffix_dedup._merged(a, b))):
        assert "SortMergeJoin" in text and "Exchange" not in text


def groups_by_hand(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_by_hand(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf_dir).collect()}
    fps = {d: simhash.fingerprint_of(t) for d, t in docs.items()}
    want = groups_by_hand(fps)
    assert got == {d: (f"{fps[d] & (2**64 - 1):016x}", want[d]) for d in docs}


def test_fingerprint_is_sparks_xxhash(spark):
    t = "One two  three\tFOUR é"
    shingles = ["one two three", "two three four", "three four é"]
    hashes = [r.h & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint_of(t) & (2**64 - 1) == want
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0
    one = spark.createDataFrame([("ab c",)], "s string").select(F.xxhash64("s").alias("h")).first().h
    assert simhash.fingerprint_of("AB\nc") == one


def test_links_find_all_close_pairs(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.int64)
    made = set()
    for b in base.tolist():
        made.add(b)
        for k in (1, 2, 3, 4):
            for _ in range(4):
                x = b
                for bit in r.choice(64, k, replace=False).tolist():
                    x ^= (1 << bit) if bit < 63 else -(1 << 63)
                made.add(x)
    fps = sorted(made)
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(x, y) for i, x in enumerate(fps) for y in fps[i + 1 :] if bin((x ^ y) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_tables(spark):
    t = words(60, 1)
    df = spark.createDataFrame([(5, t, 1), (5, t, 1), (3, t, 2), (None, t, 3), (9, None, 4), (8, " ", 5)], "doc_id long, text string, fp int")
    rows = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert rows == [(0, 3), (3, 3), (5, 3), (5, 3), (8, 8), (9, 8)]
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
