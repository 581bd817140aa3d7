from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.llm import chat, decontam, langid, packing, queries
from phonolake.llm.words import HashIndex, Remembered, WordHasher

TOKENIZER = packing.default_tokenizer()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


PIECES = ["it's", "IT'S,", "e.g.", "don't!!", "é", "É,", "a—,b", "x1y22", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "ß", "İ", "éx", "word***", "日本語", "'s", ",'s", "a'", "_a_", "\x1c", "...", "²³", "K", "q" * 300, "z9" * 200]


def test_words_give_the_ids_of_the_whole(plain):
    r = random.Random(1)
    texts = ["", " ", "\n\t"] + [r.choice(["", " "]).join([]) + "".join(r.choice(PIECES) + r.choice([" ", "  ", "\n", "", ""]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    words = packing.WordTokenizer(TOKENIZER)
    got = list(words.encode_stream(t.encode() for t in texts))
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == plain.encode(t, add_special_tokens=False).ids, t
    words.words.most = 3
    again = list(words.encode_stream(t.encode() for t in texts))
    assert all(a.tolist() == b.tolist() for a, b in zip(got, again, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8))
def test_any_text(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    words = packing.word_tokenizer(TOKENIZER)
    for t, g in zip(texts, words.encode_many([t.encode() for t in texts]), strict=True):
        assert g.tolist() == plain.encode(t, add_special_tokens=False).ids


def test_words_of_one_hash_stay_apart(plain):
    """With a first hash of three values nearly all words clash in it, and the second tells them."""
    class Poor:
        def __init__(self, hasher):
            self.hasher = hasher

        def hashes(self, *args):
            return self.hasher.hashes(*args) % np.uint64(3) + np.uint64(1)

    words = packing.WordTokenizer(TOKENIZER)
    words.words.hasher = Poor(words.words.hasher)
    r = random.Random(3)
    for _ in range(20):
        text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(200))
        assert words.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(words.words.clashing) > 100


def test_word_hashes_do_not_depend_on_the_place():
    r = np.random.default_rng(5)
    word = [bytes(r.integers(97, 123, int(n)).astype(np.uint8)) for n in r.integers(1, 257, 300)]
    joined = b" ".join(word * 12)  # longer than two blocks
    assert len(joined) > 3 << 17
    size = np.array([len(w) for w in word * 12])
    end = np.cumsum(size + 1) - 1
    raw = np.frombuffer(joined, np.uint8)
    for which in (0, 1):
        h = WordHasher(which=which).hashes(raw, end - size, end).reshape(12, 300)
        assert (h == h[0]).all() and len(set(h[0].tolist())) == len(set(word))
    got = Remembered().numbers(joined, raw, end - size, end, lambda new: None)
    assert len(set(got.tolist())) == len(set(word)) and (got.reshape(12, 300) == got[:300]).all()


def test_hash_index():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(1, 2**63, 5000, dtype=np.uint64))
    keys[:50] = np.arange(1, 51, dtype=np.uint64)  # all of them start at the same place
    keys = r.permutation(np.unique(keys))
    index = HashIndex(4)
    for part in np.array_split(keys, 7):
        assert (index.find(part) == -1).all()
        index.add(part)
    assert index.find(keys).tolist() == list(range(len(keys)))
    raw = np.frombuffer(b"the cat the dog", np.uint8)
    h = WordHasher().hashes(raw, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def check_packing(rows, seq_len=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    return len(by)


def test_packing_of_the_table(spark, sf_dir, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_packing(spark, sf_dir).collect()
    n = check_packing(rows)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for d, t in docs.items():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted(got[d]) == want
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (None, "a b", 3), (3, "a " * 5000, 4)], "doc_id long, text string, length int")
    rows = packing.pack(packing.pieces(df, with_ids=True)).collect()
    assert check_packing(rows) == 3
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 3), (1, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 2048), (3, 1, 2048), (3, 2, 905)]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


def test_ranks_over_many_buckets(spark):
    rows = [(i, 0, 0, 1 + i % 7, i) for i in range(500)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(parts, seq_len=16, rows_per_bucket=20).collect()
    assert len(out) == 500 and check_packing(out, 16) <= -(-sum(r[3] for r in rows) // 16) + 2


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plans_use_every_piece_once(histogram):
    plan = packing.plan_bins(histogram, 50)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 50 and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    assert len(plan) <= 3 * len(histogram) + 3


def test_two_fit_beats_greedy():
    # greedy leaves 6 + 3 of 10; the two fit replaces 3 by 2 + 2
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


ITEM = "If a farmer named Alice sells 12 crates of apples at 3 dollars each and keeps 5 crates for the winter, how much does Alice earn in total this year?"


def test_decontamination(spark):
    other = ITEM.replace("Alice", "Robert").replace("12", "77").replace("3 dollars", "9 dollars").replace("5 crates", "8 crates")
    mixed = ITEM.replace("Alice sells", "Robert sells")  # the two names of one slot differ
    filler = "The river ran slowly past the old mill and nobody watched it go. " * 5
    docs = [
        (1, filler + ITEM + " " + filler), (2, filler + other + filler), (3, filler + mixed), (4, filler), (5, None), (6, ""), (7, " ".join(ITEM.split()[:12])), (8, "so " + ITEM[0].lower() + ITEM[1:].upper().lower()),
        (9, ITEM), (9, ITEM), (None, ITEM),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM), (2, "four short words only"), (3, None), (4, "...")], "item_id long, text string")
    rows = decontam.contaminated(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.same_values for r in rows}
    assert len(rows) == len(got) and got[(1, 1)] and got[(9, 1)] and got[(None, 1)] and not got[(2, 1)]
    assert {d for d, _ in got} <= {1, 2, 9, None, 8}
    kept = decontam.without_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6, 7} and kept.where("doc_id in (1, 2, 9) or doc_id is null").count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    one_by_one = decontam.contaminated(df, bench, block_bytes=20).collect()
    assert sorted(map(str, one_by_one)) == sorted(map(str, rows))


def test_short_items_match_whole(spark):
    df = spark.createDataFrame([(1, "x y four short words only z"), (2, "four short words")], "doc_id long, text string")
    bench = spark.createDataFrame([(2, "Four short words only")], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(df, bench).collect()] == [1]


def test_decontamination_by_hand(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = lambda t: " " + " ".join("".join(c for c in w if c.isalnum()).lower() for w in t.split() if any(c.isalnum() for c in w)) + " "
    want = {(d, i) for d, t in docs.items() for i, b in items if clean(b) in clean(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 1 + len(want) // 10


def test_language(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_language(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_odd_tables(spark):
    r = random.Random(3)
    make = lambda words: " ".join(r.choice(words) for _ in range(30))
    rows = [(i, make("the of and to in is that".split()), "en", "x") for i in range(30)] + [(100 + i, make("der die und ein nicht ist".split()), "de", "x") for i in range(30)]
    rows += [(900, None, "en", "x"), (901, "", "de", "x"), (902, "12 34 --", None, "x"), (None, "the and of that", None, "x"), (903, "die und nicht", None, "x"), (903, "die und nicht", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(df).collect()
    got = {(r.doc_id, r.lang_pred) for r in out if r.doc_id is None or r.doc_id >= 900}
    assert got == {(900, "und"), (901, "und"), (902, "und"), (None, "en"), (903, "de")} and len(out) == len(rows)
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_long_texts_are_read_whole(monkeypatch):
    t = "abc def " * 400 + "unique zebra ending"
    whole = langid.presence(t)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    assert (langid.presence(t) == whole).all()


def test_the_matrix_is_the_kernel():
    r = np.random.default_rng(0)
    x = r.random((40, langid.FEATURES)) < 0.01
    labels = ["a" if i % 2 else "b" for i in range(40)]  # the odd ones sort first
    x[::2, :50] |= r.random((20, 50)) < 0.5
    model = langid.KernelModel.fit(x, labels, landmarks=20, ridge=1e-3)
    # the matrix multiplied out gives what kernels, map and regression give one after the other
    order = np.r_[1:40:2, 0:40:2]
    unit = x.astype(np.float64) / np.sqrt(x.sum(1, keepdims=True))
    k = unit @ unit[order].T
    value, vector = np.linalg.eigh(k[order])
    phi = np.hstack([k @ (vector / np.sqrt(value)), np.ones((40, 1))])
    a = phi.T @ phi / 20
    target = np.where(np.arange(40)[:, None] % 2 == [1, 0], 1.0, -1.0)
    b = np.linalg.solve(a + 1e-3 * np.trace(a) / len(a) * np.eye(len(a)), phi.T @ target / 20)
    assert np.allclose(model.scores(x), phi @ b, atol=1e-2)
    assert (model.scores(x).argmax(1) == np.array([0 if v == "a" else 1 for v in labels])).mean() > 0.9


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 5, "user", "hi"), (5, 9, "assistant", "no"), (6, 0, None, None), (6, 0, None, None), (7, 0, None, ""), (None, 0, "user", "alone"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(out) == {2, 4, 6, 7, None}
    assert out[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert (out[4].n_equal, out[4].n_turns, out[6].n_turns) == (2, 2, 1) and out[6].text == "<|im_start|>unknown\n<|im_end|>\n"
    assert {r.conv_id for r in chat.collapse(df).collect()} == set(out)
    assert chat.format_chats(df.limit(0)).count() == 0
