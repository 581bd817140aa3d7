from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.llm import token_counts

PARTS = ["the quick ", " brown", "a" * 50, "ab" * 40, "▁▁", "  ", "\n\n", "你好世界", "𠀀𠀁", "é" * 9, "\x00", "<s>", "</s>", "<0x0A>", "data", "-----", "========", "1234567890", " x"]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def whole(plain, rows):
    out = []
    for i, text in rows:
        n = len(plain.encode(text or ""))
        out.append((i, len((text or "").encode()), n, n > 4096))
    return sorted(out, key=str)


def test_chunks_give_the_counts_of_whole_texts(spark, plain):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 120)))) for i in range(120)]
    # texts whose chunks agree on no token until the overlap is wide, copies and copies of an id
    rows += [(None, None), (None, "b" * 700), (7, ""), (7, "a" * 2000), (7, "a" * 2000), (7, "x " * 999), (8, "-" * 1025), (9, "aé" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts.token_counts(df, chunk=64, overlap=8)
    assert sorted(map(tuple, got.collect()), key=str) == whole(plain, rows)


def test_whole_table(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert any(len(t or "") > token_counts.CHUNK for _, t in rows)
    assert sorted(map(tuple, token_counts.token_counts(docs).collect()), key=str) == whole(plain, rows)


def test_ids_of_any_type_other_columns_and_empty_tables(spark, plain):
    rows = [("a", "x " * 100), ("b", None), (None, "y" * 300)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "key string, body string, n_bytes int, _text string")
    got = token_counts.token_counts(df, "key", "body", chunk=64, overlap=8)
    assert got.columns == ["key", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == whole(plain, rows)
    assert token_counts.token_counts(df.limit(0), "key", "body").collect() == []


def test_limit_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert token_counts.token_counts(df, limit=2).first().over_limit
    with pytest.raises(ValueError):
        token_counts.token_counts(df, chunk=16, overlap=8)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab ▁é你𠀀\n-<>0x"), max_size=60))
def test_places_of_tokens(text):
    """Every token that begins and ends in the text stands for the text between its places."""
    model = token_counts.piece_model(token_counts.default_model())
    ids, begin, end = model.ids(text)
    if text:
        assert begin[0] == -1 and end[-1] == len(text)
    for i, a, b in zip(ids.tolist(), begin.tolist(), end.tolist(), strict=True):
        piece = model.model.id_to_piece(i)
        if a >= 0 and not model.model.is_byte(i):
            assert piece.replace("▁", " ") == text[a:b].replace("▁", " ")
