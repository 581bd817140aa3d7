"""Segments of IPA text."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.functions import segments


def cut(text):
    """The automaton, a character at a time."""
    marks = {chr(k) for k in range(0x300, 0x370)} - set(segments.TIES)
    behind = set(segments.BEHIND) | marks
    out, at = [], 0

    def letter(i):
        if i < len(text) and text[i] in segments.LETTERS:
            i += 1
            while i < len(text) and text[i] in behind:
                i += 1
            return i
        return None

    while at < len(text):
        i = at
        while i < len(text) and text[i] in segments.BEFORE:
            i += 1
        end = letter(i)
        while end is not None and end < len(text) and text[end] in segments.TIES and (more := letter(end + 1)) is not None:
            end = more
        end = at + 1 if end is None else end
        out.append(text[at:end])
        at = end
    return out


@pytest.fixture(scope="module")
def split(spark):
    def run(texts):
        return [r.s for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(segments.split(F.col("t")).alias("s")).collect()]

    return run


def test_known_segments(split):
    got = split(["t͡ʃa", "ᵐbaː n̪", "A-ɔ͜ʊʰ!", "", None, "ᵐ ʰa͡", "日k\n"])
    assert got == [["t͡ʃ", "a"], ["ᵐb", "aː", " ", "n̪"], ["A", "-", "ɔ͜ʊʰ", "!"], [], None, ["ᵐ", " ", "ʰ", "a", "͡"], ["日", "k", "\n"]]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("tʃa͜͡ᵐʰː̪ ̃A1𝒳\n")), max_size=14), min_size=20, max_size=40))
def test_the_pattern_is_the_automaton(split, texts):
    got = split(texts)
    assert got == [cut(t) for t in texts] and ["".join(x) for x in got] == texts


def test_vocabulary_and_decoding(spark):
    df = spark.createDataFrame([(1, "t͡ʃa t͡ʃ"), (2, "a?"), (3, None)], "k int, t string")
    vocabulary = segments.segment_vocabulary(df, "t", 2)
    assert [(r.token, r.id, r.n) for r in vocabulary.orderBy("id").collect()] == [("[PAD]", 0, None), ("[UNK]", 1, None), ("a", 2, 2), ("t͡ʃ", 3, 2)]
    known = segments.as_map(vocabulary)
    rows = df.select("k", segments.encode_text(F.col("t"), known).alias("ids")).withColumn("more", F.concat("ids", F.array(F.lit(0), F.lit(99))))
    got = {r.k: r for r in rows.select("k", "ids", segments.decode_ids(F.col("more"), known).alias("all"), segments.decode_ids(F.col("more"), known, clean=True).alias("clean")).collect()}
    assert (got[1].ids, got[1]["all"], got[1].clean) == ([3, 2, 1, 3], "t͡ʃa[UNK]t͡ʃ[PAD][UNK]", "t͡ʃat͡ʃ") and got[3].ids is None
    with pytest.raises(ValueError):
        segments.as_map(vocabulary, 3)
