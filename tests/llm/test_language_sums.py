"""Training of language identification: sums in executors, bounds, ids of any type."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.llm import langid

ANSI = "spark.sql.ansi.enabled"


def test_presence_is_the_plain_set():
    for text in ("", "a", "Abc  d1É", "née — 12 x", "日本語 ABC", "\U0001f600z"):
        raw = b" " + b" ".join(bytes(langid._FOLD[c] for c in text.encode()).split()) + b" "
        want = set()
        for n in range(1, langid.MAX_N + 1):
            for i in range(len(raw) - n + 1):
                h = 0
                for c in raw[i : i + n]:
                    h = (h * 0x01000193 + c + 1) % 2**32
                want.add((h * 0x9E3779B1 % 2**32) >> 17)
        assert set(np.flatnonzero(langid.presence(text)).tolist()) == want


def test_executors_sum_what_one_fit_sums(spark):
    words = {"aa": "alpha beta gamma", "bb": "uno dos tres", "cc": "eins zwei drei"}
    rows = [(i, f"{v} {i} {v.split()[i % 3]} {'xyzuvw'[i % 6]}", k) for i in range(40) for k, v in words.items()]
    df = spark.createDataFrame([*rows, *rows[:30], (None, None, "aa"), (1, "text", None)], "doc_id long, text string, lang string").repartition(5)
    model = langid.train(df, 25, 10)
    few = langid.sample(df, 25, 10).collect()
    assert {k: sum(r.lang == k for r in few) for k in words} == dict.fromkeys(words, 25) and sum(r.mark for r in few) == 30
    few.sort(key=lambda r: (r.lang, r._u))
    x = np.stack([np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)).astype(bool) for r in few])
    alone = langid.KernelModel.fit(x, [r.lang for r in few], 10)
    assert model.languages == alone.languages == sorted(words)
    assert np.allclose(model.scores(x), alone.scores(x), atol=1e-3)


def test_landmarks_are_bounded_in_all(spark):
    names = [f"l{i:03d}" for i in range(500)]
    letters = "bcdfghjklmnpqrstvwxyz"

    def said(i, j):
        own = [letters[i % 21] + "aeiou"[i // 21 % 5] + letters[i // 105], letters[i // 25 % 21] + "o" + letters[i % 19]]
        return " ".join(own * 3 + [f"w{letters[j]}"])

    df = spark.createDataFrame([(f"{n}-{j}", said(i, j), n) for i, n in enumerate(names) for j in range(6)], "doc_id string, text string, lang string")
    found = langid.sample(df, 300, 48).cache()
    assert found.where("mark").count() == 500 * (langid.MAX_LANDMARKS // 500)
    out = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 500 and right > 0.9
    found.unpersist()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_ids_of_any_type(spark, ansi):
    rows = [(f"d-{i}", "the cat and dog" if i % 2 else "der hund und katze", "en" if i % 2 else "de") for i in range(30)]
    df = spark.createDataFrame([*rows, (None, "der hund", None)], "doc_id string, text string, lang string")
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, ansi)
    try:
        got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
        parts = langid.identify(df.select(F.struct("doc_id").alias("doc_id"), "text", "lang")).collect()
    finally:
        spark.conf.set(ANSI, before)
    assert got == {**{i: k for i, _, k in rows}, None: "de"}
    assert len(parts) == 31
