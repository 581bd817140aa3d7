from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from phonolake.functions import vocabulary
from phonolake.operators import features, inventory, splits

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_ranks_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), r.choice([None, *range(300)]), i) for i in range(3000)]
    rows += [("ties", 7, 1)] * 5
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = splits.ranked(df, ["g"], ["x", "i"]).collect()
    assert len(got) == len(rows)
    for g in {x[0] for x in rows}:
        own = sorted((x for x in got if x.g == g), key=lambda x: x["__r"])
        assert [x["__r"] for x in own] == list(range(1, len(own) + 1)) and {x["__n"] for x in own} == {len(own)}
        keys = [(x.x is not None, x.x or 0, x.i) for x in own]
        assert keys == sorted(keys)
    empty = splits.fraction_split(df.limit(0), ["g"], ["i"])
    assert empty.columns == ["g", "x", "i", "split"] and empty.count() == 0


def test_choose_units(spark):
    rows = [(s, d, k) for s, n in (("x", 9), ("y", 2), (None, 5)) for d in range(n) for k in range(3)] + [("x", None, 0)]
    df = spark.createDataFrame(rows, "state string, district int, k int")
    got = splits.choose_units(df, ["state"], "district", 4, seed=3).collect()
    kept = {s: {r.district for r in got if r.state == s} for s in ("x", "y", None)}
    assert {s: len(d) for s, d in kept.items()} == {"x": 4, "y": 2, None: 4} and len(got) == 30
    again = splits.choose_units(df.repartition(5), ["state"], "district", 4, seed=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_best_matchings():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        likeness = r.random((n, m)).round(2)
        got = inventory.best_matchings(likeness)
        for k in range(1, n + 1):
            places = itertools.permutations([*range(m), *[None] * k], k)
            assert got[k - 1] == pytest.approx(max(sum(likeness[i, j] for i, j in enumerate(p) if j is not None) for p in places))


def test_featured_inventory(spark):
    df = spark.createDataFrame([("u", ["p", "p", "z", "q?"], ["b", "s"]), ("v", ["p"], ["p"]), ("w", [], ["p"])], "k string, p array<string>, r array<string>")
    got = {x.k: x for x in inventory.featured_inventory_scores(df, "p", "r", ["k"]).collect()}
    like = lambda a, b: 1 - features.hamming(a, b)
    assert got["v"].f1 == got["v"].exclusive_max_f1 == 1 and got["w"].f1 == 0
    p = (max(like("p", "b"), like("p", "s")) + max(like("z", "b"), like("z", "s"))) / 3
    assert got["u"].precision == pytest.approx(p) and got["u"].max_f1 > got["u"].f1
    assert got["u"].exclusive_recall == pytest.approx(max(like("p", "b") + like("z", "s"), like("p", "s") + like("z", "b")) / 2)
    whole = inventory.featured_inventory_scores(df, "p", "r").collect()
    assert len(whole) == 1 and 0 < whole[0].f1 < 1


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_piece_functions(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["This is a test.", "", None, "naïve  café 日本"]
    f = vocabulary.piece_functions(MODEL)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", f["text_to_pieces"]("t").alias("p"), f["text_to_ids"]("t").alias("i"))
    df = df.select("*", f["pieces_to_ids"]("p").alias("pi"), f["ids_to_pieces"]("i").alias("ip"), f["pieces_to_text"]("p").alias("pt"), f["ids_to_text"]("i").alias("it"))
    for t, r in zip(texts, df.collect(), strict=True):
        if t is None:
            assert r.p is r.i is r.pi is r.ip is r.pt is r.it is None
        else:
            assert r.p == model.encode(t, out_type=str) and r.i == model.encode(t) == r.pi
            assert r.pt == model.decode(r.i) == r.it and r.ip == [model.id_to_piece(i) for i in r.i]
