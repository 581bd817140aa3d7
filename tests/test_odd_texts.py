"""Queries against their SQL on texts that the given tables do not have."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from phonolake.functions import segments
from phonolake.plans import queries


def test_empty_texts_count_as_an_empty_token(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(0, ""), (1, None), (2, "ab"), (3, "b\r\n"), (4, ""), (5, "e\u0301\U0001f600\x00")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = con.sql(queries.SQL["q08_character_vocabulary"])
    got = queries.QUERIES["q08_character_vocabulary"](spark, str(tmp_path)).select(found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
    assert ("", 2, 4) in {(r["token"], r["n"], r["id"]) for r in got}


def test_segments_by_ranges_and_places(spark, sf_dir):
    """Java's own pattern cuts as the common one does; tokens are looked up by place as by name; texts are cut once for all results."""
    signs = segments.LETTERS[::5] + segments.BEFORE + segments.BEHIND + segments.TIES + "̀ͯ͢ .\n—é😀A"
    rng = random.Random(4)
    texts = ["".join(rng.choice(signs) for _ in range(30)) for _ in range(200)] + ["", None, segments.LETTERS + segments.BEFORE + "ᵐ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    known = {"[PAD]": 0, "[UNK]": 1} | {t: k + 2 for k, t in enumerate([*segments.LETTERS[::3], "ɐ̀", "—", "😀", " "])}
    plain = F.regexp_extract_all("t", F.lit(segments.SEGMENT), F.lit(0))
    names = {i: t for t, i in known.items()}
    for own, cut, ids, clean, text in rows.select(plain, segments.split(F.col("t")), segments.encode_text(F.col("t"), known), *(segments.decode_ids(segments.encode_text(F.col("t"), known), known, clean=c) for c in (True, False))).collect():
        assert own == cut
        if own is not None:
            assert ids == [known.get(x, 1) for x in own]
            assert clean == "".join(x for x in own if x in known) and text == "".join(names[i] for i in ids)
    plan = queries.QUERIES["q60_segment_tokenizer"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
