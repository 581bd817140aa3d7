from __future__ import annotations

import hashlib
import re
import string
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.llm import line_dedup, quality, queries

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LINE = "This line is long enough to count."
DOCS = [
    (1, f"{LINE}\nown line one\n  {LINE.upper()}\t"), (2, f"{LINE}\n\n"), (3, f"a\n{LINE}\n{LINE}\nb"), (4, "short\nshort"), (5, "short"), (6, "short"),
    (7, ""), (8, None), (9, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ x"), (10, "àéîõü àéîõü àéîõü àéîõü x"), (11, "àéîõü àéîõü àéîõü àéîõü x"), (12, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ X"),
    (13, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ x"), (14, "K and more text to be long enough"), (15, "k and more text to be long enough"), (16, "K and more text to be long enough"),
]


def lines_by_hand(docs):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_by_hand(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == lines_by_hand(DOCS)


def test_line_dedup_odd_tables(spark):
    df = spark.createDataFrame([(1, LINE, "x", 5), (1, LINE, "x", 5), (2, LINE, "y", 6), (3, LINE, "z", 7), (None, LINE, "n", 8)], "doc_id long, text string, n_lines string, _h1 int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "_h1", "n_dropped"]
    assert sorted((r.doc_id or 0, r.text, r._h1) for r in out.collect()) == [(0, "", 8), (1, "", 5), (1, "", 5), (2, "", 6), (3, LINE, 7)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAkKKİi̇éÉ ", max_size=6), st.text(alphabet="aAkKKİi̇éÉ ", max_size=6))
def test_key_parts_are_as_sharp_as_the_key(a, b):
    def parts(s):
        if s.isascii():
            return s.lower(), ""
        if "K" in s or "İ" in s:
            return s.translate(LOWER), ""
        return s.lower(), re.sub(r"[\x00-\x7F]+", "", s)

    assert (parts(a) == parts(b)) == (a.translate(LOWER) == b.translate(LOWER))


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if wins[w] > 1 for p in (i, i + 1, i + 2)}
    used = [x for x in text.split("\n") if x.strip(SPACE)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(used) - len(set(used)), len(covered), failed)


CLEAN = "\n".join(f"Sentence {i} tells a{i} story{i} of b{i} and the topic{i * 7} at hand{i}." for i in range(12))
TEXTS = [
    None, "", "  \n\t", "one", "a b c a b c", "x " * 60, CLEAN, CLEAN + "\n" + CLEAN, "\n".join(["Home | About | News | Contact"] * 9) + "\n" + CLEAN[:200], "word*** " * 80,
    CLEAN + "\nAll rights reserved.", "a b c\x0bd é", "SALE!! " * 60, " ".join(f"w{i}" for i in range(3000)) + ".", " ".join(f"w{i % 40}" for i in range(3000)) + ".", "日本 語 " * 30,
]


def test_quality_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_by_hand(t), i
    assert rows[6].kept and rows[10].kept and not rows[9].kept and not rows[12].kept and not rows[8].kept and not rows[0].kept
    assert rows[10].clean_text == CLEAN and rows[6].clean_text == CLEAN


def test_quality_positions_past_the_packed_range(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 4)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.judge(df).collect():
        assert r.n_repeat_words == quality_by_hand(TEXTS[r.doc_id])[4], r.doc_id


def test_quality_extra_columns(spark):
    df = spark.createDataFrame([(1, "x", "old")], "doc_id long, text string, kept string").withColumn("_words", F.lit(1))
    assert quality.judge(df).columns[:4] == ["doc_id", "text", "kept", "_words"]
    assert quality.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_warc", "op4_quality_rules", "op8_chat"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    expected = sorted(str(tuple(dict(zip(want.columns, r, strict=True))[c] for c in cols)) for r in want.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == expected


def test_digest_is_of_the_cleaned_text(spark, sf_dir):
    row = queries.op1_line_dedup(spark, sf_dir).where("n_dropped = n_lines").first()
    assert row is None or row.kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_filter_on_the_verdict_does_not_unfold_the_steps(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kept = quality.judge(df).where("kept and n_repeat_words < 1000").select("doc_id", "clean_text")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(df).collect() if r.kept}


def test_key_parts_in_spark(spark):
    lines = [" Abc É\t", "abc É", "abc é", "KELVIN K", "kelvin K", "kelvin k", "İ i", "i̇ i", "ΑΣ", "ας", "ασ", "", "\x0b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    rows = df.select("i", line_dedup.line_key(F.col("t")).alias("k"), F.struct(*line_dedup.key_parts(F.btrim("t", F.lit(SPACE)))).alias("p")).collect()
    keys = {r.i: r.k for r in rows}
    assert keys == {i: t.strip(SPACE).translate(LOWER) for i, t in enumerate(lines)}
    assert all((a.k == b.k) == (a.p == b.p) for a in rows for b in rows)


def test_menus_and_notices_in_four_languages(spark):
    lines = ["Home", " Log in ", "Accueil.", "Impressum", "Mapa del sitio", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Lea nuestra política de privacidad.", "Copyright (c) Us."]
    kept = ["They went home.", "Inicio la frase con calma.", "It is unlicensed under law."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines + kept)], "doc_id long, text string")
    rows = {r.doc_id: r.clean_text for r in quality.judge(df).collect()}
    assert [rows[i] for i in range(len(lines))] == [""] * len(lines) and [rows[len(lines) + i] for i in range(len(kept))] == kept
