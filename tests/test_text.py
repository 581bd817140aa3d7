from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from phonolake.functions import ipa, phones, text, vocabulary


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_nfd_is_pythons(spark):
    words = ["é", "e", "ç", "Å", "한", "ɪ̈", "", "naïve ﬁ", "𝅘𝅥𝅮", None]
    got = [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.nfd(F.col("w")).alias("x")).collect()]
    assert got == [None if w is None else unicodedata.normalize("NFD", w) for w in words]


@pytest.mark.parametrize("raw,normalized,rules", [
    ("ˈt ʃ ˌpʰ r g", "t͡ʃ p ɹ ɡ", "latin_g_to_ipa_g;untied_tesh_to_tied;r_to_english_approximant;strip_stop_aspiration;strip_stress_mark"),
    ("ˈd ʒ ˌkʰ ɫ", "d͡ʒ k l", "untied_dezh_to_tied;dark_l_to_l;strip_stop_aspiration;strip_stress_mark"),
    ("p a", "p a", ""),
    ("ɚ ɝ", "ə˞ ɜ˞", "rhotic_schwa_decompose"),
    ("t͜ʃ", "t͡ʃ", "tie_bar_below_to_above"),
    ("ʈʂʰ ɖ ʐ", "t͡ʃ d͡ʒ", "eng_retroflex_to_tesh;eng_retroflex_to_dezh"),
])
def test_normalization(spark, raw, normalized, rules):
    df = spark.createDataFrame([(raw,)], "t string")
    row = ipa.normalize_with_audit(df, "t", "r").select("r.*").first()
    assert (row.normalized, ";".join(row.rule_ids), row.changed) == (normalized, rules, raw != normalized)
    assert df.select(ipa.normalize(F.col("t")).alias("x")).first().x == normalized


def test_unknown_profile():
    with pytest.raises(ValueError, match="unsupported"):
        ipa.normalize(F.lit("a") if False else None, "other")


def test_looks_like_ipa(spark):
    cases = {"": True, "  ": True, "hello": False, "p ɪ n": True, "p t k": True, "p": False, "x y": False, "ˈa": True, "é": True, None: False, "1 2": False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ipa.looks_like_ipa(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


@pytest.mark.parametrize("raw,expected", [
    ("o ʊ", "oʊ"), ("t͡s", "t s"), ("p [PAD] # ʰ aɪ", "p aɪ"), ("pəʤɑməz", "p ʌ d͡ʒ ɑ m ʌ z"), ("ɾ", "t"), ("ç", "k"), ("", ""), ("§", ""), ("dz ɡ͡b", "d z ɡ b"),
    ("ɝ n̩", "ə˞ n"), ("<unk> | ▁ 1 2", ""),
])
def test_projection(spark, raw, expected):
    got = one(spark, F.array_join(phones.project_tokens(phones.segment(F.col("t"))), " "), t=raw)
    assert got == expected


def test_the_tree_finds_the_longest_token():
    import random
    import re

    plain = re.compile("|".join(map(re.escape, phones.SCAN_TOKENS)))
    tree = re.compile(phones.SCAN_PATTERN)
    r = random.Random(2)
    alphabet = sorted(set("".join(phones.SCAN_TOKENS))) + ["§", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(phones.SCAN_TOKENS) if r.random() < 0.5 else r.choice(alphabet) for _ in range(r.randint(1, 12)))
        assert tree.findall(t) == plain.findall(t), t


def test_inventory_is_complete():
    assert len(set(phones.INVENTORY)) == 39
    assert {p for v in phones.PHONES_OF.values() for p in v} == set(phones.INVENTORY)
    assert len(set(phones.CODES.values())) == 39


def test_skipped_spans(spark):
    assert one(spark, F.array_join(phones.skipped_spans(F.col("t")), "+"), t="p§¤a¢") == "§¤+¢"


def test_arpabet(spark):
    assert phones.IPA_OF_ARPABET["NX"] == "ɾ̃"
    got = one(spark, F.array_join(phones.from_arpabet(F.split("t", " ")), " "), t="HH AW1 S")
    assert got == "h aʊ s"
    assert one(spark, F.array_join(phones.to_arpabet(F.split("t", " ")), " "), t="h aʊ ?") == "HH AW ?"


def test_ctc_collapse(spark):
    got = spark.sql("select array(1,1,0,1,2,2,0,0,3) a").select(text.ctc_collapse(F.col("a"), 0).alias("x")).first().x
    assert got == [1, 1, 2, 3]


def test_small_functions(spark):
    assert one(spark, text.language_of(F.col("t")), t="<eng><test>") == "eng"
    assert one(spark, text.language_of(F.col("t")), t="<eng>") == "eng>"
    assert one(spark, text.clean_text(F.col("t")), t=" ˈg, ɚ b!\n") == "ɡə˞b"
    assert one(spark, text.clean_response(F.col("t")), t="a g.\tb") == "aɡb"
    assert one(spark, text.coordinate(F.col("t")), t="23.5 S") == -23.5
    assert one(spark, text.coordinate(F.col("t")), t="-7 west") == -7.0
    assert one(spark, text.coordinate(F.col("t")), t="none") is None
    assert one(spark, text.json_answer(F.col("t"), "a"), t='so {"a": "x"} end') == "x"
    assert one(spark, text.json_answer(F.col("t"), "b"), t='so {"a": "x"} end') == '{"a": "x"}'
    assert one(spark, text.json_answer(F.col("t"), "a"), t="none") == "none"
    assert one(spark, text.reported_mean(F.col("t")), t=r" \ms{85.2}{1.3} ") == 85.2
    assert one(spark, text.reported_mean(F.col("t")), t=" 7.5 ") == 7.5
    assert one(spark, text.reported_name(F.col("t")), t=r"\textbf{Big} model") == "Big model"
    assert one(spark, text.mime_type(F.col("t")), t="a/b.bin9") == "application/octet-stream"
    assert one(spark, text.six_digits(F.col("t")), t="PIN 560001.") == "560001"
    assert one(spark, text.six_digits(F.col("t")), t="12") is None
    assert one(spark, text.mime_type(F.col("t")), t="a/b.MP3") == "audio/mpeg"
    assert one(spark, text.json_or_raw(F.col("t"), "k"), t="plain") == "plain"
    assert one(spark, text.json_in_braces(F.col("t")), t='so {"a": {}} end') == '{"a": {}}'
    assert one(spark, text.last_segment(F.col("t")), t="<a>b>c") == "c"
    assert one(spark, text.says_no_audio(F.col("t")), t="Please attach  the audio first") is True
    assert one(spark, text.render_template("{a}-{b}", {"a": F.col("t"), "b": F.lit(None)}), t="x") == "x-"
    with pytest.raises(KeyError):
        text.render_template("{c}", {})


def test_thoughts(spark):
    def both(t):
        df = spark.createDataFrame([(t,)], "t string")
        a, b = text.thought_split(F.col("t"))
        return tuple(df.select(a, b).first())

    assert both("x <think>y</think> z") == ("x  z", "y")
    assert both("x <think>y") == ("x", "y")
    assert both(" x ") == ("x", "")
    assert both("<think>a</think>b</think>c") == ("b</think>c", "a")


def test_vocabularies(spark):
    v = vocabulary.phone_vocabulary(["b", "a"])
    assert v == {"<blank>": 0, "a": 1, "b": 2, "<unk>": 3}
    with pytest.raises(ValueError, match="repeated"):
        vocabulary.phone_vocabulary(["a", "a"])
    row = spark.sql("select array('a','z') t").select(vocabulary.encode(F.col("t"), v, 3).alias("e")).first()
    assert row.e == [1, 3]
    chars = vocabulary.character_vocabulary(spark.createDataFrame([("ba",), ("b",)], "t string"), "t").collect()
    assert {r.token: (r.id, r.n) for r in chars} == {"a": (4, 1), "b": (5, 2)}


def wave_bytes(samples, rate=16000, channels=1):
    import io
    import wave

    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    from phonolake.functions import audio

    rows = [(wave_bytes([0] * 160),), (wave_bytes([16384, -16384] * 100, channels=2),), (wave_bytes([0, 8192] * 50, rate=8000),), (b"none",), (None,)]
    df = spark.createDataFrame(rows, "w binary").select("w", audio.decoder()(F.col("w")).alias("x"), audio.wave_frames(F.col("w")).alias("n"))
    out = df.collect()
    assert [None if r.x is None else len(r.x) for r in out] == [160, 100, 200, None, None]
    assert [r.n for r in out] == [160, 100, 100, None, None]
    assert set(out[1].x) == {0.0} and max(out[2].x) == 0.25
    assert len(audio.decode(wave_bytes([1] * 32000), seconds=0.5)) == 8000


def test_checks(spark):
    from phonolake.operators import tables

    df = spark.range(3)
    assert tables.all_or_error(df, F.col("id") < 3, "too large").count() == 3
    with pytest.raises(Exception, match="too large"):
        tables.all_or_error(df, F.col("id") < 2, "too large").collect()
