from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from phonolake import schemas
from phonolake.functions import ipa, text, vocabulary
from phonolake.operators import geolocation, labels, merge, scoring, splits, tables
from phonolake.sinks import files as sinks
from phonolake.sources import predictions
from phonolake.sources import tables as sources


def test_neighbours(spark):
    rows = [("u", i, s, e) for i, (s, e) in enumerate([("a", 1), ("b", 0), ("a", 0), ("a", 1), ("c", 1)])] + [("v", 0, "a", 1)]
    df = spark.createDataFrame(rows, "u string, o int, s string, e int")
    out = merge.neighbours(df, "u", "o", 1, F.col("e") == 1, F.col("e") >= 0, F.concat_ws(":", "s", "o"), ["s"]).orderBy("u", "o").collect()
    assert [(r.near_labels, r.found_in_group) for r in out] == [("", True), (None, None), (None, None), ("a:2", True), ("", False), ("", False)]


def test_runs(spark):
    runs = spark.createDataFrame([("r1", "m", 1), ("r2", "m", 3), ("r3", "n", 2)], "run string, model string, t int")
    assert [r.run for r in tables.pending_runs(runs, runs.where("run = 'r2'"), "run", "t").collect()] == ["r3", "r1"]
    assert {r.model: r.run for r in tables.latest_run(runs, ["model"], "t", "run").collect()} == {"m": "r2", "n": "r3"}


def test_places(spark):
    df = spark.createDataFrame([(10.0, 20.0), (30.0, 200.0), (None, 5.0)], "lat double, lon double")
    assert [r.v for r in df.select(geolocation.valid_degrees(F.col("lat"), F.col("lon")).alias("v")).collect()] == [True, False, False]
    e = geolocation.extent(df, "lat", "lon").first()
    assert (e.min_lat, e.max_lon, e.mean_lat) == (10.0, 200.0, 20.0)
    one = spark.range(1)
    assert one.select(geolocation.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("x")).first().x == pytest.approx(math.pi / 2 * 6371.0)
    assert one.select(geolocation.angular_loss(F.lit(1.0)).alias("x")).first().x == pytest.approx(math.acos(1 - 1e-7))
    k = 2.0
    density = k / (2 * math.pi * (math.exp(k) - math.exp(-k))) * math.exp(k * 0.5)
    assert one.select(geolocation.vmf_loss(F.lit(k), F.lit(0.5)).alias("x")).first().x == pytest.approx(-math.log(density))


def test_responses(spark):
    df = spark.createDataFrame([((None, None, [([("a",), ("b",)],)],),), ((None, "out", None),), (("t", "out", None),)], "r struct<text: string, output_text: string, candidates: array<struct<parts: array<struct<text: string>>>>>")
    shaped = df.select(F.struct("r.text", "r.output_text", F.transform("r.candidates", lambda c: F.struct(F.struct(c["parts"].alias("parts")).alias("content"))).alias("candidates")).alias("r"))
    assert [r.x for r in shaped.select(text.result_text(F.col("r")).alias("x")).collect()] == ["ab", "out", "t"]


def test_more_text(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x

    t = F.col("t")
    assert one(text.clean_response(t, fix_g=False), "a g") == "ag" and one(text.clean_response(t, fix_rhotics=True), "ɚ") == "ə˞"
    assert one(text.unicode_names(t), "aˈ") == "a: LATIN SMALL LETTER A; ˈ: MODIFIER LETTER VERTICAL LINE"
    assert one(text.speaker_of_path(t), "x/spk7/u.wav") == "spk7"
    assert one(text.clean_token(t), " ˈa! ") == "a"
    assert one(F.array_join(text.without_special(F.split(t, " "), ["<s>"]), " "), "<s> a <s>") == "a"
    assert one(ipa.is_ascii_phone(t), " p ") is True and one(ipa.is_ascii_phone(t), "x") is False
    assert one(text.first_number(t), "about -3.5 km") == "-3.5"
    key, rest = text.key_and_rest(t)
    assert (one(key, "  k   a  b "), one(rest, "  k   a  b "), one(rest, "k")) == ("k", "a  b", "")


def test_more_vocabulary(spark):
    v = vocabulary.phone_vocabulary(["a", "b"])
    row = spark.sql("select array(1, 0, 2) i, array('a', 'b', 'c') t, cast(array() as array<string>) e").select(
        vocabulary.decode(F.col("i"), v, skip=(0,)).alias("d"), vocabulary.truncated(F.col("t"), 2).alias("u"), vocabulary.truncated(F.col("e")).alias("q"), vocabulary.in_slashes(F.col("t")).alias("s"),
    ).first()
    assert (row.d, row.u, row.q, row.s) == (["a", "b"], ["a", "b"], ["?"], ["/a/", "/b/", "/c/"])


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("k1", "x", 1), ("k2", "y", 2)], "sample_key string, lang string, n int")
    sinks.write_table(df, f"{tmp_path}/t", ["lang"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/t").count() == 2
    sinks.write_merged(df, df, df, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m/transcription.normalized").count() == 2
    sinks.write_requests(df.withColumn("a", F.lit("x.wav")), f"{tmp_path}/b", "sample_key", text.render_template("say {l}", {"l": F.col("lang")}), "a")
    assert {r.request.parts[0].text for r in spark.read.json(f"{tmp_path}/b/requests").collect()} == {"say x", "say y"}
    (tmp_path / "spk").mkdir()
    (tmp_path / "spk" / "u_M5.wav").write_bytes(b"RIFF")
    found = sources.list_recordings(spark, str(tmp_path)).collect()
    assert [(r.speaker, r.name, r.length) for r in found] == [("spk", "u_M5", 4)]
    kept = spark.createDataFrame([("a_M5", 9000), ("b", 9000), ("c", 100)], "n string, f int")
    assert [r.n for r in kept.where(sources.keep_microphone(F.col("n"), ["c"]) & sources.long_enough(F.col("f"))).collect()] == ["a_M5"]
    (tmp_path / "bad.jsonl").write_text('{"utt_id": "a"}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        predictions.read_json_lines(spark, f"{tmp_path}/bad.jsonl", "utt_id string").collect()


def test_guesses_and_macro(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    ints = {r.guess: r.n for r in splits.chance_predictions(df, "k", "int", 1, 0, 3).groupBy("guess").agg(F.count("*").alias("n")).collect()}
    assert set(ints) == {0, 1, 2, 3} and min(ints.values()) > 400
    place = splits.chance_predictions(df, "k", "place", 1).select("guess.*").agg(F.max(F.abs("lat")).alias("a"), F.max(F.abs("lon")).alias("b")).first()
    assert place.a <= math.pi / 2 and place.b <= math.pi
    assert splits.first_n(df, "k", 3).count() == 3 and [len(b) for b in splits.batches(7, 3)] == [3, 3, 1]
    s = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", None)], "l string, PER double")
    assert scoring.macro_average(s, ["PER"]).first().PER == 2.0
    assert labels.log_weighted_mean(spark.createDataFrame([(1.0, 10), (3.0, 10)], "s double, n int"), "s", "n").first().weighted_mean == pytest.approx(2.0)


def test_schemas_parse(spark):
    for ddl in (schemas.KALDI_TEXT, schemas.MANIFEST, schemas.BATCH_RESULT, schemas.SCORING, schemas.AUDIT, schemas.SPEAKER_META, schemas.WORD_LIST, schemas.TIME_ALIGNED):
        assert spark.createDataFrame([], ddl).columns


def test_code_points_above_the_basic_plane(spark):
    from phonolake.functions import text

    row = spark.createDataFrame([("a\U0001F600é",)], "t string").select(text.code_points(F.col("t")).alias("p")).first()
    assert row.p == "U+0061 U+1F600 U+00E9"


def test_texts_read_by_their_parts(spark):
    from phonolake.functions import phones, text

    answer = '{"NBest": [{"Words": [{"Phonemes": [{"Phoneme": "h"}, {"Phoneme": "aw"}]}, {"Word": "x"}, {"Phonemes": [{"Phoneme": "s"}]}]}]}'
    df = spark.createDataFrame([("HHAH0LOW1", "HH AA T", "a/b/C07_s1_x.wav", answer, "{}")], "a string, b string, p string, j string, e string")
    row = df.select(
        phones.read_arpabet(F.col("a")).alias("a"), phones.read_arpabet(F.col("b")).alias("b"), text.conversation_of_path(F.col("p")).alias("c"),
        text.best_phonemes(F.col("j")).alias("j"), text.best_phonemes(F.col("e")).alias("e"), text.run_tag(F.lit("2024-01-31 23:59:59").cast("timestamp")).alias("t"),
    ).first()
    assert row.a == ["h", "ʌ", "l", "oʊ"] and row.b == ["h", "ɑ", "t"] and row.c == "C07" and (row.j, row.e) == ("h aw s", "") and row.t == "20240131_235959"


def test_lines_of_large_files_keep_their_order(spark, tmp_path):
    from phonolake.sources import kaldi

    lines = [f"utt{i % 700} text {i}" for i in range(20_000)]
    (tmp_path / "text").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = kaldi.read_text(spark, f"{tmp_path}/text")
        assert spark.read.text(f"{tmp_path}/text").rdd.getNumPartitions() > 4
        got = {r.utt_id: r.text for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(x.split(" ", 1) for x in lines)


def test_small_reports(spark, tmp_path):
    from phonolake.operators import features
    from phonolake.sinks import files

    one = spark.createDataFrame([("a", 1.5)], "run string, per double")
    path = f"file://{tmp_path}/summary.csv"
    files.append_summary_csv(one, path)
    files.append_summary_csv(one.select("per", F.lit("b, c").alias("run")), path)
    assert (tmp_path / "summary.csv").read_text() == 'run,per\na,1.5\n"b, c",1.5\n'
    assert (tmp_path / "summary.csv.txt").read_text() == "run: a\nper: 1.5\n\nrun: b, c\nper: 1.5\n\n"
    with pytest.raises(ValueError, match="columns"):
        files.append_summary_csv(one.withColumn("more", F.lit(1)), path)
    assert '"rows"' in files.json_report(one, run="x") and '"per": 1.5' in files.json_report(one)
    counts = spark.createDataFrame([("TA", "none", 5), ("FA", "deletion", 1), ("FA", "substitution", 2)], "bucket string, actual_error_type string, n long")
    assert files.slot_summary(counts) == "slots: 8\nTA: 5 (none 5)\nFA: 3 (substitution 2, deletion 1)\n"
    results = spark.createDataFrame([("1", "p", None), ("2", "", "bad")], "key string, processed_transcript string, error string")
    assert files.read_cache(spark, f"{tmp_path}/cache") is None
    for k in range(2):
        files.write_cache(results.withColumn("processed_transcript", F.concat("processed_transcript", F.lit(str(k)))), f"{tmp_path}/cache")
    assert [(r.key, r.processed_transcript) for r in files.read_cache(spark, f"{tmp_path}/cache").collect()] == [("1", "p1")]
    rates = spark.createDataFrame([(1.0, 4), (3.0, 4)], "d double, n long").agg(*features.feature_rates("d", "n")).first()
    assert (rates.FED, rates.FER, rates.PFER) == (4.0, 50.0, 2.0)


def test_places_by_cells_give_the_rate_of_all_pairs(spark):
    rows = [(i, math.cos(i * 0.7), math.sin(i * 0.7), math.sin(i * 1.3), math.radians((i * 37) % 120 - 60), math.radians((i * 53) % 300 - 150)) for i in range(150)]
    # predictions near their targets, copies, and a cluster of places around one point
    rows += [(i, *geo_unit(lat, lon + 0.01 * (i % 4)), lat, lon) for i in range(150, 260) for lat, lon in [(0.3 + (i % 40) * 1e-4, 1.0 + (i % 37) * 1e-4)]]
    df = spark.createDataFrame(rows, "key long, x double, y double, z double, lat double, lon double")
    places = sorted({(round(r[4], 6), round(r[5], 6)) for r in rows})

    def nearer(r):
        own = (round(r[4], 6), round(r[5], 6))
        score = lambda g: sum(p * q for p, q in zip(r[1:4], geo_unit(*g), strict=True))
        return sum(score(g) > score(own) or (score(g) == score(own) and g < own) for g in places)

    for k, leaf in ((5, 64), (5, 3), (1, 8)):
        want = 100.0 * sum(nearer(r) >= k for r in rows) / len(rows)
        assert 0 < want < 100
        assert geolocation.miss_rate(df, k, "key", "x", "y", "z", "lat", "lon", leaf=leaf).first().miss_rate == pytest.approx(want)
    assert geolocation.miss_rate(df, len(places), "key", "x", "y", "z", "lat", "lon").first().miss_rate == 0.0


def geo_unit(lat, lon):
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def test_whole_conversations_fill_the_splits(spark):
    rows = [(c, f"l{c % 4 if c < 400 else 9}") for c in range(406) for _ in range(1 + c % 7)]
    out = splits.conversation_split(spark.createDataFrame(rows, "c long, l string"), "c", "l")
    assert out.count() == len(rows) and out.where("split is null").count() == 0
    assert out.groupBy("c").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("l = 'l9'").select("split").distinct().count() == 3
    share = {r.split: r.n / len(rows) for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["val"] - 0.15) < 0.02 and abs(share["test"] - 0.15) < 0.02
