from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from phonolake.functions import ipa
from phonolake.plans import evaluation
from phonolake.sinks import files as sinks
from phonolake.sources import kaldi, predictions, tables
from phonolake.streaming import incremental


@pytest.fixture
def corpus(tmp_path):
    for name, body in {
        "wav.scp": "utt1 sample/utt1.wav\nutt2 a/b/x.wav:12\nbad\nutt1 sample/later.wav\n", "text.good": "utt1 h  aw s\nutt2 b\nextra z\n",
        "text.lang": "utt1 <eng><test>\nutt2 <spa><x>\n", "text.canonical": "utt1 h  aʊ s\nutt2\n\n",
    }.items():
        (tmp_path / name).write_text(body)
    return tmp_path


def test_kaldi(spark, corpus):
    rows = {r.utt_id: r for r in kaldi.read_corpus(spark, str(corpus)).collect()}
    assert set(rows) == {"utt1", "utt2"}
    assert (rows["utt1"].text, rows["utt1"].language, rows["utt1"].canonical) == ("h aw s", "eng", "h aʊ s")
    assert rows["utt1"].wav_path == f"{corpus}/sample/later.wav" and rows["utt2"].wav_path.endswith("a/b/x.wav:12")
    kept = {r.utt_id: r.text for r in kaldi.read_canonical(spark, f"{corpus}/text.canonical").collect()}
    assert kept == {"utt1": "h  aʊ s", "utt2": ""}
    assert kaldi.read_optional_text(spark, f"{corpus}/none", "x").count() == 0
    with pytest.raises(FileNotFoundError):
        kaldi.read_optional_text(spark, f"{corpus}/none", "x", required=True)
    (corpus / "text.lang").write_text("utt1 <eng><test>\n")
    with pytest.raises(ValueError, match="language"):
        kaldi.read_corpus(spark, str(corpus))


def line(key, text, utt, target="p ʈ a", canonical="p t ɑ", lang="eng"):
    pred = [{"processed_transcript": text, "predicted_transcript": text}] if text is not None else []
    return json.dumps({key: {"pred": pred, "passthrough": {"utt_id": utt, "lang_sym": lang, "target": target, "canonical_ipa": canonical}}}, ensure_ascii=False)


@pytest.fixture
def run_folder(tmp_path):
    (tmp_path / "prediction.0.jsonl").write_text(line("0", "old", "u0") + "\n" + "{broken\n" + line("1", None, "u1") + "\n")
    (tmp_path / "prediction.1.jsonl").write_text(line("0", "p tʰ ɑ", "u0") + "\n\n")
    (tmp_path / "prediction.errors.0.jsonl").write_text(line("9", "x", "u9") + "\n")
    return tmp_path


def test_shards_merge_and_score(spark, run_folder):
    rows = {r.sample_key: r for r in predictions.read_shards(spark, str(run_folder)).collect()}
    assert set(rows) == {"0", "1"} and rows["0"].pred[0].processed_transcript == "p tʰ ɑ" and rows["1"].pred == []
    scored, summary, audit = evaluation.evaluate_folder(spark, str(run_folder))
    got = summary.first()
    assert (got.language, got.N, got.TA, got.FR) == ("eng", 2, 3, 3)
    fields = {(r.utt_id, r.field): r.normalized for r in audit.collect()}
    assert fields[("u0", "pred[0].processed_transcript")] == "p t ɑ" and ("u1", "passthrough.canonical_ipa") in fields
    with pytest.raises(Exception, match="malformed JSON"):
        predictions.parse_records(predictions.read_lines(spark, f"{run_folder}/*.jsonl"), strict=True).collect()


def test_normalized_rows_keep_the_raw_text(spark, run_folder):
    rows, _ = ipa.normalize_predictions(predictions.read_shards(spark, str(run_folder)))
    row = {r.sample_key: r for r in rows.collect()}["0"]
    assert (row.pred[0].processed_transcript_raw, row.pred[0].processed_transcript) == ("p tʰ ɑ", "p t ɑ")
    assert row.passthrough.canonical_ipa_raw == "p t ɑ" and row.normalization_profile == ipa.PROFILE


def test_error_logs_of_a_folder(spark, run_folder):
    (run_folder / "prediction.errors.0.jsonl").write_text(json.dumps({"key": "u1", "error": {"type": "E"}}) + "\n")
    evaluation.check_folder(spark, str(run_folder))
    for bad in ("u0", "u7"):
        (run_folder / "prediction.errors.1.jsonl").write_text(json.dumps({"key": bad}) + "\n")
        with pytest.raises(ValueError, match=bad):
            evaluation.check_folder(spark, str(run_folder))


def test_flat_and_merged_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"pred": [], "passthrough": {"utt_id": "f"}}\n' + line("3", "p", "k") + "\n")
    got = sorted((r.sample_key or "", r.passthrough.utt_id) for r in predictions.read_predictions(spark, f"{tmp_path}/a.jsonl").collect())
    assert got == [("", "f"), ("3", "k")]
    (tmp_path / "m.json").write_text(line("5", "p", "m"))
    assert predictions.read_merged(spark, f"{tmp_path}/m.json").first().passthrough.utt_id == "m"
    kinds = {r.kind for r in predictions.discover(spark, str(tmp_path)).collect()}
    assert kinds == {"merged"}


def test_tables(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿WORD,FILE_NAME\nyes,f1\n", encoding="utf-8")
    assert tables.read_csv(spark, f"{tmp_path}/w.csv", "WORD string, FILE_NAME string").first().WORD == "yes"
    (tmp_path / "t.json").write_text(json.dumps([{"split": s, "text": s} for s in ("train", "dev", "test", "other")]))
    got = tables.read_transcripts(spark, f"{tmp_path}/t.json", "split string, text string")
    assert sorted(r.split for r in got.collect()) == ["test", "train", "val"]
    with pytest.raises(KeyError):
        tables.Catalogue({}).paths("x")
    spark.range(10).write.parquet(f"{tmp_path}/p1")
    assert tables.read_fields(spark, [f"{tmp_path}/p1", f"{tmp_path}/p1"], ["id"], per_file=3).count() == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "sample_key string, v double")
    sinks.write_shards(df, f"{tmp_path}/s")
    assert json.loads(spark.read.text(f"{tmp_path}/s").first().value) == {"a": {"v": 1.5}}
    sinks.append_summary(df, f"{tmp_path}/sum")
    sinks.append_summary(df, f"{tmp_path}/sum")
    assert spark.read.parquet(f"{tmp_path}/sum").count() == 2
    assert "| v | 1.5000 |" in sinks.markdown_report(df, "run")


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = [("x", f"u{i}", "p t", "p k" if i % 2 else "p t", "p t") for i in range(4)]
    schema = "language string, utt_id string, prediction string, transcription string, canonical string"
    spark.createDataFrame(rows, schema).write.json(f"{tmp_path}/in")
    for _ in range(2):
        incremental.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("x", "u0", "p", "p t", "p t")], schema).write.mode("append").json(f"{tmp_path}/in")
    incremental.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = incremental.current(spark, f"{tmp_path}/out")
    assert got.count() == 4 and {r.utt_id: r.per_errors for r in got.collect()} == {"u0": 1, "u1": 1, "u2": 0, "u3": 1}
    assert got.where(F.col("utt_id") == "u0").first().h == ["p"]
