"""Caches of workers, keys that outlive an order of rows, and which exceptions are retried."""

from __future__ import annotations

import json

import pytest

from phonolake.operators import apply
from phonolake.sources import predictions


def put(path, *records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def one(key, text, **more):
    return {"key": key, "pred": [{"processed_transcript": text, **more}]}


def test_caches_of_all_workers(spark, tmp_path):
    put(tmp_path / "a[b].x.jsonl", one("k", "own"), one("only", "own"))
    put(tmp_path / "a[b].x.0.2.jsonl", one("k", "w0"), one("k", "w0 again"), "broken", {"key": "", "pred": [{}]}, {"key": "e", "pred": []}, {"pred": [{}]}, "[]", "")
    put(tmp_path / "a[b].x.1.2.jsonl", one("bad", "", error={"type": "T", "message": "m"}), one("none", None))
    put(tmp_path / "a[b].x.1.z.jsonl", one("z", "no worker"))
    put(tmp_path / "b.x.0.2.jsonl", one("z", "another run"))
    want = {"k": "own", "only": "own", "bad": "", "none": ""}
    for name in ("a[b].x.jsonl", "a[b].x.1.2.jsonl", "a[b].x.7.9.jsonl"):
        rows = {r.key: r for r in predictions.read_worker_caches(spark, f"{tmp_path}/{name}").collect()}
        assert {k: r.processed_transcript for k, r in rows.items()} == want, name
        assert rows["bad"].error == ("T", "m") and rows["k"].error is None
    assert predictions.read_worker_caches(spark, f"{tmp_path}/none.jsonl").count() == 0


def test_cache_key(spark):
    df = spark.createDataFrame([(1, None, "w1", 5), (2, "u", "w2", None)], "idx long, utt_id string, wavpath string, own int")

    def keys(field, frame=df):
        return [r[0] for r in frame.orderBy("idx").select(apply.cache_key(frame, field)).collect()]

    with pytest.warns(RuntimeWarning, match="position"):
        assert keys("idx") == ["w1", "u"]
    assert keys("own") == ["5", "u"] and keys("missing") == ["w1", "u"] and keys("wavpath") == ["w1", "w2"]
    assert keys("idx", df.select("idx")) == ["1", "2"]
    with pytest.raises(ValueError, match="neither"):
        apply.cache_key(df.select("own"), "missing")


def test_resume_by_expressions(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "z")], "name string, text string")
    done = spark.createDataFrame([("a", "old", "", None), ("b", "", "", ("E", "e")), ("gone", "x", "", None), ("__error__", "", "", None)], apply.RESULT)

    def lengths(left):
        return left.selectExpr("name AS key", "string(length(text)) AS processed_transcript", "text AS predicted_transcript", "CAST(null AS struct<type: string, message: string>) AS error")

    found = apply.resume_by(df, done, "name", lengths)
    assert {r.key: (r.processed_transcript, r.predicted_transcript) for r in found.collect()} == {"a": ("old", ""), "b": ("1", "y"), "c": (None, None), "d": ("1", "z")}
    assert "Python" not in (plan := found._jdf.queryExecution().toString()) and "Pandas" not in plan
    assert apply.resume_by(df, None, "name", lengths).count() == 4


def test_transient_errors():
    def failed(**values):
        e = RuntimeError("x")
        e.__dict__.update(values)
        return e

    text, audio = apply.transient("text"), apply.transient("audio")
    assert text(failed(code=429)) and audio(failed(status_code=429)) and audio(failed(status=503))
    assert audio(failed(status_code=409)) and not text(failed(code=409))
    assert not text(failed(code=400)) and not audio(failed()) and not audio(ValueError())
    for e in (TimeoutError(), ConnectionResetError(), OSError()):
        assert text(e) and audio(e)
    pauses = []
    with pytest.raises(RuntimeError):
        apply.with_retry(lambda: (_ for _ in ()).throw(failed(code=400)), retryable=text, sleep=pauses.append)()
    assert not pauses
