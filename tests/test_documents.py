"""One large JSON document in ranges of bytes."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.sinks import files
from phonolake.sources import documents, predictions, tables

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text("ab\"\\{}[],:\n é", max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("k\"}\\", max_size=3), x, max_size=3), max_leaves=12
)


def by_ranges(raw: bytes, size: int) -> list[bytes]:
    """The entries, by the scan's own rules: pieces end behind braces, a range has the pieces that begin in it."""
    pieces, at = [], 0
    for p in raw.split(b"}"):
        pieces.append((at, p + b"}"))
        at += len(p) + 1
    if not raw.endswith(b"}") or len(pieces) > 1 and pieces[-1][1] == b"}":
        pieces = pieces if pieces[-1][1] != b"}" else pieces[:-1]
    effects, ranges = {}, {}
    for at, p in pieces:
        k = at // size * size
        effects.setdefault(k, documents.Effect()).add(p)
        ranges.setdefault(k, []).append(p)
    known = documents.states(("f", k, e.flips, e.outside, e.inside) for k, e in effects.items())
    out, held = [], b""
    for k, own in sorted(ranges.items()):
        cutter = documents.Cutter(*known["f", k])
        cutter.over = k > 0 and known["f", k][1] <= 0 and not known["f", k][0]
        for p in own:
            for opened, text in cutter.feed(p):
                out.append(text if opened else held + text)
                held = b""
        if not cutter.over:
            held = b"".join(cutter.held) if cutter.opened else held + b"".join(cutter.held)
    return [x for x in out if x.strip()]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("k\"}\\é", max_size=4), VALUES, max_size=5) | st.lists(VALUES, max_size=5), st.integers(1, 60), st.sampled_from([None, 1]), st.booleans())
def test_entries_of_any_ranges(value, size, indent, ascii_only):
    raw = json.dumps(value, indent=indent, ensure_ascii=ascii_only).encode()
    got = by_ranges(raw, size)
    if isinstance(value, dict):
        merged = {}
        for entry in got:
            merged |= json.loads(b"{" + entry + b"}")
        assert merged == value
    else:
        assert [json.loads(x) for x in got] == value


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_a_file_of_many_ranges(spark, tmp_path, small_ranges):
    r = random.Random(2)
    data = {f"k{k} \"{{}}": {"pred": [{"processed_transcript": "".join(r.choice('ab"\\{}[], é\n') for _ in range(r.randint(0, 40)))}], "passthrough": {"utt_id": f"u{k}"}} for k in range(200)}
    data["long"] = {"pred": [{"processed_transcript": "no brace, " * 600}], "passthrough": {"utt_id": "}" * 3000}}
    (tmp_path / "m.json").write_text(json.dumps(data, ensure_ascii=False))
    entries = documents.read_entries(spark, f"{tmp_path}/m.json")
    assert entries.select("split").distinct().count() > 10
    got = {r["sample_key"]: (r["pred"][0]["processed_transcript"], r["passthrough"]["utt_id"]) for r in predictions.read_merged(spark, f"{tmp_path}/m.json").collect()}
    assert got == {k: (v["pred"][0]["processed_transcript"], v["passthrough"]["utt_id"]) for k, v in data.items()}


def test_arrays_empty_documents_and_repeated_keys(spark, tmp_path, small_ranges):
    rows = [{"split": s, "text": "x" * (100 * k)} for k, s in enumerate(["train", "TEST", "dev", "odd"] * 5)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2) + "\n")
    got = tables.read_transcripts(spark, f"{tmp_path}/a.json", "split string, text string")
    assert sorted((r.split, len(r.text)) for r in got.collect()) == sorted(({"TEST": "test", "dev": "val"}.get(r["split"], r["split"]), len(r["text"])) for r in rows if r["split"] != "odd")
    for text in ("{}", "[]", " { } \n", "[ ]"):
        (tmp_path / "e.json").write_text(text)
        assert documents.read_entries(spark, f"{tmp_path}/e.json").count() == 0
    (tmp_path / "r.json").write_text('{"a": {"pred": [], "passthrough": {"utt_id": "1"}}, "a": {"pred": [], "passthrough": {"utt_id": "2"}}}')
    assert [r.passthrough.utt_id for r in predictions.read_merged(spark, f"{tmp_path}/r.json").collect()] == ["2"]


def test_written_and_read(spark, tmp_path, small_ranges):
    rows = [(k, f"key \"{k}\\", json.dumps({"pred": [], "passthrough": {"utt_id": f"u{k},}}"}})) for k in range(60)]
    df = spark.createDataFrame(rows, "n long, key string, value string")
    files.write_document(df, f"{tmp_path}/object", "n", "key")
    got = predictions.read_merged(spark, f"{tmp_path}/object").collect()
    assert {(r.sample_key, r.passthrough.utt_id) for r in got} == {(k, f"u{n},}}") for n, k, _ in rows}
    assert json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(f"{tmp_path}/object").collect())).keys() == {k for _, k, _ in rows}
    files.write_document(df, f"{tmp_path}/array", "n")
    assert documents.read_entries(spark, f"{tmp_path}/array").count() == 60
