"""The data source of shards, the running merge over its stream, and the walk of JSON documents."""

from __future__ import annotations

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonolake.operators import audit
from phonolake.sources import predictions, shards
from phonolake.streaming import running

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def line(key, text, lang="x"):
    return json.dumps({key: {"pred": [{"processed_transcript": text}], "passthrough": {"lang_sym": lang}}}, ensure_ascii=False)


def put(path, *lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + end)


def source(spark, folder, **options):
    spark.dataSource.register(shards.ShardSource)
    return spark.read.format(shards.NAME).options(**options).load(str(folder))


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n\nbb\r\nccc", b"\n\na\n", "é\nß\n".encode(), b"x" * 50 + b"\ny\n"])
def test_every_line_is_in_one_range(tmp_path, text):
    (tmp_path / "f").write_bytes(text)
    pieces = text.split(b"\n")
    want = [(sum(len(p) + 1 for p in pieces[:i]), p) for i, p in enumerate(pieces) if i + 1 < len(pieces) or p]
    for split in (1, 2, 3, 7, 100):
        got = []
        for task in shards.cut({"f": (0, len(text))}, split):
            for _, start, end in task.parts:
                with pa.OSFile(str(tmp_path / "f")) as stream:
                    got += shards.lines_of(stream, start, end)
        assert got == want


def test_small_files_share_a_task():
    tasks = shards.cut({f"f{i}": (0, 10) for i in range(10)}, 25)
    assert [sum(e - s for _, s, e in t.parts) for t in tasks] == [25, 25, 25, 25]
    assert sorted({f for t in tasks for f, _, _ in t.parts}) == [f"f{i}" for i in range(10)]


def test_last_line_break(tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "_BLOCK", 4)
    for text in (b"", b"abcdefghij", b"a\nbcdefghijkl", b"abc\ndef\n"):
        (tmp_path / "f").write_bytes(text)
        with pa.OSFile(str(tmp_path / "f")) as stream:
            assert shards.last_line_break(stream, len(text)) == text.rfind(b"\n") + 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"k": {"pred": []}}', [("k", '{"pred": []}')]), (' { "a\\u0062" : 1.50 } \r', [("ab", "1.50")]), ("{}", []), ('{"k": null}', [("k", "null")]),
        ('{"k": 1, "l": {"b": "é"}}', [("k", "1"), ("l", '{"b": "é"}')]), ('{"k": 1, "k": 2}', [("k", "2")]), ('{"pred": [], "k": 1}', [(None, '{"pred": [], "k": 1}')]),
        ('{"pred": null}', [("pred", "null")]), ('{"k": "a}"}', [("k", '"a}"')]),
    ],
)
def test_entries(text, want):
    assert shards.entries(text) == want


@pytest.mark.parametrize("text", ["[]", "1", "{", '{"k": 1} x', '{"k" 1}', '{"k": 1}}', '"k"'])
def test_malformed_entries(text):
    with pytest.raises(ValueError):
        shards.entries(text)


def test_source_equals_text_reader(spark, tmp_path):
    for i in range(3):
        rows = [line(f"k{j}", f"{i} {j} é\"\\", "y") for j in range(40) if j % 3 != i]
        put(f"{tmp_path}/s{i}.jsonl", *rows, "broken", "", end="")
    put(f"{tmp_path}/d.jsonl/part-0.txt", line("deep", "z"), json.dumps({"two": {"pred": []}, "more": {"passthrough": {"key": "q"}}}))
    put(f"{tmp_path}/s.errors.jsonl", line("k1", "no"))
    put(f"{tmp_path}/s.cache.jsonl", line("k1", "no"))
    put(f"{tmp_path}/note.txt", line("k1", "no"))
    want = sorted(map(repr, predictions.read_shards(spark, str(tmp_path)).collect()))
    for split in ("64", "100000"):
        assert sorted(map(repr, shards.read_shards(spark, str(tmp_path), split_bytes=split).collect())) == want
    assert source(spark, tmp_path, split_bytes="64").rdd.getNumPartitions() > 20


def test_flat_lines_have_no_key(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", json.dumps({"pred": [], "passthrough": {"key": "q"}}), json.dumps({"k": None}))
    rows = {r.sample_key: r for r in source(spark, tmp_path).collect()}
    assert json.loads(rows[None].record)["passthrough"] == {"key": "q"} and rows["k"].record == "null" and rows["k"].offset > 0


def test_empty_folders_and_files(spark, tmp_path):
    assert source(spark, tmp_path / "none").count() == 0
    (tmp_path / "e.jsonl").write_text("")
    assert source(spark, tmp_path).columns == ["file", "offset", "sample_key", "record"] and source(spark, tmp_path).count() == 0


def test_strict_names_the_place(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", line("k", "t"), "[1]")
    assert source(spark, tmp_path).count() == 1
    with pytest.raises(Exception, match=rf"a.jsonl at byte {len(line('k', 't')) + 1}"):
        source(spark, tmp_path, strict="true").collect()


def test_filters_on_keys_reach_the_source(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", *[line(f"k{i}", f'"k{i + 1}"') for i in range(9)], '{"\\u006b3": {"pred": []}}', "not JSON")
    plain = source(spark, tmp_path)
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        pushed = source(spark, tmp_path, pushdown="true")
        for keep in (F.col("sample_key") == "k3", F.col("sample_key").isin("k1", "k3", "zz"), (F.col("sample_key") == "k3") & (F.col("offset") > 300), F.col("sample_key").isNull()):
            assert sorted(pushed.where(keep).collect()) == sorted(plain.where(keep).collect())
        assert pushed.where("sample_key = 'k3'").count() == 2
        plans = [df.where("sample_key = 'k3'")._jdf.queryExecution().executedPlan().toString() for df in (plain, pushed)]
        assert "= k3" in plans[0] and "= k3" not in plans[1]  # the source has taken the filter
    finally:
        spark.conf.set(PUSHDOWN, before)


def sums(spark, tmp_path):
    rows = shards.stream_shards(spark, f"{tmp_path}/in", split_bytes="200").select(
        "file", "offset", "sample_key", F.col("rec.passthrough.lang_sym").alias("lang"), F.length(F.col("rec.pred")[0]["processed_transcript"]).alias("n_letters"),
    )
    running.start_sums(rows, "sample_key", "lang", ["n_letters"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    return {r.group: (r.n, r.n_letters) for r in running.current_sums(spark, f"{tmp_path}/out", ["n_letters"]).collect()}


def batch(spark, tmp_path):
    rows = shards.read_shards(spark, f"{tmp_path}/in").select(F.col("passthrough.lang_sym").alias("lang"), F.coalesce(F.length(F.col("pred")[0]["processed_transcript"]), F.lit(0)).alias("c"))
    return {r.lang: (r.n, r.c) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}


def test_running_merge_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    provider = spark.conf.get(running._PROVIDER)

    def some(n):
        return [line(f"k{rng.randrange(12)}", "t" * rng.randrange(9), rng.choice(["x", "y", None])) for _ in range(n)]

    put(f"{tmp_path}/in/b.jsonl", *some(20))
    assert sums(spark, tmp_path) == batch(spark, tmp_path)
    assert sums(spark, tmp_path) == batch(spark, tmp_path)  # nothing new
    put(f"{tmp_path}/in/a.jsonl", *some(20))  # a late file that is earlier in order
    put(f"{tmp_path}/in/b.jsonl", *some(10), line("k0", None), '{"new": {}}')  # a shard that grows
    put(f"{tmp_path}/in/c.jsonl", *some(5), "broken", line("k1", "unfinished"), end="")
    got = sums(spark, tmp_path)
    put(f"{tmp_path}/in/c.jsonl", "")
    got = sums(spark, tmp_path)
    assert got == batch(spark, tmp_path) and sum(n for n, _ in got.values()) == len({r.sample_key for r in shards.read_shards(spark, f"{tmp_path}/in").collect()})
    assert spark.conf.get(running._PROVIDER) == provider
    (tmp_path / "in" / "b.jsonl").write_text("\n")
    with pytest.raises(Exception, match="shorter"):
        sums(spark, tmp_path)


def walked(text, field):
    try:
        todo = [("$", json.loads(text))]
    except ValueError:
        return []
    out = []
    while todo:
        path, v = todo.pop()
        items = [(f"{path}.{k}", k, x) for k, x in v.items()] if isinstance(v, dict) else [(f"{path}[{i}]", None, x) for i, x in enumerate(v)] if isinstance(v, list) else []
        out += [(p, x) for p, k, x in items if k == field and isinstance(x, str)]
        todo += [(p, x) for p, _, x in items]
    return out


def test_walk_equals_plain_walk(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.randrange(4) if depth else 3
        if kind < 2:
            return {rng.choice(["f", 'q"é', "g", "x.y"]) + rng.choice(["", "f"]): made(depth - 1) for _ in range(rng.randrange(4))}
        return [made(depth - 1) for _ in range(rng.randrange(4))] if kind == 2 else rng.choice(["f", "", 'a"b\\', 1, 2.5, None, True, "é\u0001"])

    texts = [json.dumps(made(7), ensure_ascii=rng.random() < 0.5) for _ in range(150)] + [None, "", "bad", '"f"', "[]", '{"f": "top"}', '{"f": "top"}', '{"f": {"f": ["f", {"f": ""}]}}']
    df = spark.createDataFrame([(None if i == 0 else str(i), t, 1) for i, t in enumerate(texts)], "k string, j string, path int")
    for field in ("f", 'q"é', "x.yf", "none"):
        want = sorted((str(None if i == 0 else i), p, v) for i, t in enumerate(texts) if t is not None for p, v in walked(t, field))
        assert sorted((str(r.id), r.path, r.value) for r in audit.walk_json(df, "k", "j", field).collect()) == want
    assert audit.walk_json(df.limit(0), "k", "j", "f").count() == 0


def test_walk_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, '{"a": {"f": "1"}}'), (2, '{"f": "1", "f": "2"}')], "k long, j string")
    got = audit.walk_json(df, "k", "j", "f")
    assert [tuple(r) for r in got.collect()] == [(1, "$.a.f", "1")]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
