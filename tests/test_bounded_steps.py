"""Steps whose memory, disk or tasks must not grow with a batch, a table's levels or its splits."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from phonolake.operators import align, align_batch
from phonolake.session import spread


def _ragged(rng, sizes, symbols):
    return align_batch.Ragged.of([rng.integers(1, symbols + 1, n) for n in sizes])


def test_joint_alignment_of_long_rows_holds_few_places():
    columns = [_ragged(np.random.default_rng(3), [420], 9) for _ in range(3)]
    tracemalloc.start()
    (rows,) = align_batch.joint(*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for row, column in zip(rows, columns, strict=True):
        assert row[row != 0].tolist() == column.row(0).tolist()
    assert peak < 150e6


@pytest.mark.parametrize("cells", [align_batch._CELLS, 300])
def test_joint_alignment_in_stretches(monkeypatch, cells):
    monkeypatch.setattr(align_batch, "_CELLS", cells)
    rng = np.random.default_rng(5)
    columns = [_ragged(rng, rng.integers(0, 9, 12), 3) for _ in range(3)]
    for k, rows in enumerate(align_batch.joint(*columns)):
        own = [[str(x) for x in c.row(k)] for c in columns]
        want = align.align_joint(*own)
        assert [tuple("-" if x == 0 else str(x) for x in r) for r in zip(*rows, strict=True)] == [tuple(r) for r in want]


def test_batches_are_worked_on_in_pieces(monkeypatch):
    monkeypatch.setattr(align_batch, "_SYMBOLS", 10)
    a = pa.array([["x"] * n for n in (3, 0, 4, 30, 1)] + [None], pa.list_(pa.string()))
    b = pa.array([["y"] * n for n in (3, 1, 4, 1, 1)] + [["z"]], pa.list_(pa.string()))
    found = list(align_batch.pieces(iter([(a, b)])))
    assert [len(x) for x, _ in found] == [2, 1, 1, 2]
    assert pa.concat_arrays([x for x, _ in found]).equals(a) and pa.concat_arrays([y for _, y in found]).equals(b)


def test_rows_of_one_group_are_spread(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        df = spark.read.parquet(f"file://{tmp_path}/t")
        assert df.rdd.getNumPartitions() >= 4
        sizes = spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= 4 and max(sizes) < 1500


def test_three_sequences_are_projected_in_two_steps_of_python(spark):
    from phonolake.operators import scoring

    df = spark.range(3).selectExpr("'k æ t' AS canonical", "'k ɾ' AS transcription", "'ɾ a' AS prediction")
    out = scoring.project_triplet(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2
    assert out.first()["u"] == ["k", "t"]


def test_equal_utterances_are_searched_once(monkeypatch):
    from phonolake.operators import decoding

    sizes, real = [], decoding.search
    monkeypatch.setattr(decoding, "search", lambda frames, *a: sizes.append(len(frames)) or real(frames, *a))
    monkeypatch.setattr(decoding.F, "arrow_udf", lambda kind: lambda f: lambda column: f)
    run = decoding.nbest(_Uncast(), 4, 2)
    frame, other = [[-0.1, -2.4]], [[-2.4, -0.1]]
    found = run(pa.array([frame, other, None, frame, frame], pa.list_(pa.list_(pa.float64())))).to_pylist()
    assert sizes == [2] and found[0] == found[3] == found[4] != found[1] and found[2] is None


class _Uncast:
    def cast(self, kind):
        return self
