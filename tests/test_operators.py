from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from phonolake.operators import apply, audit, features, geolocation, inventory, labels, merge, scoring, slots, splits

SCORING = "language string, utt_id string, prediction string, transcription string, canonical string"
BUCKETS = [("x", "ta", "p t", "p t", "p t"), ("x", "fr", "p k", "p t", "p t"), ("x", "fa", "p t", "p k", "p t"), ("x", "cd", "p k", "p k", "p t"), ("x", "de", "p d", "p k", "p t")]


def test_all_buckets_and_formulas(spark):
    s = scoring.summarize(scoring.score_utterances(spark.createDataFrame(BUCKETS, SCORING), joint=True)).first()
    assert (s.TA, s.FR, s.FA, s.CD, s.DE, s.TR) == (6, 1, 1, 1, 1, 2)
    assert s.MDD_Precision == s.MDD_Recall == pytest.approx(1 / 3) and s.MDD_F1 == pytest.approx(1 / 3)
    assert s.Diagnostic_Accuracy == s.Diagnostic_Error_Rate == 0.5 and s.Overall_Diagnostic_Error_Rate == pytest.approx(0.3)
    assert s.True_Diagnostic_Accuracy == s.MDD_Recall
    assert s.Joint_TA == 6 and s.PER == pytest.approx(30.0) and (s.SUB, s.INS, s.DEL) == (pytest.approx(30.0), 0.0, 0.0)


def test_empty_run_and_missing_canonical(spark):
    s = scoring.summarize(scoring.score_utterances(spark.createDataFrame([], SCORING))).first()
    assert (s.N, s.PER, s.TR, s.MDD_Precision) == (0, 0.0, 0, None)
    bad = spark.createDataFrame([("x", "u9", "p", "p", " ")], SCORING)
    with pytest.raises(Exception, match="u9"):
        scoring.score_utterances(bad).collect()


def test_failed_prediction_is_all_deletions(spark):
    s = scoring.summarize(scoring.score_utterances(spark.createDataFrame([("x", "u", "", "p t", "p t")], SCORING))).first()
    assert (s.PER, s.DEL, s.FR) == (100.0, 100.0, 2)


def test_flaps_in_context(spark):
    df = spark.createDataFrame([("x", "u", "ɾ ɾ ɾ", "t ɾ k", "t d k")], SCORING)
    row = scoring.project_triplet(df).first()
    assert (row.h, row.u) == (["t", "d", "t"], ["t", "d", "k"])


def test_slots_and_suspects(spark):
    rows = slots.mark_suspects(slots.slot_rows(spark.createDataFrame([("x", "u", "p k t", "p t k", "p t t")], SCORING))).orderBy("row_order").collect()
    assert [r.prompted for r in rows if r.slot_type == "phone"] == ["p", "t", "t"]
    assert {r.bucket for r in rows} <= {"TA", "FR", "FA", "CD", "DE"}
    fa = [r for r in rows if r.bucket in ("FA", "DE") and r.uttered == "k"]
    assert fa and fa[0].global_match_elsewhere == "1" and fa[0].nearby_match_reason


def test_inventory(spark):
    df = spark.createDataFrame([(["a", "b", "a", "x"], ["a", "b", "c"])], "p array<string>, r array<string>")
    s = inventory.inventory_scores(df, "p", "r").first()
    assert (s.n_pred, s.n_ref, s.n_common) == (3, 3, 2)
    assert s.f1 == pytest.approx(2 / 3) and s.max_f1 == pytest.approx(0.8)


def test_label_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)], "t int, p int")
    m = labels.confusion(df, "p", "t")
    a = labels.accuracy_and_f1(m).first()
    assert a.n == 5 and a.accuracy == pytest.approx(0.6) and a.macro_accuracy == pytest.approx((0.5 + 1 + 0.5) / 3)
    assert labels.mean_absolute_error(m).first().mae == pytest.approx(0.6)
    o = sum((t - p) ** 2 for t, p in [(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)])
    ts, ps = [0, 0, 1, 2, 2], [0, 1, 1, 2, 0]
    e = sum((t - p) ** 2 for t in ts for p in ps) / 5
    assert labels.weighted_kappa(m).first().qwk == pytest.approx(1 - o / e)
    con = sum((ts[i] - ts[j]) * (ps[i] - ps[j]) > 0 for i in range(5) for j in range(i))
    dis = sum((ts[i] - ts[j]) * (ps[i] - ps[j]) < 0 for i in range(5) for j in range(i))
    ties_t = sum(ts[i] == ts[j] for i in range(5) for j in range(i))
    ties_p = sum(ps[i] == ps[j] for i in range(5) for j in range(i))
    assert labels.kendall_tau_b(m).first().kendall_tau == pytest.approx((con - dis) / math.sqrt((10 - ties_t) * (10 - ties_p)))


def test_constant_sides(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "t int, p double")
    assert labels.pearson(df, "p", "t").first().pearson is None
    assert labels.kendall_tau_b(labels.confusion(df.withColumn("p", F.col("p").cast("int")), "p", "t")).first().kendall_tau == 0.0


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([("0.5",), ("1.5",), ("2.5",), ("9",), ("x",)], "v string")
    assert [r.o for r in df.select(labels.ordinal(F.col("v"), 0, 4).alias("o")).collect()] == [0, 2, 2, 4, None]
    assert df.select(labels.ordinal(F.col("v"), 0, 4, clamp=False).alias("o")).collect()[3].o is None
    c = spark.createDataFrame([("3",), ("-1",), ("7",), ("a",), (None,)], "v string").select(labels.valid_class(F.col("v"), F.lit(1), 7).alias("c"))
    assert [r.c for r in c.collect()] == [3, None, None, None, None]


def test_geolocation(spark):
    pole = spark.createDataFrame([(1.0, 0.0, 0.0, math.pi / 2, 0.0)], "x double, y double, z double, lat double, lon double")
    assert geolocation.mean_distance_km(pole, "x", "y", "z", "lat", "lon").first().distance_km == pytest.approx(math.pi / 2 * 6378.1)
    schema = "k int, x double, y double, z double, lat double, lon double"
    swapped = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, math.pi / 2), (1, 0.0, 1.0, 0.0, 0.0, 0.0)], schema)
    args = ("k", "x", "y", "z", "lat", "lon")
    assert geolocation.miss_rate(swapped, 1, *args).first().miss_rate == 100.0
    assert geolocation.miss_rate(swapped, 2, *args).first().miss_rate == 0.0
    assert geolocation.miss_rate(swapped.limit(0), 1, *args).first().miss_rate == 0.0
    assert geolocation.mean_distance_km(swapped.limit(0), "x", "y", "z", "lat", "lon").first().distance_km == 0.0


def test_merge(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in merge.last_wins(df, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}
    with pytest.raises(ValueError, match="1 keys"):
        merge.require_subset(df, df.where("k = 'a'"), ["k"], "test")


def test_batch_results(spark):
    from phonolake import schemas

    manifest = spark.createDataFrame([("a", 0, "u1", "p", None), ("b", 1, "u2", "p", None)], schemas.MANIFEST)
    results = spark.createDataFrame([("a", ("t e s t", None, None), None)], schemas.BATCH_RESULT)
    rows = {r.key: r for r in merge.collect_batch_results(manifest, results).collect()}
    assert rows["a"].predicted_transcript == "t e s t" and rows["a"].error is None
    assert rows["b"].predicted_transcript == "" and rows["b"].error.type == "MissingBatchResult"
    with pytest.raises(ValueError, match="unknown to the manifest"):
        merge.collect_batch_results(manifest.where("key = 'b'"), results)


def test_error_log(spark):
    merged = spark.createDataFrame([("a", ""), ("b", "x")], "key string, processed_transcript string")
    merge.check_errors_represented(spark.createDataFrame([("a",)], "key string"), merged)
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            merge.check_errors_represented(spark.createDataFrame([(bad,)], "key string"), merged)


def test_splits(spark):
    df = spark.createDataFrame([(f"s{i % 10}", "g" if i % 2 else "h", i) for i in range(100)], "s string, g string, i int")
    one = splits.disjoint_speakers(df, "s", "g", ["S1"], 2)
    assert one.select("s", "split").distinct().count() == 10 and one.count() == 100
    assert {r.s for r in one.where("split = 'test'").collect()} == {"s1"}
    val = splits.carve_validation(one, "i", 0.1, 3)
    assert val.count() == 100 and val.where("split = 'val'").count() >= one.where("split = 'val'").count() + 1
    three = splits.conversation_split(df, "s", "g")
    assert three.where("split is null").count() == 0
    assert three.groupBy("split").agg(F.countDistinct("g").alias("n")).where("n < 2").count() == 0
    assert splits.few_shot(df, "g", "i", "all_class").count() == 2
    assert splits.few_shot(df, "g", "i", "k_class", 1).count() == 1
    assert splits.few_shot(df, "g", "i", "k_sample", 7).count() == 7
    chunks = {r.chunk: r.n for r in splits.chunk_ids(df, "i", 3).groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert chunks == {0: 34, 1: 34, 2: 32}
    masked = splits.mask_phones(spark.createDataFrame([("u", ["a"] * 50)], "u string, p array<string>"), "u", "p", 0.5).first().masked_phones
    assert masked[0] == "a" and "[NOISE]" in masked


def test_apply_loses_no_row(spark):
    def factory():
        def call(v, **_):
            if v == 2:
                raise RuntimeError("two")
            return [{"processed_transcript": str(v), "predicted_transcript": ""}]

        return call

    df = spark.createDataFrame([(f"item_{i}", i) for i in range(5)], "key string, v int")
    rows = {r.key: r for r in apply.run_on_rows(df, "key", factory).collect()}
    assert len(rows) == 5 and rows["item_2"].error.type == "RuntimeError" and rows["item_2"].processed_transcript == ""
    done = spark.createDataFrame([("item_0", "old", "", None), ("item_1", "", "", ("E", "e")), ("gone", "x", "", None)], apply.RESULT)
    again = {r.key: r.processed_transcript for r in apply.resume(df, done, "key", factory).collect()}
    assert again == {"item_0": "old", "item_1": "1", "item_2": "", "item_3": "3", "item_4": "4"}

    def broken():
        raise OSError("no model")

    failed = apply.run_on_rows(df.coalesce(1), "key", broken)
    assert [r.key for r in failed.collect()] == ["__error__"] and apply.run_is_empty(failed)


def test_retry():
    pauses, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert apply.with_retry(flaky, sleep=pauses.append)() == "ok" and len(pauses) == 2
    with pytest.raises(ValueError):
        apply.with_retry(lambda: (_ for _ in ()).throw(ValueError()), retryable=lambda e: False, sleep=pauses.append)()


def test_audit(spark):
    df = spark.createDataFrame([("u1", "p§a"), ("u2", "§"), ("u3", "pa")], "u string, t string")
    rows = audit.span_counts(audit.skipped_rows(df, "u", "t", "t")).collect()
    assert [(r.span, r.n, r.examples, r.code_points) for r in rows] == [("§", 2, ["u1", "u2"], "U+00A7")]
    walked = audit.walk_json(spark.createDataFrame([("a", '{"x": [{"f": "1"}], "f": "2"}'), ("b", "bad"), ("c", None)], "k string, j string"), "k", "j", "f")
    assert sorted((r.path, r.value) for r in walked.collect()) == [("$.f", "2"), ("$.x[0].f", "1")]


def test_feature_distance():
    assert features.feature_distance(["p"], ["p"]) == 0 and features.feature_distance([], ["p", "b"]) == 2
    assert 0 < features.hamming("p", "b") < features.hamming("p", "i") <= 1
