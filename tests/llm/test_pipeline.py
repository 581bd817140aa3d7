from __future__ import annotations

import corpus_pipeline
from phonolake.llm import decontam, quality, simhash


def test_stages_are_the_operators(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, types = docs.columns, docs.dtypes
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        frames.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == columns and docs.dtypes == types
        assert all(r.n_chars == len(r.text) for r in frames[-1].values())
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    judged = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert frames[0].keys() == {d for d in start if judged[d].kept} and all(frames[0][d].text == judged[d].clean_text for d in frames[0])
    assert frames[1].keys() == frames[0].keys()
    fps = {d: simhash.fingerprint_of(r.text) for d, r in frames[1].items()}
    kept = frames[2].keys()
    assert all(any(bin((fps[d] ^ fps[k]) & (2**64 - 1)).count("1") <= 3 or k < d for k in kept) for d in fps) and min(fps) in kept
    assert frames[3].keys() <= frames[2].keys()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.contaminated(docs, benchmark).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == frames[3].keys()
    run = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, last.select(*key).collect()))


def test_odd_documents(spark, sf_dir):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf_dir)
        assert out.count() >= 0 and stage(spark, df.limit(0), sf_dir).count() == 0
