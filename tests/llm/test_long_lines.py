from __future__ import annotations

from phonolake.llm import quality

PROSE = " ".join(f"Sentence {i} tells a{i} story{i} of b{i} and the topic{i * 7} at hand{i}." for i in range(40))
OTHER = " ".join(f"Chapter {i} says c{i} more{i} than d{i} in the part{i * 5} behind{i}." for i in range(40))


def test_long_lines_are_kept(spark):
    hindi = "\n".join(" ".join(f"शब्द{i}{k}" for k in range(12)) + "।" for i in range(8))
    urdu, chinese = hindi.replace("।", "۔"), hindi.replace("।", "。")
    texts = [PROSE[:-1], PROSE + " Read our privacy policy before you go on. " + OTHER, hindi, urdu, chinese, " ".join(f"w{i}" for i in range(100)), PROSE + "\nSee our privacy policy.\nno end"]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].kept for i in range(7)] == [True, True, True, True, True, False, True]
    assert all(rows[i].lost_chars == 0 for i in range(5)) and rows[6].clean_text == PROSE


def test_good_documents_are_kept(spark):
    folder = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").join(good, "doc_id", "left_semi")
    lost = quality.judge(docs).where("not kept and not base_failed").select("doc_id")
    assert lost.count() == 0
