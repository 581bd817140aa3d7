from __future__ import annotations

from phonolake.llm import decontam, simhash

ITEM = "the quick farmer sells many crates of apples at a market near the old river mill"
SCHEMA = "doc_id long, text string"


def test_clean_rows_stay_beside_contaminated_ones(spark):
    rows = [(None, ITEM), (None, "clean words of no item"), (None, None), (7, ITEM), (7, "other clean words"), (8, "more clean words")]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.without_contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert {tuple(r) for r in kept} == {r for r in rows if r[1] != ITEM} and len(kept) == 4


def test_one_row_of_each_component(spark):
    other = " ".join(f"word{i}" for i in range(40))
    third = " ".join(f"thing{i}" for i in range(40))
    near = ITEM + "  "  # the same words
    rows = [(None, ITEM), (None, near), (None, other), (1, other), (1, third), (0, third + " ")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == 3
    assert {(r.doc_id, r.text) for r in kept if r.doc_id is not None} == {(1, other), (0, third + " ")}
    assert [r.text.strip() for r in kept if r.doc_id is None] == [ITEM]
