"""Plans are the ones wanted: columns are pruned, filters reach the scan, and nothing multiplies rows."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from phonolake.plans import queries

#: Joins with a side of one row, or over a matrix of label counts.
SMALL_SIDES = {"q11_mae_and_kappa", "q12_pearson_and_kendall", "q14_miss_rate", "q19_inventory", "q59_kendall_of_numbers"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_products(spark, sf_dir, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    if name not in SMALL_SIDES:
        assert "NestedLoop" not in text


@pytest.mark.parametrize("name,table,columns", [
    ("q02_missing_keys", "documents", {"doc_id", "source"}), ("q10_accuracy_and_f1", "documents", {"doc_id", "n_chars"}), ("q21_chunk_ids", "orders", {"o_orderkey"}),
    ("q16_neighbour_window", "lineitem", {"l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount"}), ("q23_disjoint_speakers", "customer", {"c_custkey", "c_name", "c_mktsegment"}),
])
def test_columns_are_pruned(spark, sf_dir, name, table, columns):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    read = [set(re.findall(r"(\w+):", s)) for t, s in re.findall(r"Location: [^\n]*/(\w+)\.parquet\]\n(?:PushedFilters: [^\n]*\n)?ReadSchema: struct<([^\n]*)>", text) if t == table]
    assert read and all(r <= columns for r in read)


def test_filters_reach_the_scan(spark, sf_dir):
    df = queries.q37_map_and_exclude(spark, sf_dir)
    assert "PushedFilters: [" in plan(df) and "p_brand" in re.search(r"PushedFilters: \[([^\n]*)\]", plan(df))[1]


#: Unicode decomposition, which Spark lacks, alignments with a path, callables and JSON of unknown depth run in Arrow batches.
IN_PYTHON = {"q24_clean_text", "q25_skipped_spans", "q47_responses", "q50_error_rates", "q55_strict_mdd", "q56_edit_counts", "q57_nbest", "q58_narrow_beam", "q59_kendall_of_numbers", "r03_normalization_audit", "r04_projection", "r05_apply_rows", "r06_span_audit", "r11_json_walk"}


def test_native_queries_run_no_python(spark, sf_dir):
    for name in queries.SQL.keys() - IN_PYTHON:
        assert not re.search(r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython", plan(queries.QUERIES[name](spark, sf_dir))), name
