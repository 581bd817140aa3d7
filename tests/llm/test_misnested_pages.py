"""Tags out of order, short comments, and results without ANSI."""

from __future__ import annotations

import pytest

from phonolake.llm import html_text, line_dedup


@pytest.mark.parametrize(("html", "text"), [
    ("<b><p>bold</b> para</p>tail", "bold para\n\ntail"),
    ("<i>one<p>two</i>three</p>four", "one\n\ntwothree\n\nfour"),
    ("<h1>T</h2>rest", "T\n\nrest"),
    ("<p>a<!-->b</p><p>c</p>", "ab\n\nc"),
    ("<p>a<!--->b</p><p>c</p>", "ab\n\nc"),
    ("<p>a<!--x--!>b</p><p>c</p>", "ab\n\nc"),
    ("<p>a<!-- - > --x -->b</p>", "ab"),
    ("<span>a<div>b</span>c</div>d", "a\nbc\nd"),
    ("<b>x<i>y</b>z</i>", "xyz"),
])
def test_pages(spark, html, text):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert html_text.extract_pages(df).first().text == text


def test_line_dedup_without_ansi(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(k, f"{line}\nown {k}") for k in range(3)] + [(9, "alone"), (10, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {0: 1, 1: 1, 2: 0, 9: 0, 10: 0}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
