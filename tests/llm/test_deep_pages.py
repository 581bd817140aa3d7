from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from phonolake.llm import html_text


class Visible(HTMLParser):
    """The visible words of a page, in order, by a flat pass with a count of hidden elements that are open; no tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        hidden = tag in html_text.HIDDEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs)
        hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", attrs.get("style") or "", re.I))
        if tag not in html_text.VOID:
            self.open.append((tag, hidden))
        if tag in html_text.BLOCK or tag in ("br", "td", "th"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK or tag in ("td", "th"):
            self.words.append(" ")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words.append(data)


def bare(text):
    """Words without what the layout adds: list marks, quote marks."""
    return [w for w in text.split() if not re.fullmatch(r"-|>|\d+\.", w)]


def test_pages_by_a_flat_pass(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert got.keys() == pages.keys()
    for page_id, html in pages.items():
        flat = Visible()
        flat.feed(html or "")
        flat.close()
        assert Counter(bare("".join(flat.words))) == Counter(bare(got[page_id])), page_id


@pytest.mark.parametrize("depth", [10, 200, 3000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    html = "<div>" * depth + '<p style="display:none">SECRET</p><p>shown</p>' + "</div>" * depth
    assert html_text.extract(html)[1] == "shown"


@pytest.mark.parametrize("depth", [10, 2000])
def test_layout_at_any_depth(depth):
    table = "<table><tr><td>a</td><td>b</td></tr><tr><td>long</td><td>c</td></tr></table><ol><li>one<li>two</ol>"
    assert html_text.extract("<div>" * depth + table)[1] == html_text.extract(table)[1] == "a     b\nlong  c\n\n1. one\n2. two"
    assert html_text.extract("<span>" * depth + "x")[1] == "x"
    assert html_text.extract("<ul><li>" * depth + "x")[1].split() == ["-"] * depth + ["x"]
    assert html_text.extract("<table><tr><td>" * depth + "x")[1] == "x"
    assert html_text.extract("<pre>" + "<b>" * depth + " y" + "</b>" * depth + "</pre>")[1] == " y"
    assert html_text.extract("<select>" + "<optgroup><b>" * depth + "<option>z")[1] == "z"


def test_many_elements_are_read_in_linear_time():
    n = 20_000
    for html in ("<div>" * n + "x", "<p>" + "<b>" * n + "</i>" * n + "x", "<div>" * n + "<li>x" * 5, "<ul><li>x" + "<p>y" * n):
        assert html_text.extract(html)[1].endswith(("x", "y"))


def test_spans_follow_the_standard():
    html = '<table><tr><td rowspan="2000000">a</td><td>b</td></tr>' + "<tr><td>c</td></tr>" * 1500 + "</table>"
    lines = html_text.extract(html)[1].split("\n")
    assert lines[0] == "a  b" and set(lines[1:]) == {"   c"} and len(lines) == 1501


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, html string, text int")
    out = html_text.extract_pages(df)
    assert out.columns == ["page_id", "title", "text", "n_chars"] and out.count() == 0
