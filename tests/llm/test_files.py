from __future__ import annotations

import hashlib
import io
import struct

import zstandard
import pytest

from phonolake.llm import html_text, queries, warc

PAGE = "<html>" + "x" * 200


def revisits_by_hand(pages):
    first = {}
    for i, h in pages:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    out = {}
    for i, h in pages:
        raw = (h or "").encode()
        kind = "revisit" if first.get(raw, i) != i else "response"
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), kind, first[raw] if kind == "revisit" else None)
    return out


def test_round_trip_of_the_table(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op3_warc(spark, sf_dir).collect()}
    assert got == revisits_by_hand(pages)


def test_payloads_come_back(spark, tmp_path):
    pages = [(3, "u3", PAGE), (1, "u1", PAGE), (2, None, None), (4, "u\r\n4", ""), (5, "u5", "é" * 60), (6, "u6", "y"), (7, "u7", "y"), (8, "u8", PAGE + "\r\n\r\nz")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    archives = warc.write_pages(df, f"file://{tmp_path}/w", archive_bytes=300)
    assert archives.count() > 1
    rows = {r.page_id: r for r in warc.read_pages(spark, archives, with_payload=True).collect()}
    want = revisits_by_hand([(p[0], p[2]) for p in pages])
    assert {k: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for k, r in rows.items()} == want
    assert all(bytes(rows[p[0]].payload) == (b"" if want[p[0]][2] == "revisit" else (p[2] or "").encode()) for p in pages)
    assert rows[4].url == "u4"
    assert warc.archive_round_trip(df.limit(0), f"{tmp_path}/e").count() == 0


def test_archives_in_a_store_that_is_no_file_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "local_path", lambda path: None)
    df = spark.createDataFrame([(i, f"u{i}", PAGE + str(i // 2)) for i in range(40)], "page_id long, url string, html string")
    archives = warc.write_pages(df, f"file://{tmp_path}/s", archive_bytes=2000)
    assert archives.where("content is null").count() == 0 and archives.count() > 4
    rows = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_pages(spark, archives).collect()}
    assert rows == {i: ("revisit", i - 1) if i % 2 else ("response", None) for i in range(40)}


def test_repeated_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", PAGE), (1, "a", PAGE), (None, "n", PAGE)], "page_id long, url string, html string")
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive_round_trip(df, str(tmp_path)).collect())
    assert rows == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1)]


def test_archive_layout(tmp_path):
    records = [f"record {i} with shared words {'lorem ipsum ' * 20}".encode() for i in range(500)]
    path = f"{tmp_path}/a.warc.zst"
    assert warc.write_archive(path, iter(records), sample_bytes=40_000) == 500
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    assert dictionary.dict_id() != 0
    # any reader that knows the dictionary can read the frames one after the other
    body = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True).read()
    assert body == b"".join(records)
    assert list(warc.read_archive(path)) == records
    with open(path, "wb") as f:
        f.write(raw[:-3])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_archive(path))


def test_the_dictionary_is_of_the_whole_archive(tmp_path):
    records = [bytes([65 + i]) * 100 for i in range(50)] + [b"z" * 100_000]
    got = warc.sample_of(records, 40_000)
    assert 20_000 <= sum(map(len, got)) <= 60_000 and len({g[:1] for g in got}) > 10 and got[-1][:1] == b"z"
    assert warc.sample_of(records, 1 << 20) == records[:50] + [b"z" * n for n in [16384] * 6 + [1696]]
    assert warc.sample_of([]) == [] and warc.sample_of([b""]) == []


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<b>a</b> <i> b</i>c", "a bc"), ("a &amp; b &lt;c&gt;", "a & b <c>"), ("<script>x</script>a<style>b</style>", "a"), ("<p hidden>a</p><p style='display: none'>b</p>c", "c"),
    ("<!-- a -->b<!--", "b"), ("<pre>  a\n b</pre>c", "  a\n b\n\nc"), ("<table><tr><th>n<th>long name<tr><td>22<td>x</table>", "n   long name\n22  x"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f".replace("     c", "     c")),
    ("<title>t</title><h1>h</h1>x", "h\n\nx"), ("<head><title>t</title><p>a", "a"), ("</p>a</div>b", "ab"), ("<blockquote>a<p>b</blockquote>", "> a\n>\n> b"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"), ("<select><option>a<option selected>b</select>", "b"), ("<details><summary>s</summary>x</details>", "s"), ("a<hr>b", "a\n\nb"),
    ("<td>a</td>", "a"), ("x < y", "x < y"), ("<p title='>'>a", "a"), ("<script>var t=\"</p>\";</script>a", "a"),
])
def test_rendering(html, text):
    assert html_text.extract(html)[1] == text


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "a" + "</div>" * 5000 + "b"
    assert html_text.extract(deep)[1].split() == ["a", "b"]
    assert html_text.extract("<p>" + "word " * 200_000)[1].count("word") == 200_000
    assert html_text.extract("<table>" * 400 + "x")[1] == "x"


def test_pages_query(spark, sf_dir):
    rows = queries.op6_html_extraction(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.page_id: (r.title, r.text) for r in rows} == {k: html_text.extract(v) for k, v in pages.items()}
    assert all("<p>" not in r.text and "track(" not in r.text and r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(None, None, "x"), (1, "<p>a", "y"), (1, "<p>a", "y")], "page_id long, html string, text string")
    from phonolake.llm.html_text import extract_pages

    assert sorted((r.page_id or 0, r.text) for r in extract_pages(odd).collect()) == [(0, ""), (1, "a"), (1, "a")]


def test_archives_of_no_pages_and_of_very_long_ones(spark):
    from phonolake.llm import chat, warc

    schema = "page_id long, url string, html string, digest int"
    assert warc.archive_round_trip(spark.createDataFrame([], schema)).count() == 0
    long = "<p>" + "word " * 400_000
    rows = [(None, "u", long, 1), (None, "u", "x" * 200, 1), (None, "u", "x" * 200, 1), (3, None, long, 1), (5, "v", None, 1)]
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 200, "response", None), (0, 200, "revisit", None), (0, len(long), "revisit", 3), (3, len(long), "response", None), (5, 0, "response", None)]
    turns = spark.createDataFrame([(1, 0, "user", long, 9), (2, 0, "user", long, 9), (2, 1, "assistant", "ok", 9)], "conv_id long, turn int, role string, text string, n_turns int")
    assert [(r.conv_id, r.n_turns, r.n_equal) for r in chat.format_chats(turns).collect()] == [(2, 2, 1)]
    assert chat.format_chats(turns.limit(0)).count() == 0
