"""The operators applied to whole tables with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_text, langid, line_dedup, packing, prefix_trie, quality, resampling, simhash, suffix_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), long_lines=False)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "lost_chars")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.branched_sequences(table(spark, sf_dir, "conversations"))).drop("n_ends")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_line_dedup, op2_suffix_dedup, op3_warc, op4_quality_rules, op5_packing,
        op6_html_extraction, op7_simhash, op8_chat, op9_decontamination, op10_language, op11_prefix_trie, op12_token_counts,
        op13_resampling,
    ]
    return {f.__name__: f for f in made}


#: Line dedup as a CTE chain over a table ``src`` (doc_id, text); used alone and as a stage of the pipeline.
LINE_DEDUP_CTES = r"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM src),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key),
deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
"""

#: The counts of the quality rules and the verdict over a table ``src`` (doc_id, text).
QUALITY_CTES = r"""
words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM src),
wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, d.text, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         greatest(0, length(d.text) - coalesce(length(list_aggregate(list_filter(l, lambda x:
           NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR (
             regexp_matches(x, '[.!?…:;"''’”»)\]][\x20\x09-\x0D]*$')
             AND (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 50 <= length(x)
             AND (length(x) - length(replace(x, '!!', ''))) / 2 < 2
             AND length(x) - length(regexp_replace(x, '[|»›•·]', '', 'g')) < 3
             AND NOT regexp_matches(lower(x), 'NAVIGATION') AND NOT regexp_matches(lower(x), 'BOILERPLATE'))), 'string_agg', chr(10))), 0)) AS lost_chars
  FROM words d LEFT JOIN covered c ON d.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * length(text) AS kept
  FROM counted)
""".replace("BOILERPLATE", quality.BOILERPLATE).replace("NAVIGATION", quality.NAVIGATION)


def _crc32(text: str) -> str:
    """The checksum of an SQL string, a byte and then its eight bits at a time."""
    steps = f"flatten(list_transform(range(0, strlen({text})), lambda i: [('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))"
    step = "CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: {step}), 4294967295)"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": f"""
WITH src AS (SELECT doc_id, text FROM documents), {LINE_DEDUP_CTES}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped""",
        "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, n >= 100 AND min(page_id) OVER (PARTITION BY digest) <> page_id AS again, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM f""",
        "op4_quality_rules": f"""
WITH src AS (SELECT doc_id, text FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars FROM judged""",
        "op8_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
             count(*) AS n_turns,
             string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
      FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:n] AS head FROM (SELECT turns, unnest(range(1, n_turns)) AS n FROM c)),
u AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY turns)
SELECT u.conv_id, c.n_turns, u.n_equal, c.text FROM u JOIN c ON u.conv_id = c.conv_id
WHERE u.turns NOT IN (SELECT head FROM p)""",
        "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, md5(strlen(r) || ':' || r || x) AS key, strlen(x) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS first, {_crc32("s")} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
mixed AS (
  SELECT i.conv_id, 0 AS part, pos, key, size FROM ids i JOIN t ON t.conv_id = i.first AND pos <= h
  UNION ALL SELECT i.conv_id, 1, pos, key, size FROM ids i JOIN t ON t.conv_id = i.conv_id AND pos > h),
c AS (
  SELECT i.conv_id, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes
  FROM ids i LEFT JOIN (SELECT conv_id, list(key ORDER BY part, pos) AS keys, list(size ORDER BY part, pos) AS sizes FROM mixed GROUP BY conv_id) m ON m.conv_id = i.conv_id),
p AS (SELECT conv_id, keys[1:d] AS node, d, sizes[d] AS size, len(keys) = d AS ends FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM c)),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(size), 0) AS size,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
  FROM p GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node),
s AS (
  SELECT node[1:up] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(w.ended) AS ends_sha256
FROM w JOIN s ON w.node = s.node LEFT JOIN n a ON w.d > 0 AND a.node = w.node[1:w.d - 1]""",
        "op13_resampling": f"""
WITH raw AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM raw),
f AS (
  SELECT own, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
b AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f)),
h AS (SELECT own, r, bucket FROM f JOIN b USING (f)),
s AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM h GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM s, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM s)),
d AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM h JOIN g USING (bucket) WHERE own GROUP BY r),
e AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS eligible,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d ON w.r = d.r WHERE own),
o AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE eligible) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND k <= 25 * n // 100 THEN k END AS rank FROM o""",
    }
