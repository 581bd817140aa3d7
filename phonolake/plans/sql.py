"""Text functions in DuckDB's SQL, for the queries' SQL: the published steps, one after the other, without the shortcuts that
the operators take."""

from __future__ import annotations

import string
import unicodedata
from itertools import groupby

from ..functions import ipa, phones

#: Python's white space as a class of RE2.
SPACE = "[" + "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace()) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfd(x: str) -> str:
    """Canonical decomposition of the Latin letters below U+0180, all that the tables hold."""
    for c in map(chr, range(0xC0, 0x180)):
        if (d := unicodedata.normalize("NFD", c)) != c:
            x = f"replace({x}, '{c}', '{d}')"
    return x


def rule(x: str, one: ipa.Rule) -> str:
    if one.regex:
        return f"regexp_replace({x}, {quoted(one.pattern.replace(ipa.PY_SPACE, SPACE))}, {quoted(one.to)}, 'g')"
    return f"replace({x}, {quoted(one.pattern)}, {quoted(one.to)})"


def normalize(x: str) -> str:
    x = nfd(x)
    for one in ipa.RULES:
        x = rule(x, one)
    return x


def audit(table: str, key: str, text: str) -> str:
    """(key, text, normalized, rule_ids) by a chain of CTEs, a column for the text after each rule."""
    steps = [f"s0 AS (SELECT {key}, {text} AS t, {nfd(text)} AS t0 FROM {table})"]
    steps += [f"s{i + 1} AS (SELECT *, {rule(f't{i}', one)} AS t{i + 1} FROM s{i})" for i, one in enumerate(ipa.RULES)]
    marks = ["CASE WHEN t0 <> t THEN 'unicode_nfd' END"]
    for name, same in groupby(enumerate(ipa.RULES), lambda x: x[1].id):
        marks.append("CASE WHEN " + " OR ".join(f"t{i + 1} <> t{i}" for i, _ in same) + f" THEN '{name}' END")
    n = len(ipa.RULES)
    return f"WITH {', '.join(steps)} SELECT {key}, t AS text, t{n} AS normalized, concat_ws(';', {', '.join(marks)}) AS rule_ids FROM s{n}"


def looks_like_ipa(x: str) -> str:
    bare = f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    tokens = f"list_filter(regexp_split_to_array({bare}, '{SPACE}+'), lambda w: w <> '')"
    letters = f"[{', '.join(map(quoted, ipa.ASCII_PHONES))}]"
    several = f"(len({tokens}) > 1 AND len(list_filter({tokens}, lambda w: NOT list_contains({letters}, w))) = 0)"
    return f"CASE WHEN {bare} = '' THEN true WHEN regexp_matches({bare}, '[A-Za-z]{{2}}') THEN false ELSE regexp_matches({bare}, '[{ipa.HINTS}]|\\p{{M}}') OR {several} END"


def clean_for_scan(x: str) -> str:
    """Silent tokens go one after the other, the longest first; then punctuation, then white space."""
    x = normalize(x)
    for token in sorted(phones.SILENT, key=len, reverse=True):
        x = f"replace({x}, {quoted(token)}, '')"
    return f"regexp_replace(translate({x}, {quoted(string.punctuation)}, ''), '{SPACE}', '', 'g')"


def _plain(token: str) -> str:
    return "".join(f"\\{c}" if c in string.punctuation else c for c in token)


#: The known tokens as a flat alternation, longest first.
TOKENS = f"({'|'.join(_plain(t) for t in phones.SCAN_TOKENS)})".replace("'", "''")


def segment(x: str) -> str:
    return f"regexp_extract_all({clean_for_scan(x)}, '{TOKENS}', 1)"


def skipped(x: str) -> str:
    return f"list_filter(regexp_split_to_array({clean_for_scan(x)}, '{TOKENS}'), lambda s: s <> '')"


def project(tokens: str) -> str:
    entries = phones.PHONES_OF | {f: ("t",) for f in phones.FLAPS}
    names = ", ".join(quoted(k) for k in entries)
    values = ", ".join("[" + ", ".join(map(quoted, v)) + "]" for v in entries.values())
    return f"flatten(list_transform({tokens}, lambda k: coalesce(map_extract_value(MAP([{names}], [{values}]), k), CAST([] AS VARCHAR[]))))"


def pair_paths(name: str, source: str) -> str:
    """CTEs that end in ``name`` (a, b, pa, pb): for each distinct pair of strings of ``source`` (a, b) its alignment, a
    blank being a hyphen.  Rows of the table of edit distances, then the walk back: insertion, deletion, diagonal."""
    return f"""
{name}_t AS (
  SELECT DISTINCT a, b, 0 AS i, range(0, length(b) + 1) AS row FROM {source}
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k:
    j - k + CASE WHEN k = 0 THEN row[1] + 1 ELSE least(row[k + 1] + 1, row[k] + CAST(substr(b, k, 1) <> substr(a, i + 1, 1) AS INT)) END)))
  FROM {name}_t WHERE i < length(a)),
{name}_w AS (
  SELECT a, b, list(row ORDER BY i) AS t, length(a) AS i, length(b) AS j, '' AS pa, '' AS pb FROM {name}_t GROUP BY a, b
  UNION ALL
  SELECT a, b, t, CASE WHEN ins THEN i ELSE i - 1 END, CASE WHEN ins OR NOT del THEN j - 1 ELSE j END,
         CASE WHEN ins THEN '-' ELSE substr(a, i, 1) END || pa, CASE WHEN ins OR NOT del THEN substr(b, j, 1) ELSE '-' END || pb
  FROM (SELECT *, j > 0 AND t[i + 1][j] + 1 = t[i + 1][j + 1] AS ins, i > 0 AND t[i][j + 1] + 1 = t[i + 1][j + 1] AS del FROM {name}_w WHERE i > 0 OR j > 0)),
{name} AS (SELECT a, b, pa, pb FROM {name}_w WHERE i = 0 AND j = 0)"""


def _value(p: str, u: str, h: str) -> str:
    """The terms of the strict placement in one number: edits, matches, agreements, edits against the prediction, length."""
    return f"((((CAST({p} <> {u} AS BIGINT) * 4096 - CAST({p} = {h} AND {h} <> '-' AS BIGINT)) * 4096 - CAST({u} = {h} AS BIGINT)) * 4096 + CAST({p} <> {h} AS BIGINT)) * 4096 + 1)"


def placed(name: str, source: str) -> str:
    """CTEs that end in ``name`` (p, pu, ph, qp, qu, qh): prompts of ``source`` (p, pu, ph) placed on the rows of pu and ph."""
    at = lambda s, k: f"substr({s}, CAST({k} AS INT), 1)"
    both = lambda i, j: _value(at("p", i), at("pu", j), at("ph", j))
    down = lambda i: _value(at("p", i), "'-'", "'-'")
    right = _value("'-'", at("pu", "k"), at("ph", "k"))
    return f"""
{name}_c AS (
  SELECT DISTINCT p, pu, ph, list_transform(range(0, length(pu) + 1), lambda j: CAST(coalesce(list_sum(list_transform(range(1, j + 1), lambda k: {right})), 0) AS BIGINT)) AS c FROM {source}),
{name}_t AS (
  SELECT p, pu, ph, c, 0 AS i, c AS row FROM {name}_c
  UNION ALL
  SELECT p, pu, ph, c, i + 1, list_transform(range(0, length(pu) + 1), lambda j: c[j + 1] + list_min(list_transform(range(0, j + 1), lambda k:
    CASE WHEN k = 0 THEN row[1] + {down("i + 1")} ELSE least(row[k + 1] + {down("i + 1")}, row[k] + {both("i + 1", "k")}) END - c[k + 1])))
  FROM {name}_t WHERE i < length(p)),
{name}_w AS (
  SELECT p, pu, ph, list(row ORDER BY i) AS t, length(p) AS i, length(pu) AS j, '' AS qp, '' AS qu, '' AS qh FROM {name}_t GROUP BY p, pu, ph
  UNION ALL
  SELECT p, pu, ph, t, CASE WHEN diag OR down THEN i - 1 ELSE i END, CASE WHEN diag OR NOT down THEN j - 1 ELSE j END,
         CASE WHEN diag OR down THEN substr(p, i, 1) ELSE '-' END || qp, CASE WHEN diag OR NOT down THEN substr(pu, j, 1) ELSE '-' END || qu,
         CASE WHEN diag OR NOT down THEN substr(ph, j, 1) ELSE '-' END || qh
  FROM (SELECT *, i > 0 AND j > 0 AND t[i][j] + {both("i", "j")} = t[i + 1][j + 1] AS diag, i > 0 AND t[i][j + 1] + {down("i")} = t[i + 1][j + 1] AS down
        FROM {name}_w WHERE i > 0 OR j > 0)),
{name} AS (SELECT p, pu, ph, qp, qu, qh FROM {name}_w WHERE i = 0 AND j = 0)"""
