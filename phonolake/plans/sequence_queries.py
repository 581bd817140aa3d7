"""Queries of decoding, segmenting, and of documents and places at scale, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments
from ..operators import decoding, geolocation, labels
from ..session import spread
from .queries import query, rounded, table

_MASSES = ("1.0 + (o_custkey * {t}) % 7", "1.0 + (o_orderkey * {t}) % 5", "1.25 + (o_orderkey + o_custkey * {t}) % 6")
_FRAMES = 5


@query(f"""
WITH RECURSIVE m AS (SELECT o_orderkey AS k, t, {", ".join(f"CAST({m.format(t='t')} AS DOUBLE) AS m{i}" for i, m in enumerate(_MASSES))} FROM orders CROSS JOIN range(1, {_FRAMES + 1}) r(t)),
f AS (SELECT k, t, m0 / (m0 + m1 + m2) AS p0, m1 / (m0 + m1 + m2) AS p1, m2 / (m0 + m1 + m2) AS p2 FROM m),
s(k, t, prefix, b, o) AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT), '', CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM f
  UNION ALL
  SELECT k, t + 1, next, sum(CASE WHEN c = 0 THEN (b + o) * p0 ELSE 0 END), sum(CASE c WHEN 0 THEN 0 WHEN 3 THEN o * own ELSE CASE WHEN right(prefix, 1) = CAST(c AS VARCHAR) THEN b ELSE b + o END * CASE c WHEN 1 THEN p1 ELSE p2 END END)
  FROM (SELECT s.*, p0, p1, p2, c, CASE right(prefix, 1) WHEN '1' THEN p1 WHEN '2' THEN p2 ELSE 0 END AS own, CASE WHEN c IN (1, 2) THEN prefix || c ELSE prefix END AS next
        FROM s JOIN f ON s.k = f.k AND s.t + 1 = f.t CROSS JOIN (VALUES (0), (1), (2), (3)) a(c))
  GROUP BY k, t, next),
e AS (SELECT k, prefix, ln(b + o) AS score FROM s JOIN (SELECT k AS key, max(t) AS n FROM f GROUP BY k) z ON k = key AND t = n WHERE b + o > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, prefix) AS place FROM e)
SELECT k AS o_orderkey, place, prefix AS ids, round(score, 6) AS score FROM r WHERE place <= 3""")
def q57_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's numbers make five frames, with masses for a blank and two symbols; the three best sequences over all paths.
    The beam is wide enough for every sequence of five frames."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    frames = []
    for t in range(1, _FRAMES + 1):
        masses = [F.expr(m.format(t=t)).cast("double") for m in _MASSES]
        frames.append(F.array(*[F.ln(m / (masses[0] + masses[1] + masses[2])) for m in masses]))
    found = spread(o.select("o_orderkey", F.array(*frames).alias("f"))).select("o_orderkey", F.posexplode(decoding.nbest(F.col("f"), 40, 3)).alias("place", "s"))
    return found.select("o_orderkey", (F.col("place") + 1).cast("long").alias("place"), F.array_join("s.ids", "").alias("ids"), F.round("s.score", 6).alias("score"))


@query("""
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, coalesce(string_agg(event_type, ' ' ORDER BY k) FILTER (WHERE event_type <> 'view' AND event_type IS DISTINCT FROM before), '') AS path FROM e GROUP BY user_id""")
def q58_narrow_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one prefix and clear frames the search gives the collapsed best path."""
    e = table(spark, sf_dir, "events").where("event_type is not null")
    kinds = ["view", *sorted(r[0] for r in e.where("event_type <> 'view'").select("event_type").distinct().collect())]  # kinds, not rows
    clear, dim = F.log(F.lit(0.9)), F.log(F.lit(0.1 / max(1, len(kinds) - 1)))
    frame = F.array(*[F.when(F.col("event_type") == k, clear).otherwise(dim) for k in kinds])
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", frame.alias("p")))).alias("f"))
    ids = F.get(decoding.nbest(F.col("f.p"), 1), F.lit(0))["ids"]
    names = F.array(*map(F.lit, kinds))
    return rows.select("user_id", F.array_join(F.transform(ids, lambda i: F.get(names, i)), " ").alias("path"))


@query("""
WITH o AS (SELECT o_custkey AS t, o_totalprice AS p FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL),
s AS (SELECT sum(CAST(sign(b.p - a.p) AS DOUBLE)) AS s FROM o a JOIN o b ON a.t < b.t),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM o),
tt AS (SELECT sum(x * (x - 1) / 2) AS tt FROM (SELECT CAST(count(*) AS DOUBLE) AS x FROM o GROUP BY t)),
tp AS (SELECT sum(x * (x - 1) / 2) AS tp FROM (SELECT CAST(count(*) AS DOUBLE) AS x FROM o GROUP BY p))
SELECT round(s / (sqrt(n * (n - 1) / 2 - tt) * sqrt(n * (n - 1) / 2 - tp)), 9) AS kendall_tau FROM s, n, tt, tp""")
def q59_kendall_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two columns of nearly as many values as rows."""
    return rounded(labels.kendall_tau_b(labels.confusion(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey")), 9)


#: Some letters of the tables' texts as IPA with modifiers and tie bars.
_IPA = {"th": "t͡ʰʃ", "e": "ẽː", "n": "ᵐn̪", "r": "ɾʲ", "o": "ɔ͜ʊ", "z": "dʒ"}


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all({"".join("replace(" for _ in _IPA)}text{"".join(f", '{k}', '{v}')" for k, v in _IPA.items())}, '{segments.SEGMENT}') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM d),
v AS (SELECT token, 1 + row_number() OVER (ORDER BY token) AS id FROM (SELECT token FROM x GROUP BY token HAVING count(*) >= 3))
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, '|')) AS tokens,
       coalesce((SELECT md5(string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY k)) FROM x LEFT JOIN v ON x.token = v.token WHERE x.doc_id = d.doc_id), md5('')) AS ids,
       coalesce((SELECT md5(string_agg(v.token, '' ORDER BY k)) FROM x JOIN v ON x.token = v.token WHERE x.doc_id = d.doc_id), md5('')) AS clean FROM d""")
def q60_segment_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, some letters spelled as IPA, cut into segments, encoded by their own vocabulary and decoded."""
    said = F.col("text")
    for letter, spelled in _IPA.items():
        said = F.replace(said, F.lit(letter), F.lit(spelled))
    d = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", said.alias("said")))
    known = segments.as_map(segments.segment_vocabulary(d, "said", 3))
    digest = lambda c: F.md5(c.cast("binary"))
    out = d.select("doc_id", segments.split(F.col("said")).alias("t")).withColumn("ids", segments.encode_tokens(F.col("t"), known))
    return out.select(
        "doc_id", F.size("t").cast("long").alias("n"), digest(F.array_join("t", "|")).alias("tokens"),
        digest(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids"), digest(segments.decode_ids(F.col("ids"), known, clean=True)).alias("clean"),
    )


_TOWNS = """n AS (SELECT c_custkey AS k, radians(((c_custkey * 7919) % 16001) / 100.0 - 80) AS lat, radians(((c_custkey * 104729) % 35003) / 100.0 - 175) AS lon,
  radians(((c_custkey * 7919) % 16001) / 100.0 - 80 + (c_custkey % 9 - 4) / 4.0) AS a, radians(((c_custkey * 104729) % 35003) / 100.0 - 175 + (c_custkey % 7 - 3) / 3.0) AS b FROM customer)"""


@query(f"""
WITH {_TOWNS}, u AS (SELECT *, cos(a) * cos(b) AS px, cos(a) * sin(b) AS py, sin(a) AS pz, round(lat, 6) AS la, round(lon, 6) AS lo FROM n),
g AS (SELECT DISTINCT la, lo, cos(la) * cos(lo) AS x, cos(la) * sin(lo) AS y, sin(la) AS z FROM u),
s AS (SELECT k, (SELECT count(*) FROM g WHERE px * g.x + py * g.y + pz * g.z > px * cos(u.la) * cos(u.lo) + py * cos(u.la) * sin(u.lo) + pz * sin(u.la) + 1e-13) AS nearer FROM u)
SELECT round(100.0 * avg(CASE WHEN nearer >= 3 THEN 1.0 ELSE 0.0 END), 6) AS miss_rate FROM s""")
def q61_nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly as many places as rows, found by cells of the sphere."""
    c = table(spark, sf_dir, "customer")
    lat, lon = ((F.col("c_custkey") * n) % m / 100.0 - w for n, m, w in ((7919, 16001, 80), (104729, 35003, 175)))
    a, b = F.radians(lat + (F.col("c_custkey") % 9 - 4) / 4.0), F.radians(lon + (F.col("c_custkey") % 7 - 3) / 3.0)
    x, y, z = geolocation.to_unit(a, b)
    rows = c.select("c_custkey", F.radians(lat).alias("lat"), F.radians(lon).alias("lon"), x.alias("x"), y.alias("y"), z.alias("z"))
    return rounded(geolocation.miss_rate(rows, 3, "c_custkey", "x", "y", "z", "lat", "lon", leaf=16))
