"""Every operator applied to the driver's tables, with equivalent SQL where SQL can express it.

The tables hold no phonetic text, so phone operators run on stand-ins: words of documents and conversations are mapped
to phones letter by letter.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ipa, phones, text, vocabulary
from ..operators import align, apply, audit, features, geolocation, inventory, labels, merge, scoring, slots, splits, tables
from ..session import spread
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(duck: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if duck:
            SQL[f.__name__] = duck
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- merges, lookups, sets -------------------------------------------------------------------------------------------


@query("""
SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q01_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return merge.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q02_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.missing_keys(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT c_custkey, coalesce(s.mean_bal, 0.0) AS mean_bal FROM customer c LEFT JOIN (
  SELECT s_nationkey AS k, round(avg(s_acctbal), 6) AS mean_bal FROM supplier GROUP BY s_nationkey HAVING count(*) > 3) s
ON c.c_nationkey = s.k""")
def q03_lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splits.groups_over(table(spark, sf_dir, "supplier"), ["s_nationkey"], 3).groupBy(F.col("s_nationkey").alias("c_nationkey"))
    side = s.agg(F.round(F.avg("s_acctbal"), 6).alias("mean_bal"))
    return merge.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), side, ["c_nationkey"], {"mean_bal": 0.0}).drop("c_nationkey")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) > 15")
def q04_group_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups_over(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], 15)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20")
def q05_head_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.head_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 20)


@query("""
SELECT doc_id, source, CASE WHEN r <= floor(n * 0.75) THEN 'train' WHEN r <= floor(n * 0.75) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def q06_fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fraction_split(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


@query("SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part)")
def q07_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_ids(table(spark, sf_dir, "part"), "p_brand")


@query("""
SELECT token, n, row_number() OVER (ORDER BY encode(token)) + 3 AS id FROM (
  SELECT unnest(string_split(text, '')) AS token, count(*) AS n FROM documents GROUP BY 1)""")
def q08_character_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.character_vocabulary(spread(table(spark, sf_dir, "documents").select("text")), "text")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS k, coalesce(json_extract_string(props, '$.none'), props) AS other FROM events")
def q09_json_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", text.json_or_raw(p, "k").alias("k"), text.json_or_raw(p, "none").alias("other"))


# ---- label metrics ---------------------------------------------------------------------------------------------------

_QUALITY = "SELECT l.quality AS target, CAST(d.n_chars > 1000 AS INT) AS pred, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY ALL"


@query(f"""
WITH m AS ({_QUALITY}),
k AS (SELECT coalesce(t.k, p.k) AS k, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np
      FROM (SELECT target AS k, sum(n) AS nt, sum(CASE WHEN target = pred THEN n ELSE 0 END) AS tp FROM m GROUP BY target) t
      FULL JOIN (SELECT pred AS k, sum(n) AS np FROM m GROUP BY pred) p ON t.k = p.k)
SELECT CAST(sum(nt) AS BIGINT) AS n, round(sum(tp) / sum(nt), 6) AS accuracy,
       round(avg(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END), 6) AS macro_accuracy, round(avg(2 * tp / (nt + np)), 6) AS macro_f1 FROM k""")
def q10_accuracy_and_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("p"))
    m = labels.confusion(table(spark, sf_dir, "labels").join(d, "doc_id"), "p", "quality")
    return rounded(labels.accuracy_and_f1(m))


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    raw = F.col("l_discount") * 50
    return li.select(labels.ordinal(raw, 0, 5).alias("p"), F.floor(F.col("l_quantity") / 10).cast("int").alias("t"), raw.alias("raw"))


_GRADES = """g AS (SELECT least(greatest(CAST(round_even(l_discount * 50, 0) AS INT), 0), 5) AS p, CAST(floor(l_quantity / 10) AS INT) AS t,
  l_discount * 50 AS raw FROM lineitem)"""


@query(f"""
WITH {_GRADES}, m AS (SELECT count(*) AS n, sum((t - p) * (t - p)) AS o, sum(t) AS t1, sum(t * t) AS t2, sum(p) AS p1, sum(p * p) AS p2 FROM g)
SELECT round((SELECT avg(abs(p - t)) FROM g), 6) AS mae, round(1 - o / (t2 + p2 - 2 * (t1 * p1 / n)), 6) AS qwk FROM m""")
def q11_mae_and_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labels.confusion(_grades(spark, sf_dir), "p", "t")
    return rounded(labels.mean_absolute_error(m).crossJoin(labels.weighted_kappa(m)))  # single rows


@query(f"""
WITH {_GRADES}, m AS (SELECT t, p, count(*) AS n FROM g GROUP BY t, p),
s AS (SELECT sum(CAST(a.n * b.n AS DOUBLE) * sign(b.p - a.p)) AS s FROM m a JOIN m b ON a.t < b.t),
nn AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM m),
tt AS (SELECT sum(x * (x - 1) / 2) AS tt FROM (SELECT CAST(sum(n) AS DOUBLE) AS x FROM m GROUP BY t)),
tp AS (SELECT sum(x * (x - 1) / 2) AS tp FROM (SELECT CAST(sum(n) AS DOUBLE) AS x FROM m GROUP BY p))
SELECT round((SELECT corr(raw, t) FROM g), 6) AS pearson,
       round(s / (sqrt(n * (n - 1) / 2 - tt) * sqrt(n * (n - 1) / 2 - tp)), 6) AS kendall_tau FROM s, nn, tt, tp""")
def q12_pearson_and_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grades(spark, sf_dir)
    return rounded(labels.pearson(g, "raw", "t").crossJoin(labels.kendall_tau_b(labels.confusion(g, "p", "t"))))  # single rows


# ---- geolocation -----------------------------------------------------------------------------------------------------

_PLACES = """p AS (SELECT c_custkey AS k, radians(((c_custkey * 7) % 160) - 80) AS lat, radians(((c_custkey * 13) % 340) - 170) AS lon,
  radians((((c_custkey * 7) % 160) - 80) * 0.9) AS a, radians((((c_custkey * 13) % 340) - 170) + 2) AS b, c_nationkey AS nk FROM customer)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lat, lon = (F.col("c_custkey") * 7) % 160 - 80, (F.col("c_custkey") * 13) % 340 - 170
    c = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), F.radians(lat.cast("double")).alias("lat"), F.radians(lon.cast("double")).alias("lon"), F.radians(lat * 0.9).alias("a"), F.radians((lon + 2).cast("double")).alias("b"))
    x, y, z = geolocation.to_unit(F.col("a"), F.col("b"))
    return c.withColumn("x", x).withColumn("y", y).withColumn("z", z)


@query(f"""
WITH {_PLACES} SELECT round(avg(acos(greatest(-1.0, least(1.0, sin(lat) * sin(a) + cos(lat) * cos(a) * cos(b - lon))))) * 6378.1, 4) AS distance_km FROM p""")
def q13_great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geolocation.mean_distance_km(_places(spark, sf_dir), "x", "y", "z", "lat", "lon"), 4)


_NATION_PLACES = """n AS (SELECT c_custkey AS k, radians(c_nationkey * 6.0 - 72) AS lat, radians(c_nationkey * 12.0 - 140) AS lon,
  radians(c_nationkey * 6.0 - 72 + (c_custkey % 9) - 4) AS a, radians(c_nationkey * 12.0 - 140 + (c_custkey % 23) - 11) AS b FROM customer)"""


@query(f"""
WITH {_NATION_PLACES},
g AS (SELECT DISTINCT round(lat, 6) AS lat, round(lon, 6) AS lon FROM n),
s AS (SELECT k, round(n.lat, 6) = g.lat AND round(n.lon, 6) = g.lon AS own,
        row_number() OVER (PARTITION BY k ORDER BY cos(a) * cos(b) * cos(g.lat) * cos(g.lon) + cos(a) * sin(b) * cos(g.lat) * sin(g.lon) + sin(a) * sin(g.lat) DESC, g.lat, g.lon) AS r
      FROM n CROSS JOIN g)
SELECT round(100.0 * (1 - avg(CASE WHEN r <= 2 THEN 1.0 ELSE 0.0 END)), 6) AS miss_rate FROM s WHERE own""")
def q14_miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lat, lon = F.col("c_nationkey") * F.lit(6.0) - 72, F.col("c_nationkey") * F.lit(12.0) - 140
    c = c.select(F.col("c_custkey").alias("k"), F.radians(lat).alias("lat"), F.radians(lon).alias("lon"), F.radians(lat + F.col("c_custkey") % 9 - 4).alias("a"), F.radians(lon + F.col("c_custkey") % 23 - 11).alias("b"))
    x, y, z = geolocation.to_unit(F.col("a"), F.col("b"))
    return rounded(geolocation.miss_rate(c.withColumn("x", x).withColumn("y", y).withColumn("z", z), 2, "k", "x", "y", "z", "lat", "lon"))


@query("""
SELECT o_orderstatus AS target, substr(o_orderpriority, 1, 1) AS pred, count(*) AS n FROM orders WHERE o_orderstatus <> substr(o_orderpriority, 1, 1)
GROUP BY 1, 2 ORDER BY n DESC, target, pred LIMIT 15""")
def q15_top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))
    return labels.top_confusions(labels.confusion(o, "p", "o_orderstatus"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_quantity >= 20 AS src, l_discount > 0.02 AS tgt FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, CASE WHEN a.tgt THEN coalesce((SELECT string_agg(x.p, ';' ORDER BY x.n, x.p) FROM (
         SELECT b.l_linenumber AS n, CAST(b.l_partkey AS VARCHAR) AS p FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.src
           AND b.l_linenumber <> a.l_linenumber AND abs(b.l_linenumber - a.l_linenumber) <= 2 ORDER BY 1, 2 LIMIT 5) x), '') END AS near_labels,
       CASE WHEN a.tgt THEN (SELECT count(*) FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.src) > CAST(a.src AS INT)
       END AS found_in_group
FROM l a""")
def q16_neighbour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount")
    found = merge.neighbours(li, "l_orderkey", "l_linenumber", 2, F.col("l_discount") > 0.02, F.col("l_quantity") >= 20, F.col("l_partkey").cast("string"), ["l_returnflag"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "near_labels", "found_in_group")


@query("""
WITH s AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, coalesce(string_agg(event_type, ' ' ORDER BY ts, event_id) FILTER (WHERE event_type <> 'view' AND event_type IS DISTINCT FROM before), '') AS path
FROM s GROUP BY user_id""")
def q17_ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return runs.select("user_id", F.array_join(text.ctc_collapse(F.col("s.event_type"), "view"), " ").alias("path"))


# ---- phone metrics on stand-ins --------------------------------------------------------------------------------------


#: Letters as phones of the inventory, for tables without phonetic text.
_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", ("æ", "b", "k", "d", "ɛ", "f", "ɡ", "h", "ɪ", "d͡ʒ", "k", "l", "m", "n", "oʊ", "p", "k", "ɹ", "s", "t", "ʌ", "v", "w", "z", "j", "z"), strict=True))
#: The letters of a text in SQL, those of equal phones being one.
_SPELLED = "translate(regexp_replace(lower({}), '[^a-z]', '', 'g'), 'cqx', 'kkz')"


def _phones(column: Column) -> Column:
    """The ASCII letters of a whole text as phones."""
    table_ = F.create_map(*[F.lit(x) for kv in _LETTERS.items() for x in kv])
    return F.transform(F.regexp_extract_all(F.lower(column), F.lit("([a-z])"), F.lit(1)), lambda c: F.element_at(table_, c))


@query(f"""
WITH t AS (SELECT conv_id, turn, {_SPELLED.format("text")} AS s FROM conversations),
p AS (SELECT a.conv_id, a.turn, coalesce(a.s, '') AS hyp, coalesce(b.s, '') AS ref FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, length(ref) AS n_phones, levenshtein(hyp, ref) AS per_errors,
       round(CASE WHEN length(ref) > 0 THEN 100.0 * levenshtein(hyp, ref) / length(ref) ELSE 0.0 END, 6) AS per FROM p""")
def q18_phone_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", _phones(F.col("text")).alias("h"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("h").alias("u"))
    scored = scoring.utterance_errors(spread(c.join(after, ["conv_id", "turn"])), with_counts=False)
    return rounded(scored.select("conv_id", "turn", "n_phones", "per_errors", "per"))


@query(r"""
WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]{2}')) AS token FROM conversations WHERE role IN ('user', 'assistant')),
r AS (SELECT DISTINCT token FROM w WHERE role = 'user'),
p AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS k, CAST(token IN (SELECT token FROM r) AS INT) AS hit
      FROM (SELECT token, count(*) AS n FROM w WHERE role = 'assistant' GROUP BY token)),
x AS (SELECT k, sum(hit) OVER (ORDER BY k) AS tp, (SELECT count(*) FROM r) AS nr FROM p)
SELECT CAST(max(k) AS INT) AS n_pred, max(nr) AS n_ref, CAST(max(tp) AS BIGINT) AS n_common, round(max(tp) / max(k), 6) AS precision, round(max(tp) / max(nr), 6) AS recall,
       round(2 * max(tp) / (max(k) + max(nr)), 6) AS f1, round(max(2 * tp / (k + nr)), 6) AS max_f1 FROM x""")
def q19_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pairs = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2})"), F.lit(1))
    none = F.array().cast("array<string>")
    rows = c.select(F.when(F.col("role") == "assistant", pairs).otherwise(none).alias("pred"), F.when(F.col("role") == "user", pairs).otherwise(none).alias("ref"))
    return rounded(inventory.inventory_scores(rows, "pred", "ref"))


@query("SELECT round(sum(s * ln(n)) / sum(ln(n)), 6) AS weighted_mean FROM (SELECT avg(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY c_nationkey)")
def q20_log_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("s"), F.count("*").alias("n"))
    return rounded(labels.log_weighted_mean(c, "s", "n"))


@query("SELECT o_orderkey, CAST(floor(o_orderkey / ceil((SELECT count(*) FROM orders) / 7.0)) AS BIGINT) AS chunk FROM orders")
def q21_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chunk_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("""
SELECT doc_id, 'both' AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def q22_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    both = d.intersect(m).withColumn("place", F.lit("both"))
    return both.unionByName(d.exceptAll(m).withColumn("place", F.lit("documents"))).unionByName(m.exceptAll(d).withColumn("place", F.lit("labels")))


@query("""
WITH s AS (SELECT DISTINCT c_name, c_mktsegment, lower(c_name) IN ('customer#000000003', 'customer#000000010') AS test FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, test ORDER BY c_name) AS r, count(*) OVER (PARTITION BY c_mktsegment, test) AS n FROM s)
SELECT c.c_custkey, CASE WHEN test THEN 'test' WHEN r <= least(20, n - 1) THEN 'val' ELSE 'train' END AS split
FROM customer c JOIN r ON c.c_name = r.c_name AND c.c_mktsegment = r.c_mktsegment""")
def q23_disjoint_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return splits.disjoint_speakers(c, "c_name", "c_mktsegment", ["CUSTOMER#000000003", "Customer#000000010"], 20).select("c_custkey", "split")


@query(f"""
SELECT doc_id, md5(trim(replace(replace(replace({sql.nfd("translate(text, ' ' || " + sql.quoted(string.punctuation + "ˈˌ") + ", '')")}, 'g', 'ɡ'), 'ɚ', 'ə˞'), 'ɝ', 'ɜ˞'),
  chr(10) || chr(9) || ' ')) AS digest FROM documents""")
def q24_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"""
SELECT doc_id, len(s) AS n_spans, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, {sql.skipped("text")} AS s FROM documents)""")
def q25_skipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", phones.skipped_spans(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("""
SELECT count(*) AS rows, round(avg(c_acctbal), 4) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 4) AS std, c_mktsegment FROM customer GROUP BY c_mktsegment""")
def q26_mean_and_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = c.groupBy("c_mktsegment").agg(F.count("*").alias("rows"))
    return rounded(labels.mean_and_deviation(c, ["c_mktsegment"], "c_acctbal"), 4).join(n, "c_mktsegment")


@query("SELECT event_type, event_id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def q27_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts")
    return splits.head_n(e, ["event_type"], ["ts", "event_id"], 1)


@query("SELECT event_type AS mode, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 1")
def q28_train_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.train_mode(table(spark, sf_dir, "events"), "event_type", "event_id").select(F.col("event_type").alias("mode"), "n")


@query("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""")
def q29_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.incremental import event_rates

    w = event_rates(table(spark, sf_dir, "events"), "ts", "event_type")
    return rounded(w.select("event_type", F.col("window.start").alias("hour"), "n", "mean_value"))


@query("""
SELECT s_suppkey, round(min(h), 4) AS nearest_km FROM (
  SELECT s_suppkey, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(d - c) / 2), 2)))) AS h
  FROM (SELECT s_suppkey, (s_suppkey % 120) - 60.0 AS a, (s_suppkey * 17 % 300) - 150.0 AS c, n_nationkey * 5.0 - 60 AS b, n_nationkey * 11.0 - 130 AS d
        FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5))
GROUP BY s_suppkey""")
def q30_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("r"), (F.col("s_suppkey") % 120 - F.lit(60.0)).alias("a"), (F.col("s_suppkey") * 17 % 300 - F.lit(150.0)).alias("c"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), (F.col("n_nationkey") * F.lit(5.0) - 60).alias("b"), (F.col("n_nationkey") * F.lit(11.0) - 130).alias("d"))
    return s.join(n, "r").groupBy("s_suppkey").agg(F.round(F.min(geolocation.haversine_km(F.col("a"), F.col("c"), F.col("b"), F.col("d"))), 4).alias("nearest_km"))


@query(r"""
WITH c AS (SELECT c_custkey, c_acctbal || CASE c_custkey % 4 WHEN 0 THEN ' S' WHEN 1 THEN ' N' WHEN 2 THEN ' degrees W' ELSE '' END AS place FROM customer)
SELECT 'c' || c_custkey AS id, regexp_extract(place, '[-+]?\d+(?:\.\d+)?') AS number, nullif(regexp_extract(place, '(\d{6})', 1), '') AS six,
  CASE WHEN regexp_matches(place, '[SW]') THEN -1 ELSE 1 END * CAST(regexp_extract(place, '[-+]?\d+(?:\.\d+)?') AS DOUBLE) AS coordinate FROM c
UNION ALL
SELECT 'd' || doc_id, regexp_extract(text, '[-+]?\d+(?:\.\d+)?'), nullif(regexp_extract(text, '(\d{6})', 1), ''),
  CASE WHEN regexp_matches(text, '[SW]') THEN -1 ELSE 1 END * TRY_CAST(nullif(regexp_extract(text, '[-+]?\d+(?:\.\d+)?'), '') AS DOUBLE) FROM documents""")
def q31_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.element_at(F.array(F.lit(" S"), F.lit(" N"), F.lit(" degrees W"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.col("c_acctbal").cast("string"), sides).alias("t"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    t = F.col("t")
    return c.unionByName(d).select("id", text.first_number(t).alias("number"), text.six_digits(t).alias("six"), text.coordinate(t).alias("coordinate"))


@query("""
SELECT p_partkey, p_name || ' by ' || p_brand || ' (' || coalesce(CAST(p_size AS VARCHAR), '') || ')' AS prompt,
       CASE WHEN ends_with(p_name, 'ring') THEN 'ring' ELSE 'other' END AS kind FROM part""")
def q32_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    prompt = text.render_template("{name} by {brand} ({size})", {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")})
    return p.select("p_partkey", prompt.alias("prompt"), F.when(F.col("p_name").endswith("ring"), "ring").otherwise("other").alias("kind"))


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, min(o_totalprice) OVER w AS best, o_totalprice = min(o_totalprice) OVER w AS is_best
FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def q33_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return tables.running_best(o, ["o_custkey"], "o_orderkey", "o_totalprice").drop("o_totalprice")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0) ORDER BY c_custkey DESC""")
def q34_pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are customers; the done ones have an order of a ninth of all orders, the rest is pending."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    runs = c.select("c_custkey", "c_name", F.col("c_custkey").alias("m"))
    done = o.where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return tables.pending_runs(runs, done, "c_custkey", "m").drop("m")


@query("""
SELECT s_nationkey, count(*) AS n, count(DISTINCT s_name) AS members, round(avg(s_acctbal), 4) AS mean, round(stddev_pop(s_acctbal), 4) AS std
FROM supplier GROUP BY s_nationkey""")
def q35_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.group_statistics(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_name", "s_acctbal"), 4)


@query("""
SELECT conv_id, turn, i - 1 AS place, w[i] AS name, length(w[i]) AS value
FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[a-z]+') AS w FROM conversations))""")
def q36_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    return tables.long_form(c.withColumn("l", F.transform("w", lambda x: F.length(x).cast("long"))), ["conv_id", "turn"], "w", "l")


@query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'SMALL' THEN 'low' WHEN 'PROMO' THEN 'high' ELSE 'other' END AS cluster
FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')""")
def q37_map_and_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.excluded(table(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#2"])
    return p.select("p_partkey", tables.mapped(F.col("p_type"), {"ECONOMY": "low", "SMALL": "low", "PROMO": "high"}, "other").alias("cluster"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(1 / (1 + exp(-(l_discount * 100 - 3))) > 0.5 AS INT) + CAST(1 / (1 + exp(-(l_quantity - 25.5))) > 0.5 AS INT)
  + CAST(1 / (1 + exp(-(l_tax * 100 - 6.5))) > 0.5 AS INT) AS grade FROM lineitem""")
def q38_ordinal_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    logits = F.array(F.col("l_discount") * 100 - 3, F.col("l_quantity") - 25.5, F.col("l_tax") * 100 - 6.5)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", tables.ordinal_from_logits(logits).alias("grade"))


@query("""
SELECT doc_id, split FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'test' END AS split, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
WHERE coalesce(nullif(split, 'train'), 'test') = 'test' AND lang IS NOT NULL""")
def q39_test_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    m = table(spark, sf_dir, "labels").select("doc_id", F.lit("test").alias("split"))
    joined = d.join(m, "doc_id", "left").where("lang is not null")
    return joined.where(labels.in_test_split(F.col("split"))).select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("""
SELECT user_id, round(min(a), 6) AS min_a, round(max(a), 6) AS max_a, round(avg(l), 6) AS mean_loss FROM (
  SELECT user_id, cos(value) AS a, acos(greatest(-1 + 1e-7, least(1 - 1e-7, cos(value)))) AS l FROM events) GROUP BY user_id""")
def q40_angular_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.cos("value").alias("a"))
    e = e.withColumn("l", geolocation.angular_loss(F.col("a")))
    return rounded(e.groupBy("user_id").agg(F.min("a").alias("min_a"), F.max("a").alias("max_a"), F.avg("l").alias("mean_loss")))


# ---- phones of whole texts ------------------------------------------------------------------------------------------


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(language, utt_id, canonical, transcription, prediction): three turns in a row, whole, spelled in phones."""
    spelled = F.array_join(_phones(F.col("text")), " ")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", spelled.alias("p")).where("p <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = c.withColumn("u", F.lead("p", 1).over(w)).withColumn("h", F.lead("p", 2).over(w)).where("u is not null")
    utt = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    out = t.select(F.col("role").alias("language"), utt.alias("utt_id"), F.col("p").alias("canonical"), F.col("u").alias("transcription"), F.coalesce("h", F.lit("")).alias("prediction"))
    return spread(out)


@query()
def r01_mdd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole turns; their joint alignment is in ``r12_joint_mdd``."""
    return scoring.summarize(scoring.score_utterances(_triples(spark, sf_dir)), ["language"])


@query()
def r02_slot_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sequences, which every slot's row repeats, are left out before the rows are sorted."""
    rows = slots.slot_rows(_triples(spark, sf_dir)).drop("canonical_seq", "uttered_seq", "predicted_seq")
    return slots.mark_suspects(rows)


@query(f"""
SELECT doc_id, md5(normalized) AS digest, normalized <> text AS changed, rule_ids, {sql.looks_like_ipa("text")} AS looks_like_ipa FROM ({sql.audit("documents", "doc_id", "text")})
UNION ALL
SELECT -1 - event_id, md5(normalized), normalized <> text, rule_ids, {sql.looks_like_ipa("text")}
FROM ({sql.audit("(SELECT event_id, translate(event_type, 'vcokrp', 'ʃɕʈɚrp') || CASE event_id % 3 WHEN 0 THEN 'tʃ pʰaː' WHEN 1 THEN '' ELSE ' x' END AS x FROM events)", "event_id", "x")})""")
def r03_normalization_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, and words of IPA made of event types."""
    made = F.concat(F.translate("event_type", "vcokrp", "ʃɕʈɚrp"), F.element_at(F.array(F.lit("tʃ pʰaː"), F.lit(""), F.lit(" x")), (F.col("event_id") % 3 + 1).cast("int")))
    e = table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("doc_id"), made.alias("text"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(e))
    out = ipa.normalize_with_audit(d, "text", "r")
    return out.select("doc_id", F.md5(F.col("r.normalized").cast("binary")).alias("digest"), "r.changed", F.array_join("r.rule_ids", ";").alias("rule_ids"), ipa.looks_like_ipa(F.col("text")).alias("looks_like_ipa"))


@query(f"""
WITH s AS (SELECT doc_id, {sql.segment("text")} AS s FROM documents), p AS (SELECT doc_id, len(s) AS n, {sql.project("s")} AS p FROM s)
SELECT doc_id, CAST(n AS INT) AS n_tokens, CAST(len(p) AS INT) AS n_phones, md5(coalesce(array_to_string(p, ' '), '')) AS digest FROM p""")
def r04_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", phones.segment(F.col("text")).alias("s"))
    d = d.select("doc_id", F.size("s").alias("n_tokens"), phones.project_tokens(F.col("s")).alias("p"))
    return d.select("doc_id", "n_tokens", F.size("p").alias("n_phones"), F.md5(F.array_join("p", " ").cast("binary")).alias("digest"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN length(text) % 97 = 0 THEN '' ELSE md5(text) END AS processed_transcript,
       CASE WHEN length(text) % 97 = 0 THEN '' ELSE text END AS predicted_transcript,
       CASE WHEN length(text) % 97 = 0 THEN 'RuntimeError' END AS error_type, CASE WHEN length(text) % 97 = 0 THEN 'refused' END AS error_message FROM documents""")
def r05_apply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callable on each row, resumed: half of the results are there already."""

    def factory() -> Callable[..., list[dict[str, str]]]:
        import hashlib

        def call(text: str, **_: object) -> list[dict[str, str]]:
            if len(text) % 97 == 0:
                raise RuntimeError("refused")
            return [{"processed_transcript": hashlib.md5(text.encode()).hexdigest(), "predicted_transcript": text}]

        return call

    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = apply.run_on_rows(d.where("doc_id % 2 = 0"), "doc_id", factory)
    out = apply.resume(d, done, "doc_id", factory)
    return out.select("key", "processed_transcript", "predicted_transcript", F.col("error.type").alias("error_type"), F.col("error.message").alias("error_message"))


@query(f"""
WITH s AS (SELECT doc_id, unnest({sql.skipped("text")}) AS span FROM documents),
n AS (SELECT span, count(*) AS n FROM s GROUP BY span),
e AS (SELECT span, doc_id FROM (SELECT DISTINCT span, doc_id FROM s) QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id) <= 5)
SELECT span, n, array_to_string(list_transform(string_split(span, ''), lambda c: printf('U+%04X', unicode(c))), ' ') AS code_points,
       (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM e WHERE e.span = n.span) AS examples FROM n""")
def r06_span_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.skipped_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", "text")
    return audit.span_counts(rows).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query()
def r07_feature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scoring.project_triplet(_triples(spark, sf_dir))
    return t.select("utt_id", features.feature_edit_distance("h", "u").alias("fed"), align.sub_ins_del("h", "u").alias("e")).select("utt_id", "fed", "e.sub", "e.ins", "e.del")


# ---- operators without an SQL form: rows only -----------------------------------------------------------------------


@query()
def r08_conversation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return splits.conversation_split(e, "user_id", "event_type")


@query()
def r09_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.few_shot(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "all_class", seed=1)


@query()
def r10_chance_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    runs = [rounded(labels.accuracy_and_f1(labels.confusion(splits.chance_predictions(rows, "doc_id", "int", seed), "guess", "quality"))).withColumn("seed", F.lit(seed)) for seed in range(5)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return labels.mean_and_deviation(out.withColumn("metric", F.lit("accuracy")), ["metric"], "accuracy")


#: Documents that hold an event's properties in place of each question mark.
_NESTED = (
    '{"target": ?}',
    '{"a": [{"b": 1}, {"target": ?, "targets": "x"}]}',
    '{"a": {"b": [[{"c": {"target": ?}}]]}, "target": {"target": ?}}',
    '{"a": [0, {"b": {"c": {"d": [{"target": ?}, {"target": 5}, "target", {"target": ?}]}}}]}',
)


@query(f"""
WITH d AS (SELECT event_id, CASE event_id % 4 {" ".join(f"WHEN {k} THEN " + " || to_json(props) || ".join(f"'{p}'" for p in v.split("?")) for k, v in enumerate(_NESTED))} END AS j FROM events WHERE props IS NOT NULL)
SELECT event_id AS id, t.fullkey AS path, t.value ->> '$' AS value FROM d, json_tree(d.j) t WHERE t.key = 'target' AND t.type = 'VARCHAR'""")
def r11_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties within documents of up to seven levels."""
    e = table(spark, sf_dir, "events").where("props is not null")
    own = F.regexp_replace(F.to_json(F.array("props")), r"^\[|\]$", "")
    shapes = [F.replace(F.lit(v), F.lit("?"), own) for v in _NESTED]
    e = spread(e.select("event_id", F.get(F.array(*shapes), (F.col("event_id") % 4).cast("int")).alias("j")))
    return audit.walk_json(e, "event_id", "j", "target")


@query()
def r12_joint_mdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint alignment of three whole turns in a row."""
    t = scoring.project_triplet(_triples(spark, sf_dir)).withColumn("joint_mdd", align.joint_mdd("c", "u", "h"))
    return scoring.detection_metrics(t.groupBy("language").agg(*scoring.sum_counts("Joint_", "joint_mdd")), "Joint_")


from . import corpus_queries, sequence_queries  # noqa: E402,F401 - these register their queries
