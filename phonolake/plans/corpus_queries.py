"""Sources, sinks, filters, joins and text functions as queries: tables are written in the formats of corpora and runs, read
by the sources, and held against SQL over the tables themselves."""

from __future__ import annotations

import mimetypes
import string
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import phones, text, vocabulary
from ..operators import align, apply, features, geolocation, labels, merge, scoring, slots, splits, tables
from ..plans import evaluation
from ..session import scratch_folder, spread
from ..sinks import files
from ..sources import kaldi, predictions, shards
from ..sources import tables as sources
from ..streaming import running
from . import sql
from .queries import _LETTERS, _SPELLED, _phones, query, rounded, table

_WAV = mimetypes.guess_type("x.wav")[0]
_FLAT = r"regexp_replace(text, '[\x20\t\n]+', ' ', 'g')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(key.alias("utt"), "conv_id", "turn", "role", F.regexp_replace("text", r"[ \t\n]+", " ").alias("flat"))


@query(rf"""
SELECT conv_id || '-' || turn AS utt_id, CASE WHEN turn % 2 = 0 THEN '/abs/' || conv_id || '.wav:' || turn ELSE 'DIR/a/' || conv_id || '.wav' END AS wav_path,
       trim({_FLAT}) AS text, role AS language, CASE WHEN turn = 0 THEN trim({_FLAT}) END AS canonical
FROM conversations WHERE trim({_FLAT}) <> ''""")
def q41_kaldi_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings, texts, languages and canonical texts as keyed files; the last line of a key counts."""
    folder = scratch_folder(spark, "corpus")
    t = _turns(spark, sf_dir).where(F.trim("flat") != "")
    wav = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/abs/"), "conv_id", F.lit(".wav:"), "turn")).otherwise(F.concat(F.lit("a/"), "conv_id", F.lit(".wav")))
    t.select(F.concat_ws(" ", "utt", wav)).write.text(f"{folder}/wav.scp")
    t.select(F.concat_ws("  ", "utt", "flat")).write.text(f"{folder}/text.good")
    t.select(F.concat("utt", F.lit(" <"), "role", F.lit("><x>"))).write.text(f"{folder}/text.lang")
    t.where("turn = 0").select(F.concat_ws("\t", "utt", "flat")).write.text(f"{folder}/text.canonical")
    corpus = kaldi.read_corpus(spark, folder, absolute_prefix="/abs")
    return corpus.withColumn("wav_path", F.replace("wav_path", F.lit(folder), F.lit("DIR")))


@query("""
SELECT role AS language, conv_id || '-' || turn AS utt_id, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS prediction, CASE WHEN turn % 2 = 0 THEN '' ELSE lower(text) END AS transcription,
       CASE WHEN turn = 0 THEN 'side ' || conv_id WHEN turn = 1 THEN 'own' END AS canonical FROM conversations""")
def q42_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as shards twice, the later shard winning; failed ones are empty; a side file overrides."""
    folder = scratch_folder(spark, "run")
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    one = F.struct(F.col("text").alias("processed_transcript"), F.lower("text").alias("predicted_transcript"))
    none = F.array().cast("array<struct<processed_transcript: string, predicted_transcript: string>>")
    own = F.struct(
        key.alias("utt_id"), F.col("role").alias("lang_sym"), F.when(F.col("turn") == 1, "own").alias("canonical_ipa"),
        F.when(F.col("turn") % 2 == 1, F.lower("text")).alias("target"), F.array(F.lit("[NOISE]"), "text").alias("masked_phones"),
    )
    files.write_shards(c.select(key.alias("sample_key"), none.alias("pred"), own.alias("passthrough")), f"{folder}/part=0.jsonl")
    files.write_shards(c.select(key.alias("sample_key"), F.when(F.col("turn") % 3 == 2, none).otherwise(F.array(one)).alias("pred"), own.alias("passthrough")), f"{folder}/part=1.jsonl")
    c.where("turn % 3 = 2").select(F.to_json(F.struct(key.alias("key")))).write.text(f"{folder}/a.errors.jsonl")
    rows = predictions.read_shards(spark, folder)
    merged = rows.select(F.col("sample_key").alias("key"), merge.first_prediction(F.col("pred")).alias("processed_transcript"))
    merge.check_errors_represented(predictions.read_error_keys(spark, folder), merged)
    side = c.where("turn = 0").select(key.alias("utt_id"), F.concat(F.lit("side "), "conv_id").alias("text"))
    return evaluation.scoring_input(rows, "target", side)


def _text_shard(d: DataFrame, text: Column, path: str) -> None:
    files.write_shards(d.select(F.col("doc_id").cast("string").alias("sample_key"), F.array(F.struct(text.alias("processed_transcript"))).alias("pred"), F.struct(F.col("lang").alias("lang_sym")).alias("passthrough")), path)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS sample_key, lang AS lang_sym, CASE WHEN doc_id % 3 = 0 THEN 'old ' || coalesce(text, '') ELSE text END AS processed_transcript,
       CASE WHEN doc_id IN (7, 8) THEN 1 ELSE 0 END AS pushed FROM documents""")
def q62_shard_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as shards of two runs, read by the data source in ranges of bytes, the later run winning; two keys are also
    read by a filter."""
    folder = scratch_folder(spark, "source")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    _text_shard(d, F.concat(F.lit("old "), F.coalesce("text", F.lit(""))), f"{folder}/part=0.jsonl")
    _text_shard(d.where("doc_id % 3 <> 0"), F.col("text"), f"{folder}/part=1.jsonl")
    d.select(F.lit('{"1": {"pred": 5}}').alias("value")).write.text(f"{folder}/a.errors.jsonl")
    rows = shards.read_shards(spark, folder, split_bytes=str(1 << 20))
    few = shards.read_shards(spark, folder).where(F.col("sample_key").isin("7", "8")).select("sample_key", F.lit(1).alias("pushed"))
    rows = rows.select("sample_key", F.col("passthrough.lang_sym").alias("lang_sym"), F.col("pred")[0]["processed_transcript"].alias("processed_transcript"))
    return rows.join(few, "sample_key", "left").withColumn("pushed", F.coalesce("pushed", F.lit(0)))


@query("""
SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 4 < 3 THEN 'kept ' || doc_id % 4 ELSE md5(coalesce(text, '')) END AS processed_transcript, coalesce(text, '') AS predicted_transcript FROM documents""")
def q64_resume_from_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that goes on from its own cache and those of three workers, with errors among them that are run again; the key is a name where
    a position is asked for."""

    def digests(left: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        none = F.lit(None).cast("struct<type: string, message: string>")
        return left.select(F.col("name").alias("key"), F.md5(text).alias("processed_transcript"), text.alias("predicted_transcript"), none.alias("error"))

    folder = scratch_folder(spark, "caches")
    d = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("idx"), F.concat(F.lit("d"), "doc_id").alias("utt_id"), "doc_id", "text")
    error = F.when(F.col("doc_id") % 4 == 3, F.struct(F.lit("E").alias("type"), F.lit("lost").alias("message")))
    kept = F.concat(F.lit("kept "), (F.col("doc_id") % 4).cast("string"))
    line = F.to_json(F.struct(F.col("utt_id").alias("key"), F.array(F.struct(kept.alias("processed_transcript"), F.coalesce("text", F.lit("")).alias("predicted_transcript"), error.alias("error"))).alias("pred")))
    for rest, name in ((0, "run.jsonl"), (1, "run.0.3.jsonl"), (2, "run.1.3.jsonl"), (3, "run.2.3.jsonl"), (3, "other.0.3.jsonl")):
        d.where(F.col("doc_id") % 4 == rest).select(line).write.text(f"{folder}/{name}")
    done = predictions.read_worker_caches(spark, f"{folder}/run.1.3.jsonl")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        keyed = d.select(apply.cache_key(d, "idx").alias("name"), "text")
    return apply.resume_by(keyed, done, "name", digests).select("key", "processed_transcript", "predicted_transcript")


@query("""
SELECT lang AS "group", count(*) AS n, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE length(coalesce(text, '')) END) AS BIGINT) AS letters,
       CAST(count(*) FILTER (WHERE doc_id % 3 = 0) AS BIGINT) AS old FROM documents GROUP BY lang""")
def q63_running_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by language over the last writers, as a stream of shards: a run, then a repeated shard and one of an earlier name that both
    come late, after the stream was started again."""
    folder, out, state = (scratch_folder(spark, name) for name in ("arriving", "sums", "progress"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = shards.stream_shards(spark, folder)
    text_of = F.coalesce(F.col("rec.pred")[0]["processed_transcript"], F.lit(""))
    rows = rows.select("file", "offset", "sample_key", F.col("rec.passthrough.lang_sym").alias("lang"), F.length(text_of).alias("letters"), (text_of == "o").cast("long").alias("old"))
    measures = ["letters", "old"]
    steps = [
        [(d.where("doc_id % 3 = 1"), F.col("text"), "part=1.jsonl"), (d.where("doc_id % 3 = 0"), F.lit("o"), "part=0.jsonl")],
        [(d.where("doc_id % 3 <> 0"), F.col("text"), "part=2.jsonl"), (d.where("doc_id % 3 = 1"), F.lit("late"), "part=0b.jsonl")],
    ]
    for step in steps:
        for part, text_column, name in step:
            _text_shard(part, text_column, f"{folder}/{name}")
        running.start_sums(rows, "sample_key", "lang", measures, out, state).awaitTermination()
    return running.current_sums(spark, out, measures)


@query("""
SELECT role AS language, conv_id || '-' || turn AS utt_id, text AS prediction, role || turn AS transcription, CAST(NULL AS VARCHAR) AS canonical, 1 AS kinds FROM conversations""")
def q43_merged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object with a key for each turn, read in ranges of bytes; the phones of the passthrough that are no noise;
    the folder is discovered."""
    folder = scratch_folder(spark, "merged")
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    passed = F.struct(F.col("role").alias("lang_sym"), F.array("role", F.lit("[NOISE]"), F.col("turn").cast("string")).alias("masked_phones"))
    rec = F.struct(F.array(F.struct(F.col("text").alias("processed_transcript"))).alias("pred"), passed.alias("passthrough"))
    files.write_document(c.select(key.alias("key"), F.to_json(rec).alias("value")), f"{folder}/run/out.json", "key", "key")
    for name in ("out.json", "shard.jsonl"):
        files.write_small(spark, f"{folder}/found/{name}", "{}")
    kinds = predictions.discover(spark, f"{folder}/found").count()
    rows = predictions.read_merged(spark, f"{folder}/run/out.json")
    return evaluation.scoring_input(rows).withColumn("kinds", F.lit(kinds))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE '' END AS predicted_transcript,
       CASE c_custkey % 4 WHEN 2 THEN 'BatchError' WHEN 3 THEN 'MissingBatchResult' END AS kind, CASE c_custkey % 4 WHEN 2 THEN 'refused' WHEN 3 THEN 'no result for this key' END AS message,
       'a/' || c_custkey || '.wav' AS audio_path, 'say ' || c_name AS prompt, 'WAV' AS mime_type FROM customer""".replace("WAV", _WAV))
def q44_batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and requests are written, results come back for some keys, as text, as parts, or as errors."""
    folder = scratch_folder(spark, "batch")
    c = table(spark, sf_dir, "customer")
    samples = c.select("c_custkey", "c_name", F.concat(F.lit("a/"), "c_custkey", F.lit(".wav")).alias("wav"))
    files.write_requests(samples, folder, "c_custkey", text.render_template("say {name}", {"name": F.col("c_name")}), "wav")
    kind = F.col("c_custkey") % 4
    parts = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("c_mktsegment").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    answer = F.struct(F.when(kind == 0, F.struct(F.col("c_name").alias("text"))).alias("t"), F.when(kind == 1, parts).alias("p"))
    lines = c.where(kind < 3).select(F.to_json(F.struct(
        F.col("c_custkey").cast("string").alias("key"),
        F.from_json(F.coalesce(F.to_json(answer["t"]), F.to_json(answer["p"])), "text string, candidates array<struct<content: struct<parts: array<struct<text: string>>>>>").alias("response"),
        F.when(kind == 2, F.struct(F.lit("refused").alias("message"))).alias("error"),
    )))
    lines.write.text(f"{folder}/results")
    manifest = predictions.read_json_lines(spark, f"{folder}/manifest", "key string, audio_path string")
    requests = predictions.read_json_lines(spark, f"{folder}/requests", "key string, request struct<parts: array<struct<text: string>>, mime_type: string, file: string>")
    found = merge.collect_batch_results(manifest, spark.read.schema(schemas.BATCH_RESULT).json(f"{folder}/results"))
    out = found.join(requests, "key")
    return out.select("key", "predicted_transcript", F.col("error.type").alias("kind"), F.col("error.message").alias("message"), "audio_path", F.col("request.parts")[0]["text"].alias("prompt"), F.col("request.mime_type").alias("mime_type"))


@query("""
SELECT 'csv' AS source, s_suppkey AS id, s_name AS name, s_acctbal AS value FROM supplier UNION ALL
SELECT 'field', event_id, event_type, value FROM events UNION ALL
SELECT 'summary', n_nationkey, n_name, 2.0 FROM nation UNION ALL
SELECT 'alias', r_regionkey, r_name, 0.0 FROM region""")
def q45_tables_and_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV table in folders, nested Parquet fields, a summary appended twice, and the copy of merged predictions."""
    folder = scratch_folder(spark, "tables")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    files.write_table(s, f"{folder}/csv", ["s_nationkey"])
    csv = sources.read_csv(spark, f"{folder}/csv/*", "s_suppkey long, s_name string, s_acctbal double").select(F.lit("csv").alias("source"), "s_suppkey", "s_name", "s_acctbal")
    e = table(spark, sf_dir, "events").select(F.struct("event_id", F.struct("event_type", "value").alias("inner"), "props").alias("rec"))
    e.write.parquet(f"{folder}/nested")
    fields = sources.read_fields(spark, [f"{folder}/nested"], ["rec.event_id", "rec.inner.event_type", "rec.inner.value"]).select(F.lit("field"), "event_id", "event_type", "value")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        files.append_summary_csv(n, f"{folder}/summary.csv")
    kept = sources.read_csv(spark, f"{folder}/summary.csv", "n_nationkey long, n_name string").groupBy("n_nationkey", "n_name").agg(F.count("*").cast("double").alias("n")).select(F.lit("summary"), "n_nationkey", "n_name", "n")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    files.write_merged(r, r, r, f"{folder}/merged", "latest")
    alias = spark.read.schema("r_regionkey long, r_name string").json(f"{folder}/merged/latest").select(F.lit("alias"), "r_regionkey", "r_name", F.lit(0.0))
    return csv.union(fields).union(kept).union(alias).toDF("source", "id", "name", "value")


@query("""
SELECT n_nationkey AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'val' WHEN 3 THEN 'val' END AS split, false AS cached FROM nation WHERE n_regionkey < 4
UNION ALL SELECT s_suppkey, s_name, 'cache', true FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT row_number() OVER (ORDER BY r_name) - 1, r_name, 'vocabulary', false FROM region""")
def q46_transcripts_and_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with synonyms of splits, a cache of predictions without its errors, and a vocabulary file."""
    folder = scratch_folder(spark, "transcripts")
    n = table(spark, sf_dir, "nation")
    names = F.element_at(F.array(*map(F.lit, ("TRAIN", "test", "Dev", "validation", "other"))), (F.col("n_regionkey") + 1).cast("int"))
    rec = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), names.alias("split"))
    files.write_document(n.select("n_nationkey", F.to_json(rec).alias("value")), f"{folder}/all.json", "n_nationkey")
    rows = sources.read_transcripts(spark, f"{folder}/all.json", "id long, name string, split string").select("id", "name", "split", F.lit(False).alias("cached"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("processed_transcript"), F.when(F.col("s_suppkey") % 2 == 1, "bad").alias("error"))
    files.write_cache(s, f"{folder}/cache")
    cache = files.read_cache(spark, f"{folder}/cache").select(F.col("key").cast("long"), "processed_transcript", F.lit("cache"), F.lit(True))
    r = [x["r_name"] for x in table(spark, sf_dir, "region").orderBy("r_name").collect()]
    files.write_small(spark, f"{folder}/tokens.txt", "\n".join(r) + "\n")
    words = kaldi.read_vocabulary(spark, f"{folder}/tokens.txt").select(F.col("id").cast("long"), "token", F.lit("vocabulary"), F.lit(False))
    return rows.union(cache).union(words)


_FILLED = "(SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)"
_RESPONSE = rf"""(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' <think> ' || source || ' </think> ' || text WHEN 1 THEN ' <think>' || source ELSE text END AS r FROM {_FILLED})"""


@query(rf"""
SELECT doc_id, md5(regexp_replace(CASE doc_id % 3 WHEN 1 THEN '' WHEN 0 THEN lang || '  ' || text ELSE text END, '^{sql.SPACE}+|{sql.SPACE}+$', '', 'g')) AS answer,
       CASE doc_id % 3 WHEN 2 THEN '' ELSE source END AS thought,
       md5(replace({sql.nfd("translate(regexp_replace(r, '" + sql.SPACE + "', '', 'g'), " + sql.quoted(string.punctuation) + ", '')")}, 'g', 'ɡ')) AS cleaned,
       md5(replace(replace(replace({sql.nfd("translate(r, " + sql.quoted(string.punctuation + "ˈˌ") + ", '')")}, 'g', 'ɡ'), 'ɚ', 'ə˞'), 'ɝ', 'ɜ˞')) AS token
FROM (SELECT d.doc_id, d.lang, d.source, d.text, x.r FROM {_FILLED} d JOIN {_RESPONSE} x ON d.doc_id = x.doc_id)""")
def q47_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts are split from answers, and answers cleaned, over whole texts."""
    d = table(spark, sf_dir, "documents").fillna("", ["lang", "source", "text"])
    r = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" <think> "), "source", F.lit(" </think> "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" <think>"), "source")).otherwise(F.col("text"))
    d = spread(d.select("doc_id", r.alias("r")))
    answer, thought = text.thought_split(F.col("r"))
    digest = lambda c: F.md5(c.cast("binary"))
    # clean_token strips white space at both ends, the SQL's texts have it inside only
    return d.select("doc_id", digest(answer).alias("answer"), thought.alias("thought"), digest(text.clean_response(F.col("r"))).alias("cleaned"), digest(F.concat(
        F.regexp_extract("r", r"^(\s*)", 1), text.clean_token(F.col("r")), F.regexp_extract(F.translate("r", string.punctuation, ""), r"(\s*)$", 1))).alias("token"))


_NAMES = {letter: phones.ARPABET[p] for letter, p in _LETTERS.items()}


def _named(values: dict[str, str]) -> str:
    """The letters of a segment's name, each as its value, with spaces between them."""
    keys, shown = (", ".join(map(sql.quoted, x)) for x in (values.keys(), values.values()))
    return f"array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment), '[a-z]'), lambda x: map_extract_value(MAP([{keys}], [{shown}]), x)), ' ')"


@query(r"""
SELECT c_custkey, 'DIR' || c_nationkey AS speaker, 'C' || c_custkey AS conversation, CASE c_custkey % 3 WHEN 0 THEN 'WAV' WHEN 1 THEN 'application/json' ELSE 'application/octet-stream' END AS mime,
       c_custkey % 2 = 0 AS no_audio, round(c_acctbal, 2) AS reported, lower(c_mktsegment) AS language, 'a,' || c_mktsegment AS kept, c_name AS last,
       '20240131_2359' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS tag, IPA AS ipa, ARPABET AS arpabet, 'p ' || c_mktsegment AS phonemes,
       c_acctbal >= 0 AND c_custkey <= 180 AS place_ok, c_custkey >= 8000 AS long_enough, c_custkey % 5 = 0 OR c_custkey = 7 AS microphone, '{"k": "' || c_name || '"}' AS braces, c_name AS json_value
FROM customer""".replace("WAV", _WAV).replace("IPA AS", f"{_named({k: phones.IPA_OF_ARPABET[v] for k, v in _NAMES.items()})} AS").replace("ARPABET AS", f"{_named(_NAMES)} AS"))
def q48_small_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    suffix = F.element_at(F.array(F.lit(".WAV"), F.lit(".json"), F.lit(".odd")), (key % 3 + 1).cast("int"))
    path = F.concat(F.lit("x/DIR"), "c_nationkey", F.lit("/C"), "c_custkey", F.lit("_s1"), suffix)
    said = F.when(key % 2 == 0, "Sorry: audio was\n not provided").otherwise(F.col("c_name"))
    answer = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("p").alias("Phoneme"), ), F.struct(F.col("c_mktsegment").alias("Phoneme"))).alias("Phonemes"))).alias("Words"))).alias("NBest")))
    words = F.concat(F.lit('so: {"k": "'), "c_name", F.lit('"} there'))
    names = phones.to_arpabet(_phones(F.col("c_mktsegment")))
    moment = F.to_timestamp(F.concat(F.lit("2024-01-31 23:59:"), F.lpad((key % 60).cast("string"), 2, "0")))
    return c.select(
        "c_custkey", text.speaker_of_path(path).alias("speaker"), text.conversation_of_path(path).alias("conversation"), text.mime_type(path).alias("mime"),
        text.says_no_audio(said).alias("no_audio"), F.round(text.reported_mean(F.concat(F.lit("\\ms{"), F.col("c_acctbal").cast("string"), F.lit("}{1.3}"))), 2).alias("reported"),
        text.language_of(F.concat(F.lit("<"), F.lower("c_mktsegment"), F.lit("><b>"))).alias("language"),
        F.array_join(text.without_special(F.array(F.lit("<s>"), F.lit("a"), "c_mktsegment", F.lit("</s>")), ["<s>", "</s>"]), ",").alias("kept"),
        text.last_segment(F.concat(F.lit("a>b>"), "c_name")).alias("last"), text.run_tag(moment).alias("tag"),
        F.array_join(phones.read_arpabet(F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("1"))), " ")), " ").alias("ipa"),
        F.array_join(phones.to_arpabet(phones.from_arpabet(F.transform(names, lambda n: F.concat(F.lower(n), F.lit("0"))))), " ").alias("arpabet"),
        text.best_phonemes(answer).alias("phonemes"), (geolocation.valid_degrees(F.least(F.col("c_acctbal"), F.lit(90)) * F.when(F.col("c_acctbal") < 0, 1000).otherwise(1), key.cast("double")) & (F.col("c_acctbal") >= 0)).alias("place_ok"),
        sources.long_enough(key).alias("long_enough"), sources.keep_microphone(F.concat("c_custkey", F.when(key % 5 == 0, "_M5").otherwise("_M2")), ["7_M2"]).alias("microphone"),
        text.json_in_braces(words).alias("braces"), text.json_answer(words, "k").alias("json_value"),
    )


@query("""
WITH g AS (SELECT l_returnflag AS grp, count(*) FILTER (l_quantity < 10) AS a, count(*) FILTER (l_quantity >= 10 AND l_quantity < 40) AS ta, count(*) FILTER (l_quantity >= 40 AND l_discount < 0.03) AS fr,
             count(*) FILTER (l_quantity >= 40 AND l_discount >= 0.03 AND l_tax < 0.05) AS fa, count(*) FILTER (l_quantity < 10 AND l_tax < 0.05) AS cd FROM lineitem GROUP BY 1),
m AS (SELECT *, a - cd AS de, cd / (a + fr) AS p, cd / (a + fa) AS r FROM g),
x AS (SELECT grp, round((a + ta) / (a + ta + fr + fa), 6) AS accuracy, round((fr + fa + de) / (a + ta + fr + fa), 6) AS error_rate, round(fr / (fr + ta), 6) AS frr, round(fa / (fa + a), 6) AS far,
             round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 6) AS f1, round(cd / a, 6) AS da, round(de / a, 6) AS der FROM m)
SELECT * FROM x UNION ALL SELECT 'macro', round(avg(accuracy), 5), NULL, NULL, NULL, round(avg(p), 5), round(avg(r), 5), round(avg(f1), 5), NULL, NULL FROM x""")
def q49_detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines stand for counts of phones; the macro average is over the groups."""
    li = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    kinds = {"CD": (q < 10) & (t < 0.05), "DE": (q < 10) & (t >= 0.05), "TR": q < 10, "TA": (q >= 10) & (q < 40), "FR": (q >= 40) & (d < 0.03), "FA": (q >= 40) & (d >= 0.03) & (t < 0.05)}
    marked = li.select(F.col("l_returnflag").alias("grp"), F.struct(*[F.when(v, 1).otherwise(0).cast("long").alias(k) for k, v in kinds.items()]).alias("mdd"))
    names = {"Detection_Accuracy": "accuracy", "Overall_Diagnostic_Error_Rate": "error_rate", "FRR": "frr", "FAR": "far", "MDD_Precision": "p", "MDD_Recall": "r", "MDD_F1": "f1", "Diagnostic_Accuracy": "da", "Diagnostic_Error_Rate": "der"}
    one = scoring.detection_metrics(marked.groupBy("grp").agg(*scoring.sum_counts()))
    each = rounded(one.select("grp", *[F.col(k).alias(v) for k, v in names.items()]))
    macro = rounded(scoring.macro_average(each, ["accuracy", "p", "r", "f1"]), 5)
    none = F.lit(None).cast("double")
    return each.union(macro.select(F.lit("macro"), "accuracy", none, none, none, "p", "r", "f1", none, none))


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {_SPELLED.format("text")} AS s FROM conversations),
p AS (SELECT a.role AS language, a.s AS hyp, b.s AS ref FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT language, count(*) AS n, CAST(sum(length(ref)) AS BIGINT) AS phones, CAST(sum(levenshtein(hyp, ref)) AS BIGINT) AS errors,
       round(100.0 * sum(levenshtein(hyp, ref)) / sum(length(ref)), 6) AS per FROM p GROUP BY language""")
def q50_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as IPA, segmented, projected and scored; sums by language."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(_phones(F.col("text")), " ").alias("ipa"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ipa").alias("transcription"))
    t = c.join(after, ["conv_id", "turn"]).select(F.col("role").alias("language"), F.col("ipa").alias("prediction"), "transcription", F.col("transcription").alias("canonical"))
    scored = scoring.utterance_errors(scoring.project_triplet(spread(t)), with_counts=False)
    sums = scored.groupBy("language").agg(F.sum("per_errors").alias("errors"), *[c for c in scoring.error_rates()[:3]])
    return rounded(sums.select("language", F.col("N").alias("n"), "phones", "errors", F.col("PER").alias("per")))


@query("""
SELECT 'newest' AS kind, o_custkey AS a, max(o_orderkey) AS b, '' AS c FROM orders GROUP BY o_custkey UNION ALL
SELECT * FROM (SELECT 'first', o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 40) UNION ALL
SELECT 'valid', c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey BETWEEN 0 AND 9 UNION ALL
SELECT 'subset', n_nationkey, n_regionkey, '' FROM nation UNION ALL
SELECT 'class', count(DISTINCT lang), count(DISTINCT lang), '' FROM documents WHERE lang IS NOT NULL UNION ALL
SELECT 'sample', 5, 5, '' UNION ALL
SELECT 'val', greatest(1, CAST(floor(count(DISTINCT c_custkey) * 0.1) AS BIGINT)), count(*), '' FROM customer UNION ALL
SELECT 'masked', count(*), 0, '' FROM part""")
def q51_order_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest, first, valid and sampled rows; of hashed samples their sizes and what must hold for them."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    none = F.lit("")
    newest = tables.latest_run(o.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderkey").select(F.lit("newest").alias("kind"), F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), none.alias("c"))
    first = splits.first_n(o, "o_orderkey", 40).select(F.lit("first"), "o_orderkey", "o_custkey", "o_orderstatus")
    valid = c.where(labels.valid_class(F.col("c_nationkey"), F.col("c_custkey"), 10).isNotNull()).select(F.lit("valid"), "c_custkey", F.col("c_nationkey").cast("long"), "c_mktsegment")
    merge.require_subset(n.select(F.col("n_regionkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")), ["k"], "regions")
    subset = tables.all_or_error(n, F.col("n_nationkey") >= 0, "a nation without a number").select(F.lit("subset"), F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"), none)
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    shots = splits.few_shot(d, "lang", "doc_id", "all_class", seed=3).agg(F.count_distinct("lang").alias("a"), F.count("*").alias("b")).select(F.lit("class"), "a", "b", none)
    five = splits.few_shot(d, "lang", "doc_id", "k_sample", 5, 3).agg(F.count_distinct("doc_id").alias("a"), F.count("*").alias("b")).select(F.lit("sample"), "a", "b", none)
    carved = splits.carve_validation(c.select("c_custkey", F.lit("train").alias("split")), "c_custkey", 0.1, 4)
    val = carved.agg(F.count_if(F.col("split") == "val").alias("a"), F.count("*").alias("b")).select(F.lit("val"), "a", "b", none)
    letters = table(spark, sf_dir, "part").select("p_partkey", _phones(F.col("p_name")).alias("phones"))
    masked = splits.mask_phones(letters, "p_partkey", "phones", 0.5).select(F.forall(F.arrays_zip("phones", "masked_phones"), lambda z: (z["masked_phones"] == z["phones"]) | (z["masked_phones"] == "[NOISE]")).alias("ok"), (F.get("masked_phones", F.lit(0)) != F.get("phones", F.lit(0))).alias("bad"))
    masks = masked.agg(F.count_if("ok").alias("a"), F.count_if("bad").alias("b")).select(F.lit("masked"), "a", "b", none)
    return newest.union(first).union(valid).union(subset).union(shots).union(five).union(val).union(masks)


@query("""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]') AS t FROM conversations)
SELECT conv_id, turn, len(t) AS n, md5(array_to_string(list_transform(t, lambda x: CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN CAST(instr('aeiou', x) AS VARCHAR) ELSE '6' END), ',')) AS ids,
       md5(array_to_string(list_transform(t, lambda x: CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN x ELSE '' END), '')) AS back,
       CASE WHEN len(t) = 0 THEN '?' ELSE array_to_string(t[1:512], '') END AS head, array_to_string(list_transform(t[1:3], lambda x: '/' || x || '/'), ' ') AS slashes FROM w""")
def q52_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters encoded by a phone vocabulary of the vowels, and decoded without the unknown."""
    table_ = vocabulary.phone_vocabulary(list("aeiou"))
    t = F.col("t")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("([a-z])"), F.lit(1)).alias("t"))
    ids = vocabulary.encode(t, table_, table_["<unk>"])
    shown = vocabulary.decode(ids, table_, (table_["<unk>"],))
    digest = lambda a, gap: F.md5(F.array_join(a, gap).cast("binary"))
    return c.select(
        "conv_id", "turn", F.size(t).cast("long").alias("n"), digest(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"), digest(shown, "").alias("back"),
        F.array_join(vocabulary.truncated(t), "").alias("head"), F.array_join(vocabulary.in_slashes(F.slice(t, 1, 3)), " ").alias("slashes"),
    )


@query("""
WITH e AS (SELECT user_id, cos(value) AS dot, 1 + abs(value) AS k FROM events)
SELECT user_id, round(avg(-(ln(k) - k - ln(1 - exp(-2 * k)) - 1.8378770664093453 + k * dot)), 5) AS vmf, round(min(dot), 6) AS min_lat, round(max(k), 6) AS max_lon, round(sum(k), 4) AS fed,
       round(100 * sum(k) / count(*), 4) AS fer, round(avg(k), 6) AS pfer FROM e GROUP BY user_id""")
def q53_losses_and_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spherical loss, extents, and the aggregates of feature distances (values stand for distances)."""
    e = table(spark, sf_dir, "events").select("user_id", F.cos("value").alias("dot"), (1 + F.abs("value")).alias("k"), F.lit(1).alias("n"))
    out = e.withColumn("l", geolocation.vmf_loss(F.col("k"), F.col("dot"))).groupBy("user_id").agg(
        F.round(F.avg("l"), 5).alias("vmf"), F.round(F.min("dot"), 6).alias("min_lat"), F.round(F.max("k"), 6).alias("max_lon"), *features.feature_rates("k", "n"))
    return out.select("user_id", "vmf", "min_lat", "max_lon", F.round("FED", 4).alias("fed"), F.round("FER", 4).alias("fer"), F.round("PFER", 6).alias("pfer"))


_BUCKET = "CASE WHEN p = u AND p = h THEN 'TA' WHEN p = u THEN 'FR' WHEN p = h THEN 'FA' WHEN u = h THEN 'CD' ELSE 'DE' END"
_KIND = "CASE WHEN p = '-' AND u <> '-' THEN 'insertion' WHEN p <> '-' AND u = '-' THEN 'deletion' WHEN p <> u THEN 'substitution' ELSE 'none' END"


@query(f"""
WITH s AS (SELECT l_returnflag AS p, CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE l_linestatus END AS u, CASE WHEN l_quantity < 25 THEN 'A' ELSE 'N' END AS h FROM lineitem)
SELECT bucket, actual_error_type, count(*) AS n FROM (SELECT {_BUCKET} AS bucket, {_KIND} AS actual_error_type FROM s) GROUP BY ALL""")
def q54_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and error types of triples of symbols, counted."""
    u = F.when(F.col("l_linenumber") % 3 == 0, "-").otherwise(F.col("l_linestatus"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("p"), u.alias("u"), F.when(F.col("l_quantity") < 25, "A").otherwise("N").alias("h"))
    p, u, h = F.col("p"), F.col("u"), F.col("h")
    return slots.bucket_counts(s.select(slots.bucket(p, u, h).alias("bucket"), slots.error_type(p, u).alias("actual_error_type")))


_PARTS = f"src AS (SELECT p_partkey, {_SPELLED.format('p_name')} AS p, {_SPELLED.format('p_brand')} AS u, {_SPELLED.format('p_type')} AS h FROM part)"
_AT = "substr({}, CAST(k AS INT), 1)"


def _count(condition: str) -> str:
    """Places of a placed triple where the condition on p, u and h holds."""
    for name, column in (("$p", "qp"), ("$u", "qu"), ("$h", "qh")):
        condition = condition.replace(name, _AT.format(column))
    return f"CAST(len(list_filter(range(1, length(qp) + 1), lambda k: {condition})) AS BIGINT)"


def _marks(other: str) -> str:
    return f"array_to_string(list_transform(range(1, length(qp) + 1), lambda k: CASE WHEN {_AT.format('qp')} = {_AT.format(other)} THEN 'C' ELSE 'E' END), ' ')"


def _part_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", *[_phones(F.col(c)).alias(n) for c, n in (("p_name", "c"), ("p_brand", "u"), ("p_type", "h"))])


@query(f"""
WITH RECURSIVE {_PARTS}, uh AS (SELECT u AS a, h AS b FROM src), {sql.pair_paths("pair", "uh")},
x AS (SELECT s.p, y.pa AS pu, y.pb AS ph, s.p_partkey FROM src s JOIN pair y ON s.u = y.a AND s.h = y.b), {sql.placed("placed", "x")}
SELECT p_partkey, {_count("$p = $u AND $p = $h")} AS "TA", {_count("$p = $u AND $p <> $h")} AS "FR", {_count("$p <> $u AND $p = $h")} AS "FA",
       {_count("$p <> $u AND $p <> $h AND $u = $h")} AS "CD", {_count("$p <> $u AND $p <> $h AND $u <> $h")} AS "DE", {_count("$p <> $u AND $p <> $h")} AS "TR",
       {_marks("qu")} AS "corr_U", {_marks("qh")} AS "corr_P"
FROM placed z JOIN x ON x.p = z.p AND x.pu = z.pu AND x.ph = z.ph""")
def q55_strict_mdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, brands and types of parts, whole, as prompted, uttered and predicted phones."""
    t = _part_phones(spark, sf_dir).withColumn("m", align.strict_mdd("c", "u", "h"))
    return t.select("p_partkey", *[f"m.{k}" for k in ("TA", "FR", "FA", "CD", "DE", "TR", "corr_U", "corr_P")])


@query(f"""
WITH RECURSIVE {_PARTS}, uh AS (SELECT u AS a, h AS b FROM src), {sql.pair_paths("pair", "uh")},
e AS (SELECT a, b, CAST(len(list_filter(range(1, length(pa) + 1), lambda k: {_AT.format('pa')} = '-')) AS BIGINT) AS ins,
             CAST(len(list_filter(range(1, length(pa) + 1), lambda k: {_AT.format('pb')} = '-')) AS BIGINT) AS del,
             CAST(len(list_filter(range(1, length(pa) + 1), lambda k: {_AT.format('pa')} <> {_AT.format('pb')} AND {_AT.format('pa')} <> '-' AND {_AT.format('pb')} <> '-')) AS BIGINT) AS sub FROM pair)
SELECT u, h, count(*) AS n, sum(length(u)) AS phones, round(100.0 * sum(sub) / sum(length(u)), 6) AS "SUB", round(100.0 * sum(ins) / sum(length(u)), 6) AS "INS",
       round(100.0 * sum(del) / sum(length(u)), 6) AS "DEL", round(100.0 * sum(sub + ins + del) / sum(length(u)), 6) AS "PER"
FROM src JOIN e ON u = a AND h = b GROUP BY u, h""".replace("sum(length(u)) AS phones", "CAST(sum(length(u)) AS BIGINT) AS phones"))
def q56_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, insertions and deletions of brands read as types, in percent of the phones, by spelling."""
    scored = scoring.utterance_errors(_part_phones(spark, sf_dir))
    letter = F.create_map(*[F.lit(x) for k, v in _LETTERS.items() if k not in "cqx" for x in (v, k)])
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.element_at(letter, x)), "").alias(c)
    out = scored.groupBy(spelled("u"), spelled("h")).agg(*scoring.error_rates())
    return rounded(out.select("u", "h", F.col("N").alias("n"), "phones", "SUB", "INS", "DEL", "PER"))
