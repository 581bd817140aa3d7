"""Prediction files: JSON lines of one-key objects in shards, merged JSON, and strict JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.merge import last_wins

RECORD = schemas.RECORD
SKIPPED = (".cache", ".error")


def read_lines(spark: SparkSession, pattern: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(file, line_no, value) of non-empty lines, without files whose names hold one of ``skip``.

    ``line_no`` orders the lines of a file; files of any size are read by many tasks."""
    lines = lines_in_order(spark.read.text(pattern))
    name = F.element_at(F.split("file", "/"), -1)
    for part in skip:
        lines = lines.where(~name.contains(part))
    return lines.where(F.trim("value") != "")


def lines_in_order(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) of a text source; ``line_no`` is the offset of the line's split and the row that it is of its
    task, which reads a split from its beginning to its end."""
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), "value")


def parse_records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(file, line_no, sample_key, rec): flat records, or one-key objects {key: record}; a malformed line is skipped, or
    with ``strict`` an error that names its place."""
    flat = F.from_json("value", RECORD)
    keyed = F.from_json("value", f"map<string, {RECORD}>")
    is_flat = F.get_json_object("value", "$.pred").isNotNull() | F.get_json_object("value", "$.passthrough").isNotNull()
    valid = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    if strict:
        place = F.concat(F.lit("malformed JSON in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80))
        lines = lines.withColumn("value", F.when(valid, F.col("value")).otherwise(F.raise_error(place).cast("string")))
    else:
        lines = lines.where(valid)
    entries = F.when(is_flat, F.array(F.struct(F.lit(None).cast("string").alias("key"), flat.alias("value")))).otherwise(F.map_entries(keyed))
    return lines.select("file", "line_no", F.explode(entries).alias("e")).select("file", "line_no", F.col("e.key").alias("sample_key"), F.col("e.value").alias("rec"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_key, pred, passthrough) of a folder's shards, the last writer of a key winning in order of file and line."""
    records = parse_records(read_lines(spark, f"{folder}/*jsonl"))
    return last_wins(records, ["sample_key"], ["file", "line_no"]).select("sample_key", "rec.pred", "rec.passthrough")


def read_error_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key): the keys of a folder's error logs, files whose names hold ``.errors``; none if there is no such file."""
    lines = read_lines(spark, f"{folder}/*.jsonl", ()).where(F.element_at(F.split("file", "/"), -1).contains(".errors"))
    return lines.select(F.get_json_object("value", "$.key").alias("key")).where("key is not null").distinct()


def read_predictions(spark: SparkSession, pattern: str, skip_cache: bool = True) -> DataFrame:
    """All records of the matching files, in no order, with their key if they have one."""
    lines = read_lines(spark, pattern, SKIPPED if skip_cache else ())
    return parse_records(lines).select("sample_key", "rec.pred", "rec.passthrough")


_WORKER = re.compile(r"\.[0-9]+\.[0-9]+$")


def read_worker_caches(spark: SparkSession, path: str) -> DataFrame:
    """(key, processed_transcript, predicted_transcript, error) of a run's caches, JSON lines {"key", "pred"}: the file itself, and
    those of all its workers, ``name.<n>.<m>.jsonl`` beside ``name.jsonl`` (or beside any one of them), whatever the number of workers
    was.  The last of equal keys counts, in order of file and line; lines without key or prediction, and malformed ones, are
    skipped; no file gives no rows."""
    folder, _, name = path.rpartition("/")
    stem = _WORKER.sub("", name.removesuffix(".jsonl"))
    literal = re.sub(r"([*?\[\]{}\\])", r"\\\1", stem)
    lines = None
    for pattern in (f"{folder}/{literal}.jsonl", f"{folder}/{literal}.[0-9]*.[0-9]*.jsonl"):
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
            found = read_lines(spark, pattern, ())
            lines = found if lines is None else lines.unionByName(found)
    schema = f"key string, pred array<struct<{schemas.PREDICTION}>>"
    if lines is None:
        lines = spark.createDataFrame([], "file string, line_no struct<split: long, row: long>, value string")
    rows = lines.select("file", "line_no", F.from_json("value", schema).alias("r")).where("r.key <> '' and size(r.pred) > 0")
    last = last_wins(rows.select(F.col("r.key").alias("key"), F.get("r.pred", F.lit(0)).alias("p"), "file", "line_no"), ["key"], ["file", "line_no"])
    error = F.when(F.col("p.error").isNotNull(), F.struct(F.col("p.error.type").alias("type"), F.col("p.error.message").alias("message")))
    text = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return last.select("key", text("processed_transcript"), text("predicted_transcript"), error.alias("error"))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """(sample_key, pred, passthrough) of one JSON object with a key for each sample, of any size; the last of equal keys
    counts."""
    from .documents import read_entries

    entries = read_entries(spark, path)
    own = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string, {RECORD}>")
    rows = entries.select("file", "split", "seq", F.explode(own).alias("sample_key", "rec"))
    return last_wins(rows, ["sample_key"], ["file", "split", "seq"]).select("sample_key", "rec.pred", "rec.passthrough")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(file, folder, kind): merged files of every folder, and shards only where there is no merged file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(root).select("path")
    rows = files.select(F.col("path").alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = rows.where(~F.col("file").contains("/Old/"))
    merged = rows.where(F.col("name").endswith(".json"))
    shards = rows.where(F.col("name").endswith(".jsonl") & ~F.col("name").contains(".cache") & ~F.col("name").contains(".error"))
    alone = shards.join(merged.select("folder").distinct(), "folder", "left_anti")
    return merged.withColumn("kind", F.lit("merged")).unionByName(alone.withColumn("kind", F.lit("shard"))).select("file", "folder", "kind")
