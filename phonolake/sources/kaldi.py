"""Kaldi-style corpora: keyed text files beside a list of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_and_rest, language_of, rejoined_fields, strip_space
from ..operators.merge import last_wins, require_subset
from .predictions import lines_in_order


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with what orders them in the file, so that the last of equal keys is known: the offset of the split that a task
    reads, and the row in it.  Files of any size are read by many tasks."""
    return lines_in_order(spark.read.text(path)).drop("file")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers: the file is read whole by one task, as a vocabulary is small."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.posexplode(F.split("value", "\r\n|\n|\r", -1)).alias("line_no", "value"))


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's own file systems, so that any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, text): the rest of each line joined by single spaces; lines without a rest are skipped."""
    lines = _lines(spark, path)
    key, rest = rejoined_fields(F.col("value"))
    return last_wins(lines.select(key.alias("utt_id"), rest.alias("text"), "line_no").where("text is not null"), ["utt_id"], ["line_no"]).drop("line_no")


def read_optional_text(spark: SparkSession, path: str, what: str, required: bool = False) -> DataFrame:
    if exists(spark, path):
        return read_text(spark, path)
    if required:
        raise FileNotFoundError(f"{what} is required: {path}")
    return spark.createDataFrame([], "utt_id string, text string")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, text) with the inner spacing kept; a key alone has the empty text; blank lines are skipped."""
    lines = _lines(spark, path).where(strip_space(F.col("value")) != "")
    key, rest = key_and_rest(F.col("value"))
    return last_wins(lines.select(key.alias("utt_id"), rest.alias("text"), "line_no"), ["utt_id"], ["line_no"]).drop("line_no")


def read_recordings(spark: SparkSession, path: str, data_dir: str, portable: bool = True, absolute_prefix: str | None = None) -> DataFrame:
    """(utt_id, wav_path): paths are put under ``data_dir`` unless they start with the prefix, if there is one; without ``portable`` their
    first two parts are dropped before.  An offset behind a colon stays."""
    lines = _lines(spark, path)
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = lines.select(parts.alias("p"), "line_no").where(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("utt_id"), F.get("p", F.lit(1)).alias("w"), "line_no")
    rows = last_wins(rows, ["utt_id"], ["line_no"])
    own = F.col("w") if portable else F.array_join(F.slice(F.split("w", "/"), 3, 100_000), "/")
    under = F.concat(F.lit(data_dir.rstrip("/") + "/"), F.regexp_replace(own, "^/+", ""))
    whole = F.col("w").startswith(absolute_prefix) if absolute_prefix else F.lit(False)
    return rows.select("utt_id", F.when(whole, F.col("w")).otherwise(under).alias("wav_path"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id): the line's number from zero; spaces are kept; a last empty line is none."""
    return _numbered_lines(spark, path).select(F.col("value").alias("token"), F.col("line_no").alias("id")).where("token <> ''")


def read_corpus(spark: SparkSession, folder: str, portable: bool = True, canonical: str | None = None, canonical_required: bool = False, absolute_prefix: str | None = None) -> DataFrame:
    """(utt_id, wav_path, text, language, canonical): every recording must have a text and a language; texts without a
    recording are left out."""
    wav = read_recordings(spark, f"{folder}/wav.scp", folder, portable, absolute_prefix)
    text, lang = read_text(spark, f"{folder}/text.good"), read_text(spark, f"{folder}/text.lang")
    require_subset(wav, text, ["utt_id"], "recordings without text")
    require_subset(wav, lang, ["utt_id"], "recordings without language")
    out = wav.join(text, "utt_id").join(lang.select("utt_id", language_of(F.col("text")).alias("language")), "utt_id")
    side = read_optional_text(spark, f"{folder}/{canonical or 'text.canonical'}", "canonical text", canonical_required)
    if canonical_required:
        require_subset(wav, side, ["utt_id"], "recordings without canonical text")
    return out.join(side.withColumnRenamed("text", "canonical"), "utt_id", "left")
