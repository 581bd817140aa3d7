"""Results as files and tables.  Reports of a few rows are formatted on the driver; everything else is written by
executors."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _file(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, through Spark, so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file from the driver."""
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, empty where there is none."""
    fs, at = _file(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(at) and fs.getFileStatus(at).getLen() else ""


def write_shards(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines of {key: record}; one file a task."""
    line = F.to_json(F.create_map(F.col("sample_key"), F.struct(*[c for c in df.columns if c != "sample_key"])))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_merged(rows: DataFrame, normalized: DataFrame, audit: DataFrame, folder: str, alias: str | None = None) -> None:
    """The raw and the normalized predictions and the audit table; ``alias`` names a second copy of the normalized ones, made
    from the files and not from the plan."""
    rows.write.mode("overwrite").json(f"{folder}/transcription")
    normalized.write.mode("overwrite").json(f"{folder}/transcription.normalized")
    if alias:
        made = normalized.sparkSession.read.text(f"{folder}/transcription.normalized")
        made.write.mode("overwrite").text(f"{folder}/{alias}")
    audit.write.mode("overwrite").option("header", "true").csv(f"{folder}/normalization_report")


def write_document(values: DataFrame, path: str, order: str, key: str | None = None, value: str = "value") -> None:
    """One JSON document of all rows, in the order of a column: an object of ``key`` and the JSON text ``value``, or, without a
    key, an array of the values.  One file is one task's work, which sorts on disk and holds no more than a row."""
    w = Window.orderBy(order)
    begin, end = ("{", "}") if key else ("[", "]")
    # a string as JSON is that of an array of it, without the brackets
    name = F.concat(F.regexp_replace(F.to_json(F.array(F.col(key).cast("string"))), r"^\[|\]$", ""), F.lit(": ")) if key else F.lit("")
    opening = F.when(F.row_number().over(w) == 1, begin).otherwise(", ")
    closing = F.when(F.lead(F.lit(1)).over(w).isNull(), end).otherwise("")
    values.select(F.concat(opening, name, F.col(value), closing).alias("value")).write.mode("overwrite").option("lineSep", " ").text(path)


def append_summary(summary: DataFrame, path: str) -> None:
    """Appends a run's metrics; a run never rewrites those before it."""
    summary.write.mode("append").parquet(path)


def append_summary_csv(summary: DataFrame, path: str) -> None:
    """Appends a run's few rows to a CSV file, with a header where the file is new, and to a text twin (``.txt``) of
    ``name: value`` lines.  Columns are those of the file's header; a summary with others is an error."""
    spark, rows = summary.sparkSession, [r.asDict() for r in summary.collect()]
    before = read_small(spark, path)
    header = next(csv.reader([before.splitlines()[0]])) if before else summary.columns
    if set(header) != set(summary.columns):
        raise ValueError(f"{path} has the columns {header}, the summary {summary.columns}")
    out = io.StringIO()
    writer = csv.DictWriter(out, header, lineterminator="\n")
    if not before:
        writer.writeheader()
    writer.writerows(rows)
    write_small(spark, path, before + out.getvalue())
    twin = "".join("\n".join(f"{c}: {r[c]}" for c in header) + "\n\n" for r in rows)
    write_small(spark, f"{path}.txt", read_small(spark, f"{path}.txt") + twin)


def json_report(summary: DataFrame, **about: object) -> str:
    """The rows of a small summary, with facts about the run, as JSON."""
    return json.dumps({**about, "rows": [r.asDict(recursive=True) for r in summary.collect()]}, ensure_ascii=False, indent=2, default=str) + "\n"


def slot_summary(counts: DataFrame) -> str:
    """Lines of text for the counts of ``operators.slots.bucket_counts``: buckets by falling number, and their error types."""
    total: dict[str, int] = {}
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in counts.collect():  # five buckets by four types at most
        total[r["bucket"]] = total.get(r["bucket"], 0) + r["n"]
        parts.setdefault(r["bucket"], []).append((-r["n"], r["actual_error_type"]))
    lines = [f"slots: {sum(total.values())}"]
    for bucket, n in sorted(total.items(), key=lambda x: (-x[1], x[0])):
        lines.append(f"{bucket}: {n} (" + ", ".join(f"{kind} {-k}" for k, kind in sorted(parts[bucket])) + ")")
    return "\n".join(lines) + "\n"


def write_cache(results: DataFrame, path: str) -> None:
    """Appends results (key, ...) without an error to a cache of predictions, for ``operators.apply.resume``; the last of equal
    keys counts, by the time of writing."""
    good = results.where("error is null and key <> '__error__'")
    good.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached results, one a key; none where there is no cache."""
    from ..operators.merge import last_wins

    fs, at = _file(spark, path)
    return last_wins(spark.read.parquet(path), ["key"], ["written"]).drop("written") if fs.exists(at) else None


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with a header, in folders by the given columns."""
    writer = df.write.mode("overwrite").option("header", "true")
    (writer.partitionBy(*by) if by else writer).csv(path)


def markdown_report(summary: DataFrame, title: str) -> str:
    """Of a summary with one row."""
    row = summary.limit(1).collect()[0].asDict()
    shown = {k: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for k, v in row.items()}
    return "\n".join([f"# {title}", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in shown.items())]) + "\n"


def write_requests(samples: DataFrame, path: str, key: str, prompt, audio: str) -> None:
    """Manifest and requests of a batch job as JSON lines."""
    from ..functions.text import mime_type

    samples.select(F.col(key).cast("string").alias("key"), F.col(audio).alias("audio_path"), F.struct(*samples.columns).alias("passthrough")).write.mode("overwrite").json(f"{path}/manifest")
    request = F.struct(F.array(F.struct(prompt.alias("text")), ).alias("parts"), mime_type(F.col(audio)).alias("mime_type"), F.col(audio).alias("file"))
    samples.select(F.col(key).cast("string").alias("key"), request.alias("request")).write.mode("overwrite").json(f"{path}/requests")
