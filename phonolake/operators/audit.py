"""Audits of IPA fields: spans that the projection skips, with counts and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phones import skipped_spans
from ..functions.text import code_points
from ..session import scratch_folder, stored


def skipped_rows(df: DataFrame, id_col: str, field: str, text: str) -> DataFrame:
    """(utt_id, field, raw, span): a row for each skipped span."""
    return df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("utt_id"), F.lit(field).alias("field"), F.col(text).alias("raw"), F.explode(skipped_spans(F.col(text))).alias("span"))


def span_counts(rows: DataFrame, examples: int = 5) -> DataFrame:
    """(span, n, code_points, examples), the examples being the first utterances by id.  Texts are scanned once: what is counted and
    ranked are the stored counts by span and utterance, and Spark keeps the first few of a span before it deals them."""
    each = stored(rows.groupBy("span", "utt_id").agg(F.count("*").alias("n")), "spans")
    counts = each.groupBy("span").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("span").orderBy("utt_id")
    few = each.select("span", "utt_id", F.row_number().over(w).alias("__r")).where(F.col("__r") <= examples)
    shown = few.groupBy("span").agg(F.sort_array(F.collect_list("utt_id")).alias("examples"))
    return counts.join(shown, "span").withColumn("code_points", code_points(F.col("span")))


def walk_json(df: DataFrame, id_col: str, json_col: str, field: str) -> DataFrame:
    """(id, path, value): every string under a key named ``field`` at any depth, with its JSON path.

    Texts are parsed once to VARIANT.  Each step takes all values one level down and writes those that matter: strings found,
    and objects and arrays that hold the name somewhere, so a document is written again only as deep as the name lies.  There are
    as many steps as the deepest such place has levels.  Null and malformed texts give no rows, nor do texts with two equal keys
    in one object, which VARIANT does not take; repeated rows give repeated results."""
    spark = df.sparkSession
    root = scratch_folder(spark, "walk")
    name = F.regexp_replace(F.to_json(F.array(F.lit(field))), r"^\[|\]$", "")
    text = F.to_json("value")
    inside = text.startswith("{") | text.startswith("[")
    here = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("value"))
    kind = here.schema["id"].dataType.simpleString()
    depth = 0
    while True:
        below = spark.sql("SELECT id, path, e.pos, e.key, e.value FROM {here}, LATERAL variant_explode({here}.value) e", here=here)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = below.select("id", F.concat("path", step).alias("path"), ((F.col("key") == field) & text.startswith('"')).alias("found"), (inside & text.contains(name)).alias("on"), "value")
        level.where("found or on").write.parquet(f"{root}/level={depth:04d}")
        written = spark.read.schema(f"id {kind}, path string, found boolean, on boolean, value variant").parquet(f"{root}/level={depth:04d}")
        here = written.where("on").select("id", "path", "value")
        if here.isEmpty():
            break
        depth += 1
    found = spark.read.schema(written.schema).parquet(f"{root}/level=*").where("found")
    return found.select("id", "path", F.col("value").cast("string").alias("value"))
