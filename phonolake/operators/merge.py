"""Keyed merges and checks: last writer wins, subset and coverage checks, lookups with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``.  max_by aggregates partially, so a key with many rows is a few at the
    exchange, unlike a window that sorts them all in one task."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(last.alias("__last")).select(*[k if k in keys else F.col(f"__last.{k}").alias(k) for k in df.columns])


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def require_subset(left: DataFrame, right: DataFrame, keys: list[str], what: str, examples: int = 5) -> None:
    """Raises, with a count and a few examples, if a key of ``left`` is not in ``right``."""
    lost = missing_keys(left.select(*keys).distinct(), right.select(*keys), keys)
    found = lost.agg(F.count("*").alias("n")).first()["n"]
    if found:
        few = [tuple(r) for r in lost.orderBy(*keys).limit(examples).collect()]
        raise ValueError(f"{what}: {found} keys are missing, such as {few}")


def lookup(df: DataFrame, side: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with a default for each column of ``defaults``.  Spark broadcasts the side if its size allows."""
    out = df.join(side.select(*keys, *defaults), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def override(df: DataFrame, side: DataFrame, key: str, column: str) -> DataFrame:
    """Values of ``side`` win over those of ``df``."""
    other = side.select(F.col(key), F.col(column).alias("__new"))
    return df.join(other, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def collect_batch_results(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """One prediction for each manifest key: a result, its error, or an error that the result is missing.

    A result whose key the manifest does not have fails the run."""
    require_subset(results, manifest, ["key"], "results unknown to the manifest")
    from ..functions.text import result_text

    joined = manifest.join(results, "key", "left")
    absent = F.col("response").isNull() & F.col("error").isNull()
    message = F.when(absent, F.lit("no result for this key")).otherwise(F.col("error.message"))
    kind = F.when(absent, F.lit("MissingBatchResult")).when(F.col("error").isNotNull(), F.lit("BatchError"))
    error = F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("status"), message.alias("message")))
    text = F.when(kind.isNotNull(), F.lit("")).otherwise(F.coalesce(result_text(F.col("response")), F.lit("")))
    return joined.select(*manifest.columns, text.alias("predicted_transcript"), error.alias("error"))


def check_errors_represented(errors: DataFrame, merged: DataFrame) -> None:
    """Every ``key`` of the error logs must be in the merged predictions (key, processed_transcript and, if there,
    predicted_transcript), as an empty prediction."""
    require_subset(errors.select("key"), merged.select("key"), ["key"], "error log entries without a merged row")
    texts = [c for c in ("processed_transcript", "predicted_transcript") if c in merged.columns]
    said = F.concat(*[F.coalesce(c, F.lit("")) for c in texts])
    filled = merged.join(errors.select("key").distinct(), "key", "left_semi").where(said != "")
    few = [r["key"] for r in filled.select("key").orderBy("key").limit(5).collect()]
    if few:
        raise ValueError(f"logged errors with a prediction, such as {few}")


def first_prediction(pred: Column, field: str = "processed_transcript") -> Column:
    """The first prediction's field; the empty text for no, empty or failed predictions."""
    return F.coalesce(F.get(pred, F.lit(0))[field], F.lit(""))


def neighbours(df: DataFrame, group: str, order: str, window: int, is_target: Column, is_source: Column, label: Column, same: list[str]) -> DataFrame:
    """For target rows: the labels of source rows of the group within ``window`` places and with equal ``same`` columns
    (up to five, in order), and whether there is such a row anywhere in the group."""
    near = Window.partitionBy(group, *same).orderBy(order).rangeBetween(-window, window)
    every = Window.partitionBy(group, *same)
    mark = F.when(is_source, F.struct(F.col(order).alias("at"), label.alias("label")))
    own = F.filter(F.collect_list(mark).over(near), lambda m: m["at"] != F.col(order))
    total = F.count(mark).over(every) - F.when(is_source, 1).otherwise(0)
    marked = df.withColumn("__near", F.when(is_target, F.transform(F.slice(F.sort_array(own), 1, 5), lambda m: m["label"])))
    return marked.withColumn("near_labels", F.array_join("__near", ";")).withColumn("found_in_group", F.when(is_target, total > 0)).drop("__near")
