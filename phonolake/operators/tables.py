"""Smaller relational operators of evaluation and corpus preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import last_wins


def pending_runs(runs: DataFrame, done: DataFrame, key: str, modified: str) -> DataFrame:
    """Runs without a result yet, newest first."""
    return runs.join(done.select(key), key, "left_anti").orderBy(F.desc(modified), key)


def latest_run(runs: DataFrame, by: list[str], modified: str, key: str) -> DataFrame:
    return last_wins(runs, by, [modified, key])


def long_form(df: DataFrame, keys: list[str], names: str, values: str) -> DataFrame:
    """Two arrays of equal length as rows (keys..., place, name, value)."""
    return df.select(*keys, F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(values).alias("value"))).alias("place", "z")).select(*keys, F.col("place").cast("long").alias("place"), "z.name", "z.value")


def running_best(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The least value so far, such as the best loss by epoch."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(value).over(w)).withColumn("is_best", F.col(value) == F.col("best"))


def mapped(column: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A constant map, such as speaker to first language or language to accent cluster."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, column), F.lit(default))


def group_statistics(df: DataFrame, by: list[str], member: str, value: str) -> DataFrame:
    """Rows, distinct members, mean and population deviation of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(member).alias("members"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def excluded(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(ids))


def ordinal_from_logits(logits: Column, threshold: float = 0.5) -> Column:
    """Number of ordinal thresholds whose probability is above ``threshold``."""
    return F.size(F.filter(logits, lambda x: 1 / (1 + F.exp(-x)) > threshold))


def all_or_error(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, or an error at run time where the condition does not hold."""
    check = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(check)
