"""Helpers common to the operators: scratch tables in the shared folder and column handling."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space that separates words and is stripped from lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset, and the master is local, a folder of this
    machine is used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="phonolake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Spark's readers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _kept_until_exit(df: DataFrame, path: str) -> DataFrame:
    fs, at = _files(df.sparkSession, path)
    fs.deleteOnExit(at)
    df.scratch = path
    return df


def stored(df: DataFrame, name: str, few: bool = False, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends there, so a lost executor
    costs no recomputation of what came before.  ``few``: rows are short and few for each partition; the size of their sources
    says how many tasks write them, not the number of partitions of the last exchange.  ``by``: a column whose values get
    folders of their own.  The files go when the application ends, or with ``discard``."""
    spark = df.sparkSession
    if few:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(1, min(most, source_bytes(df) >> 24)))
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return _kept_until_exit(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, name: str, n: int, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once in ``n`` buckets by ``keys``, sorted in each by ``order``; joins on the keys need no exchange.

    The catalog's entry, which Spark needs to write buckets, is dropped as soon as the table is resolved."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"phonolake_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(n, *keys).option("path", path).option("compression", "zstd")
    (writer.sortBy(*order) if order else writer).saveAsTable(table)
    made = spark.table(table)
    made.schema  # resolved now: the plan holds the files and the buckets from here on
    spark.sql(f"DROP TABLE {table}")
    return _kept_until_exit(made, path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored or bucketed tables that nothing reads any more."""
    for df in frames:
        fs, at = _files(df.sparkSession, df.scratch)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


def source_bytes(df: DataFrame) -> int:
    """The bytes of the tables that ``df`` reads, by Spark's plan; nothing is run.  2^60 or more where the plan does not know
    them.  Estimates of joins do not enter, as they may be the product of their sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


class Boxed:
    """``docs`` with its columns renamed c0, c1, ..., so that no name of the caller's meets one of the operator's."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"c{i}" for i in range(len(self.names))])

    def col(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name)}")

    def restore(self, df: DataFrame, values: dict[str, Column]) -> DataFrame:
        """The caller's columns under their names, those in ``values`` replaced in place, new ones added behind."""
        old = [values.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names)]
        return df.select(*old, *[v.alias(k) for k, v in values.items() if k not in self.names])


def _give_back() -> None:
    """Returns what Arrow and the C library hold unused; otherwise a worker that waits keeps the peak of its last task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, with unused memory returned when a partition is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


class Growing:
    """A numpy array that grows at its end; its room doubles, so appending many times costs no more than once."""

    def __init__(self, dtype: str):
        self.room, self.size = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            room = np.zeros(max(need, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : need] = values
        self.size = need
