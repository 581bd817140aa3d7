"""Sums over the last writers of keys, kept up to date as shards arrive.

A key's state is one row: the place of its last writer (file and offset, the order of the batch merge), its group and its measures.  A row
of a later place takes the old one's share out of the sums and puts its own in; a row of an earlier or the same place, such as a
late file or a repeated one, changes nothing.  So the sums of all corrections are those of the batch merge, in whatever order rows
come, and no step reads what earlier ones wrote.

Corrections are summed by group in each micro-batch and written to the batch's own folder, which a repeated batch
replaces: what a report reads is one row a group and batch.  A null group is a group, a null measure counts as
zero, and rows without a key are left out.  Measures are longs, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LastWriter(StatefulProcessor):
    """Keeps a key's last row and emits what changes: its share with the sign -1, and the new one's with 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "file string, offset long, group string, measures array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        newest = max(((r["file"], r["offset"], r["group"], list(r["measures"])) for r in rows), key=lambda r: r[:2])
        old = self.last.get() if self.last.exists() else None
        if old is not None and (old[0], old[1]) >= newest[:2]:
            return
        self.last.update(newest)
        if old is not None:
            yield Row(group=old[2], n=-1, measures=[-m for m in old[3]])
        yield Row(group=newest[2], n=1, measures=newest[3])

    def close(self) -> None:
        pass


def corrections(rows: DataFrame, key: str, group: str, measures: list[str]) -> DataFrame:
    """(group, n, measures): what the stream's rows (with ``file`` and ``offset``) change in the sums."""
    slim = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), "file", "offset", F.col(group).cast("string").alias("group"),
        F.array(*[F.coalesce(F.col(m).cast("long"), F.lit(0)) for m in measures]).alias("measures"),
    )
    out = StructType.fromDDL("group string, n long, measures array<long>")
    return slim.groupBy("key").transformWithState(LastWriter(), out, outputMode="Update", timeMode="None")


def start_sums(rows: DataFrame, key: str, group: str, measures: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Brings the sums in ``path`` up to what has arrived; started again with the same checkpoint it goes on from there."""
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = [F.sum(F.col("measures")[i]).alias(m) for i, m in enumerate(measures)]
        batch.groupBy("group").agg(F.sum("n").alias("n"), *sums).write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    query = corrections(rows, key, group, measures).writeStream.outputMode("update").foreachBatch(write)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that this state needs; the query keeps its own copy of the settings
    try:
        return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def current_sums(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """(group, n, measures by name) over all corrections; groups without rows any more are left out."""
    rows = spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy("group").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures]).where("n > 0")
