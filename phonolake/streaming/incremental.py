"""Scoring of prediction files as they arrive.

Normalization and alignment need no state, so a stream of files is scored row by row; each micro-batch replaces its
utterances in the table of results, so a file that is read again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas
from ..operators import merge, scoring


def scored_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.schema(schemas.SCORING).json(folder)
    return scoring.score_utterances(rows)


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch as a version of its own folder; a batch that is run again replaces the same folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    return write


def start(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    return scored_stream(spark, folder).writeStream.foreachBatch(upsert(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each utterance."""
    rows = spark.read.parquet(f"{path}/batch=*")
    return merge.last_wins(rows, ["language", "utt_id"], ["batch_id"]).drop("batch_id")


def event_rates(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means of events by window and kind, for streams and tables; later events than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
