"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "phonolake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution.  ``master`` is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where it is unset and the master is local, on this
    machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='phonolake-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that its lineage ends there."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core: enough that uneven rows even out, few enough that starting Python in them costs little.
_TASKS = 4


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to a few tasks for each core.  How many splits a table comes in says nothing of its work, as one split may
    hold the only row group; and asking a plan for its partitions would run its shuffles."""
    return df.repartition(_TASKS * df.sparkSession.sparkContext.defaultParallelism)
