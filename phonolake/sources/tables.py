"""Tabular sources: CSV with a schema, Parquet by nested field, transcripts, listings of recordings, a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header and a stated schema; a byte order mark before the header is no part of a name."""
    return spark.read.option("header", "true").option("enforceSchema", "true").schema(schema).csv(path)


def read_fields(spark: SparkSession, paths: list[str], fields: list[str], per_file: int | None = None) -> DataFrame:
    """Only the named (nested) columns are read; ``per_file`` limits each file, not the whole."""
    frames = [spark.read.parquet(p).select(*fields) for p in paths]
    if per_file is not None:
        frames = [f.limit(per_file) for f in frames]
    return reduce(DataFrame.unionByName, frames)


def read_transcripts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Transcripts of one JSON array of any size, with a split column: synonyms of val are one name, rows of other splits
    are dropped, and train and test must have rows.  A malformed entry is an error."""
    from .documents import read_entries

    rows = read_entries(spark, path).select(F.from_json("entry", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    name = F.lower("split")
    rows = rows.withColumn("split", F.when(name.isin("val", "dev", "validation", "valid"), "val").when(name.isin("train", "test"), name)).where("split is not null")
    found = {r["split"] for r in rows.select("split").distinct().collect()}  # three names at most
    if not {"train", "test"} <= found:
        raise ValueError(f"transcripts need train and test rows; found {sorted(found)}")
    return rows


def list_recordings(spark: SparkSession, folder: str, suffix: str = "wav") -> DataFrame:
    """(path, speaker, name, length) of the recordings below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(folder)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("speaker"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("name"), "length")


def keep_microphone(name, chosen: list[str], suffix: str = "_M5"):
    """Files of one microphone, or named explicitly."""
    return name.endswith(suffix) | name.isin(chosen)


def long_enough(n_frames, rate: int = 16000, seconds: float = 0.5):
    return n_frames >= int(rate * seconds)


class Catalogue:
    """Data sets by name."""

    def __init__(self, entries: dict[str, dict[str, str]]):
        self.entries = entries

    def paths(self, name: str) -> dict[str, str]:
        if name not in self.entries:
            raise KeyError(f"unknown data set {name!r}; known: {', '.join(sorted(self.entries))}")
        return self.entries[name]
