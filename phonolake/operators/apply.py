"""A function applied to every row, so that no row is lost.

An exception becomes an empty prediction with an error; a worker that cannot start gives one ``__error__`` row.  Calls
are retried with growing pauses.  Rows done before are taken from a table of results by key, and only the others run.
"""

from __future__ import annotations

import random
import time
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "key string, processed_transcript string, predicted_transcript string, error struct<type: string, message: string>"
REGISTRY: dict[str, Callable[[], Callable[..., list[dict[str, Any]]]]] = {}


def register(name: str) -> Callable:
    """Registers a factory: called once in each worker, it returns the function called with each row's fields."""

    def keep(factory: Callable) -> Callable:
        REGISTRY[name] = factory
        return factory

    return keep


def with_retry(call: Callable[..., Any], tries: int = 5, first: float = 1.0, most: float = 60.0, retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """Calls again after exponentially growing, jittered pauses, as long as the exception is retryable."""

    def run(*a: Any, **k: Any) -> Any:
        for n in range(tries):
            try:
                return call(*a, **k)
            except Exception as e:
                if n + 1 == tries or not retryable(e):
                    raise
                sleep(min(most, first * 2**n) * (0.5 + random.random() / 2))
        return None

    return run


#: The status codes after which calls are made again, by kind of service.
RETRIED_STATUS = {
    "text": frozenset({429, 500, 502, 503, 504}),
    "audio": frozenset({408, 409, 429, 500, 502, 503, 504}),
}


def transient(service: str) -> Callable[[Exception], bool]:
    """For ``with_retry``: whether an exception has a status code that the service's clients retry, as ``status_code``, ``status`` or
    ``code``, or is one of the network or of the machine."""
    codes = RETRIED_STATUS[service]

    def retryable(e: Exception) -> bool:
        found = (getattr(e, name, None) for name in ("status_code", "status", "code"))
        return isinstance(e, OSError) or next((v for v in found if v), None) in codes

    return retryable


def run_on_rows(df: DataFrame, key: str, factory: Callable[[], Callable[..., list[dict[str, Any]]]], columns: list[str] | None = None) -> DataFrame:
    """One result for each row of ``df``; ``columns`` are the fields that the function gets."""
    fields = columns or [c for c in df.columns if c != key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "processed_transcript", "predicted_transcript", "error"]
        try:
            call = factory()
        except Exception as e:
            first = next(iter(batches), None)
            if first is not None:
                yield pd.DataFrame([("__error__", "", "", {"type": type(e).__name__, "message": str(e)})], columns=names)
            for _ in batches:
                pass
            return
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    got = call(**{k: row[k] for k in fields})
                    one = got[0] if got else {}
                    out.append((str(row[key]), one.get("processed_transcript", ""), one.get("predicted_transcript", ""), one.get("error")))
                except Exception as e:
                    out.append((str(row[key]), "", "", {"type": type(e).__name__, "message": str(e)}))
            yield pd.DataFrame(out, columns=names)

    return df.select(key, *fields).mapInPandas(work, RESULT)


def resume(df: DataFrame, done: DataFrame | None, key: str, factory: Callable, columns: list[str] | None = None) -> DataFrame:
    """Results for all rows: those of ``done`` without an error, and new ones for the rest."""
    return resume_by(df, done, key, lambda left: run_on_rows(left, key, factory, columns))


def resume_by(df: DataFrame, done: DataFrame | None, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``resume``, with a function of the table of rows that are left, which gives the columns of ``RESULT``: where Spark has an
    expression for the results, no row goes through Python."""
    if done is None:
        return run(df)
    good = done.where("error is null and key <> '__error__'")
    left = df.join(good.select(F.col("key").alias(key)), key, "left_anti")
    wanted = good.join(df.select(F.col(key).cast("string").alias("key")), "key", "left_semi")
    return wanted.unionByName(run(left))


#: Columns that say where a row stands, and those that name it, in the order in which they are looked at.
POSITIONS = ("idx", "index", "metadata_idx")
NAMES = ("utt_id", "key", "audio_path", "wavpath")


def cache_key(df: DataFrame, field: str) -> Column:
    """What results are kept under: the column ``field``, or where it is null the first name that is not.  A position does not
    outlive another order of the rows, so names come before it, with a warning."""
    names = [n for n in NAMES if n in df.columns and n != field]
    first = [field] if field in df.columns else []
    if field in POSITIONS and names:
        warnings.warn(f"{field} is a position and unsafe for resuming; {', '.join(names)} is used", RuntimeWarning, stacklevel=2)
        order = [*names, *first]
    else:
        order = [*first, *names]
    if not order:
        raise ValueError(f"rows have neither {field} nor one of {', '.join(NAMES)}")
    return F.coalesce(*[F.col(c).cast("string") for c in order])


def run_is_empty(results: DataFrame) -> bool:
    """Whether a run has no rows but worker failures."""
    return results.where(~F.col("key").startswith("__error__")).isEmpty()
