"""Phone inventories of predictions and references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import hamming


def inventory(df: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """(by..., token, n, rank): tokens by falling frequency, ties in order of the token."""
    counts = df.select(*by, F.explode(tokens).alias("token")).where("token <> ''").groupBy(*by, "token").agg(F.count("*").alias("n"))
    # at most one row for each symbol of the alphabet and group
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order))


def inventory_scores(df: DataFrame, predicted: str, reference: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of the set of predicted tokens, and the best F1 over the k most frequent of them."""
    by = by or []
    ref = inventory(df, reference, by).select(*by, "token", F.lit(1).alias("__in"))
    pred = inventory(df, predicted, by)
    sizes = ref.groupBy(*by).agg(F.count("*").alias("n_ref"))
    hit = pred.join(ref, [*by, "token"], "left").withColumn("__hit", F.coalesce("__in", F.lit(0)))
    running = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    prefix = hit.withColumn("__tp", F.sum("__hit").over(running))
    joined = prefix.join(sizes, by, "inner") if by else prefix.crossJoin(F.broadcast(sizes))  # one row
    joined = joined.withColumn("__f1", F.coalesce(F.try_divide(2.0 * F.col("__tp"), F.col("rank") + F.col("n_ref")), F.lit(0.0)))
    n_pred, tp = F.max("rank"), F.max("__tp")
    return joined.groupBy(*by).agg(
        n_pred.alias("n_pred"), F.max("n_ref").alias("n_ref"), tp.alias("n_common"),
        F.coalesce(F.try_divide(tp * 1.0, n_pred), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp * 1.0, F.max("n_ref")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * tp, n_pred + F.max("n_ref")), F.lit(0.0)).alias("f1"), F.max("__f1").alias("max_f1"),
    )


def best_matchings(likeness: np.ndarray) -> np.ndarray:
    """For each k the greatest sum of likeness of the first k rows with columns, each matched once at most: rows are added
    one by one, by a shortest augmenting path (the Hungarian method)."""
    n, m = likeness.shape
    cost = np.zeros((n + 1, n + m + 1))  # a column for each row that stays alone
    cost[1:, 1 : m + 1] = -likeness
    u, v, owner = np.zeros(n + 1), np.zeros(n + m + 1), np.zeros(n + m + 1, np.int64)
    sums = np.zeros(n)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, came, done = np.full(n + m + 1, np.inf), np.zeros(n + m + 1, np.int64), np.zeros(n + m + 1, bool)
        while owner[at]:
            done[at] = True
            reduced = cost[owner[at]] - u[owner[at]] - v
            better = ~done & (reduced < least)
            least[better], came[better] = reduced[better], at
            open_ = np.where(done, np.inf, least)
            nearest = int(open_.argmin())
            step = open_[nearest]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = nearest
        while at:
            owner[at], at = owner[came[at]], int(came[at])
        sums[i - 1] = v[0]
    return sums


def feature_scores(predicted: list[str], reference: list[str]) -> dict[str, float]:
    """Scores of two inventories whose phones match by likeness, 1 less the share of differing features.  Precision and
    recall are mean likenesses to the nearest phone of the other side; ``exclusive_``: each phone matches one other at most,
    so that the sum is greatest; ``max_f1``: the best over the k most frequent predicted phones.  Zero for empty inventories."""
    kinds = ("", "exclusive_")
    if not predicted or not reference:
        return {f"{kind}{name}": 0.0 for kind in kinds for name in ("precision", "recall", "f1", "max_f1")}
    likeness = np.array([[1.0 - hamming(p, r) for r in reference] for p in predicted])
    k = np.arange(1, len(predicted) + 1)
    matched = best_matchings(likeness)
    near = (np.cumsum(likeness.max(1)) / k, np.maximum.accumulate(likeness, 0).mean(1))
    out = {}
    for kind, (p, r) in zip(kinds, (near, (matched / k, matched / len(reference))), strict=True):
        f1 = np.divide(2 * p * r, p + r, out=np.zeros(len(k)), where=p + r > 0)
        out |= {f"{kind}precision": float(p[-1]), f"{kind}recall": float(r[-1]), f"{kind}f1": float(f1[-1]), f"{kind}max_f1": float(f1.max())}
    return out


_SCORES = T.StructType([T.StructField(k, T.DoubleType()) for k in feature_scores([], [])])


@F.pandas_udf(_SCORES)
def _feature_scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for p, r in batches:
        yield pd.DataFrame([feature_scores(list(x), list(y)) for x, y in zip(p, r, strict=True)], columns=_SCORES.names)


def featured_inventory_scores(df: DataFrame, predicted: str, reference: str, by: list[str] | None = None) -> DataFrame:
    """``feature_scores`` of each group's inventories, which are lists of distinct symbols.  A group with one side only has zeros."""
    by = by or []
    sides = inventory(df, predicted, by).withColumn("__p", F.lit(True)).unionByName(inventory(df, reference, by).withColumn("__p", F.lit(False)))
    entry = F.struct("rank", "token")
    lists = sides.groupBy(*by).agg(*[F.sort_array(F.collect_list(F.when(F.col("__p") == side, entry))).alias(name) for name, side in (("__pred", True), ("__ref", False))])
    return lists.withColumn("__s", _feature_scores(F.col("__pred.token"), F.col("__ref.token"))).select(*by, "__s.*")
