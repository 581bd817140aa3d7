"""Metrics of predicted labels.  All start from the matrix of counts (target, pred, n)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """A labelled data set: what is predicted, its range, and the field of the prediction."""

    kind: str  # classification, regression or geolocation
    classes: int = 0
    low: int = 0
    high: int = 0
    field: str = "class_id"


def valid_class(value: Column, target: Column, classes: int) -> Column:
    """The class as an integer, null where it is missing, no number, out of range, or there is no target."""
    number = value.try_cast("double")
    whole = F.when(value.cast("string").rlike(r"^\s*[-+]?\d+\s*$") | value.cast("string").rlike(r"^\s*[-+]?\d+\.0*\s*$"), number.try_cast("long"))
    return F.when(target.isNotNull() & whole.between(0, classes - 1), whole)


def ordinal(value: Column, low: int, high: int, clamp: bool = True) -> Column:
    """Rounded half to even; clamped to the range, or null outside it."""
    n = F.rint(value.try_cast("double")).try_cast("long")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(low)), F.lit(high))) if clamp else F.when(n.between(low, high), n)


def in_test_split(split: Column) -> Column:
    return split.isNull() | (split == "test")


def confusion(df: DataFrame, pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    rows = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    return rows.groupBy(*(by or []), F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy_and_f1(matrix: DataFrame) -> DataFrame:
    """n, micro accuracy, macro accuracy (mean recall of classes that occur as target or prediction), macro F1."""
    hit = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    t = matrix.groupBy(F.col("target").alias("k")).agg(F.sum("n").alias("nt"), F.sum(hit).alias("tp"))
    p = matrix.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("np"))
    per = t.join(p, "k", "full").select("k", F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("np", F.lit(0)).alias("np"))
    return per.agg(
        F.coalesce(F.sum("nt"), F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(1.0 * F.sum("tp"), F.sum("nt")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.coalesce(F.try_divide(1.0 * F.col("tp"), F.col("nt")), F.lit(0.0))), F.lit(0.0)).alias("macro_accuracy"),
        F.coalesce(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("nt") + F.col("np")), F.lit(0.0))), F.lit(0.0)).alias("macro_f1"),
    )


def mean_absolute_error(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.try_divide(1.0 * F.sum(F.col("n") * F.abs(F.col("pred") - F.col("target"))), F.sum("n")).alias("mae"))


def weighted_kappa(matrix: DataFrame) -> DataFrame:
    """Cohen's kappa with squared distances as weights: 1 - sum(w * observed) / sum(w * expected).

    The expected sum needs the marginals' moments only: sum over (t, p) of (t - p)^2 rt rp / n."""
    t, p, n = F.col("target").cast("double"), F.col("pred").cast("double"), F.col("n").cast("double")
    m = matrix.agg(
        F.sum(n).alias("n"), F.sum(n * (t - p) * (t - p)).alias("o"), F.sum(n * t).alias("t1"), F.sum(n * t * t).alias("t2"), F.sum(n * p).alias("p1"), F.sum(n * p * p).alias("p2")
    )
    expected = F.expr("t2 + p2 - 2 * try_divide(t1 * p1, n)")
    return m.select((1 - F.try_divide(F.col("o"), expected)).alias("qwk"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Null where a side has no variance."""
    m = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return m.select(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")).alias("pearson"))


def inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Weight of the pairs of which the first is greater, by one bit of the values' ranks after the other: among values that
    agree in the bits above, those with the bit before those without."""
    rank = np.unique(values, return_inverse=True)[1]
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        above, has = (rank >> (bit + 1))[order], (rank >> bit)[order] & 1
        w = weights[order]
        before = np.cumsum(w * has)
        start = np.flatnonzero(np.diff(above, prepend=-1))
        base = np.repeat(np.append(0.0, before)[start], np.diff(np.append(start, len(above))))
        total += float(((before - base) * w * (1 - has)).sum())
    return total


#: Rows of counts for which values are cut into one more block, and the most cuts of a side.
_BLOCK_ROWS, _CUTS = 4096, 512
#: Rows of counts whose pairs are looked at as they are.
_FEW = 1024


def _discordant(m: DataFrame, block_rows: int, cuts: int, few: int) -> DataFrame:
    """(d): the weight of the pairs of rows of ``m`` (t, p, n) that t and p order in opposite ways.

    Either side is cut at quantiles; a cut's value is a block of its own, so a value that many rows have is no part of a larger
    block.  Pairs in other blocks on both sides are counted by the blocks' sums, pairs in one block of p within it, and pairs in one
    block of t but not of p within that.  Blocks of one value have none.  Of ``few`` rows all pairs are looked at."""
    n = m.count()
    if n <= few:
        a, b = m.toDF("t1", "p1", "n1"), m.toDF("t2", "p2", "n2")
        return a.join(b, (F.col("t1") < F.col("t2")) & (F.col("p1") > F.col("p2"))).agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0.0)).alias("d"))
    parts = min(cuts, n // block_rows)
    shares = [k / (parts + 1) for k in range(1, parts + 1)]
    found = m.agg(*[F.percentile_approx(c, F.lit(shares), 20 * parts).alias(c) for c in ("t", "p")]).first() if parts else {"t": [], "p": []}
    t_cuts, p_cuts = (np.unique(np.array(found[c], np.float64)) for c in ("t", "p"))

    def block(x: np.ndarray, at: np.ndarray) -> pa.Array:
        low = np.searchsorted(at, x, side="left")
        return pa.array(low + np.searchsorted(at, x, side="right"), pa.int64())  # odd where the value is a cut

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, p = b.column("t").to_numpy(), b.column("p").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, block(t, t_cuts), block(p, p_cuts)], names=["t", "p", "n", "tb", "pb"])

    dealt = m.mapInArrow(deal, "t double, p double, n double, tb long, pb long")

    def within(value: str) -> Callable[[pa.Table], pa.Table]:
        def count(part: pa.Table) -> pa.Table:
            t, v, w = (part.column(c).to_numpy() for c in ("t", value, "n"))
            order = np.lexsort((v, t))
            return pa.table({"d": pa.array([inversions(v[order], w[order])], pa.float64())})

        return count

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * len(t_cuts) + 1, 2 * len(p_cuts) + 1))
        for b in batches:
            sums[b.column("tb").to_numpy(), b.column("pb").to_numpy()] += b.column("n").to_numpy()
        earlier = np.cumsum(sums, axis=0) - sums
        greater = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier
        yield pa.RecordBatch.from_arrays([pa.array([float((greater * sums).sum())])], names=["d"])

    one_p = dealt.where("pb % 2 = 0").groupBy("pb").applyInArrow(within("p"), "d double")
    one_t = dealt.where("tb % 2 = 0").groupBy("tb").applyInArrow(within("pb"), "d double")
    neither = dealt.groupBy("tb", "pb").agg(F.sum("n").alias("n")).coalesce(1).mapInArrow(across, "d double")  # as many rows as pairs of blocks
    return one_p.unionAll(one_t).unionAll(neither).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))


def kendall_tau_b(matrix: DataFrame, block_rows: int = _BLOCK_ROWS, cuts: int = _CUTS, few: int = _FEW) -> DataFrame:
    """Tau-b from the counts of pairs of numbers, of however many values; zero where a side has fewer than two.  No row meets
    all others but in small matrices: discordant pairs are counted in blocks of either side."""
    m = matrix.select(F.col("target").cast("double").alias("t"), F.col("pred").cast("double").alias("p"), F.col("n").cast("double").alias("n"))

    def ties(keys: list[str], out: str) -> DataFrame:
        g = m.groupBy(*keys).agg(F.sum("n").alias("g"))
        return g.agg(F.coalesce(F.sum(F.col("g") * (F.col("g") - 1) / 2), F.lit(0.0)).alias(out), F.count("*").alias(f"k_{out}"))

    n = m.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("pairs"))
    one = _discordant(m, block_rows, cuts, few).crossJoin(n).crossJoin(ties(["t"], "tt")).crossJoin(ties(["p"], "tp")).crossJoin(ties(["t", "p"], "both"))  # single rows
    pairs, tt, tp = F.col("pairs"), F.col("tt"), F.col("tp")
    tau = F.try_divide(pairs - tt - tp + F.col("both") - 2 * F.col("d"), F.sqrt(pairs - tt) * F.sqrt(pairs - tp))
    return one.select(F.when((F.col("k_tt") < 2) | (F.col("k_tp") < 2), 0.0).otherwise(tau).alias("kendall_tau"))


def top_confusions(matrix: DataFrame, limit: int = 15) -> DataFrame:
    """The most frequent wrong pairs, ties by label."""
    return matrix.where("target <> pred").orderBy(F.desc("n"), "target", "pred").limit(limit)


def label_ids(df: DataFrame, column: str) -> DataFrame:
    """(label, id): distinct labels by sorted place, from zero.  The number of labels is that of classes."""
    from pyspark.sql import Window

    return df.select(F.col(column).alias("label")).where("label is not null").distinct().withColumn("id", F.row_number().over(Window.orderBy("label")).cast("long") - 1)


def log_weighted_mean(df: DataFrame, score: str, count: str) -> DataFrame:
    """Mean of scores weighted by the logarithm of their data sets' sizes."""
    return df.agg(F.try_divide(F.sum(F.col(score) * F.ln(count)), F.sum(F.ln(count))).alias("weighted_mean"))


def mean_and_deviation(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean and sample deviation over seeds; a single seed has none."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"))
