"""Splits and samples.  Random choices are hashes of the row's key and a seed, so they are the same wherever and however
often a task runs.  Ranks are taken over distinct keys or within bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coin(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def head_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group.  Spark turns the rank limit into a partial limit before the exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def first_n(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.orderBy(index).limit(n)


def groups_over(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups with more than ``least`` rows; the counts are joined back, not windowed."""
    big = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > least).drop("__n")
    return df.join(big, by, "left_semi")


#: Hash classes of a group's rows, each of which gives one row as a boundary of the group's ranges.
_PIVOTS = 64


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "__r", total: str = "__n") -> DataFrame:
    """Adds each row's rank in its group, from 1, and the group's number of rows; null keys are a group, nulls come first.

    No group is sorted by one task: up to ``_PIVOTS`` of its rows, chosen by hash, cut it into ranges; a row's rank is the
    number of rows in the ranges before its own, and its rank in that.  Any boundaries give the same ranks."""
    key = F.struct(*order)
    picked = df.groupBy(*by, F.pmod(F.xxhash64(*order), F.lit(_PIVOTS)).alias("__c")).agg(F.min_by(key, F.xxhash64(F.lit(1), *order)).alias("__k"))
    bounds = picked.groupBy(*by).agg(F.collect_list("__k").alias("__k")).select(*[F.col(c).alias(f"__b_{c}") for c in by], "__k")
    same = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by]
    cut = df.join(bounds, same).withColumn("__p", F.size(F.filter("__k", lambda k: k < key))).drop("__k", *bounds.columns)
    inside = Window.partitionBy(*by, "__p").orderBy(*order)
    sums = cut.groupBy(*by, "__p").agg(F.count("*").alias("__s"))
    group = Window.partitionBy(*by)  # at most one row for each range
    before = F.coalesce(F.sum("__s").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__p").alias("__b__p"), before.alias("__before"), F.sum("__s").over(group).alias(total))
    placed = cut.withColumn("__i", F.row_number().over(inside)).join(sums, [*same, F.col("__p") == F.col("__b__p")])
    return placed.withColumn(rank, F.col("__before") + F.col("__i")).select(*df.columns, rank, total)


def fraction_split(df: DataFrame, by: list[str], order: list[str], train: float = 0.75, val: float = 0.10) -> DataFrame:
    """Within each group, by rank: floor(n * train) rows train, floor(n * val) rows val, the rest test."""
    df = ranked(df, by, order)
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return df.withColumn("split", F.when(F.col("__r") <= a, "train").when(F.col("__r") <= a + b, "val").otherwise("test")).drop("__r", "__n")


def choose_units(df: DataFrame, by: list[str], unit: str, n: int, seed: int = 0) -> DataFrame:
    """The rows of n units of each group (districts of a state, files of a district), chosen by hash; all where there are
    fewer.  Only distinct units are ranked, and Spark limits their ranks before the exchange."""
    units = df.where(F.col(unit).isNotNull()).select(*by, unit).distinct().withColumn("__h", F.xxhash64(F.lit(seed), *by, unit))
    chosen = head_n(units, by, ["__h", unit], n).select(*[F.col(c).alias(f"__u_{c}") for c in [*by, unit]])
    return df.join(chosen, [F.col(c).eqNullSafe(F.col(f"__u_{c}")) for c in [*by, unit]], "left_semi")


def disjoint_speakers(df: DataFrame, speaker: str, group: str, test_speakers: list[str], n_val: int) -> DataFrame:
    """Speakers are in one split only: listed ones in test (whatever their case), then the first min(n_val, n - 1) of
    each group in val, the rest in train.  Ranks are over distinct speakers."""
    people = df.select(speaker, group).distinct().withColumn("__test", F.lower(speaker).isin([s.lower() for s in test_speakers]))
    w = Window.partitionBy(group, "__test")
    people = people.withColumn("__r", F.row_number().over(w.orderBy(speaker))).withColumn("__n", F.count("*").over(w))
    split = F.when(F.col("__test"), "test").when(F.col("__r") <= F.least(F.lit(n_val), F.col("__n") - 1), "val").otherwise("train")
    return df.join(people.select(speaker, group, split.alias("split")), [speaker, group])


def carve_validation(df: DataFrame, unit: str, ratio: float, seed: int = 0) -> DataFrame:
    """Of the train rows' units (utterances or speakers), max(1, floor(n * ratio)) go to val, chosen by hash."""
    units = df.where("split = 'train'").select(unit).distinct().withColumn("__h", F.xxhash64(F.lit(seed), unit))
    n = units.count()
    chosen = units.orderBy("__h", unit).limit(max(1, int(n * ratio)) if n else 0).select(unit, F.lit(True).alias("__v"))
    moved = df.join(chosen, unit, "left").withColumn("split", F.when(F.col("__v") & (F.col("split") == "train"), "val").otherwise(F.col("split")))
    return moved.select(*df.columns)


#: Buckets of a running sum over conversations, whatever their number.
_BUCKETS = 256


def conversation_split(df: DataFrame, conversation: str, label: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Whole conversations in train, val or test.  First every split gets one of each label, rarest label first, as far as
    conversations go round; the others fill the splits up to their shares of the rows, in the order of a hash.

    The first pass places three conversations for each label at most, so it needs no more than the smallest few of each
    label; those are all that reaches the driver.  The second is a running sum, by buckets and within them."""
    sizes = df.where(F.col(conversation).isNotNull()).groupBy(conversation).agg(F.collect_set(label).alias("labels"), F.count("*").alias("n"))
    held = sizes.select(conversation, "labels", "n", F.explode("labels").alias("label"))
    number = {r["label"]: r["c"] for r in held.groupBy("label").agg(F.count("*").alias("c")).collect()}  # one row a label
    order = Window.partitionBy("label").orderBy("n", F.col(conversation).cast("string"))
    few = held.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 3 * max(1, len(number)))
    rows = {r[conversation]: r for r in few.select(conversation, "labels", "n").collect()}
    names, total = ("train", "val", "test"), sizes.agg(F.sum("n")).first()[0] or 0
    where: dict[object, str] = {}
    filled = dict.fromkeys(names, 0)
    for k in sorted(number, key=lambda k: (number[k], str(k))):
        own = [r for r in rows.values() if k in r["labels"]]
        for name in ("test", "val", "train"):
            free = [r for r in own if r[conversation] not in where]
            if free and not any(where.get(r[conversation]) == name for r in own):
                r = min(free, key=lambda r: (r["n"], str(r[conversation])))
                where[r[conversation]] = name
                filled[name] += r["n"]
    kind = df.schema[conversation].dataType.simpleString()
    side = df.sparkSession.createDataFrame(list(where.items()), f"{conversation} {kind}, __placed string")
    rest = sizes.select(conversation, "n").join(side, conversation, "left_anti").withColumn("__h", F.xxhash64(F.lit(seed), conversation))
    rest = rest.withColumn("__b", F.pmod("__h", F.lit(_BUCKETS)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets' sums, a few rows
    sums = rest.groupBy("__b").agg(F.sum("n").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    inside = Window.partitionBy("__b").orderBy("__h", conversation).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("__before") + F.sum("n").over(inside) - F.col("n") / 2
    need = [max(0.0, share * total - filled[s]) for s, share in zip(names, ratios, strict=True)]
    left = total - sum(filled.values())
    scale = left / sum(need) if sum(need) else 0.0
    dealt = rest.join(sums, "__b").withColumn("__m", middle)
    split = F.when(F.col("__m") < need[0] * scale, "train").when(F.col("__m") < (need[0] + need[1]) * scale, "val").otherwise("test")
    placed = dealt.select(conversation, split.alias("split")).unionByName(side.select(conversation, F.col("__placed").alias("split")))
    return df.drop("split").join(placed, conversation, "left")


def few_shot(df: DataFrame, label: str, key: str, policy: str, k: int = 0, seed: int = 0) -> DataFrame:
    """all_class: one example of each class; k_class: of k classes; k_sample: k examples of any class."""
    ranked = df.withColumn("__h", F.xxhash64(F.lit(seed), key))
    if policy == "k_sample":
        return ranked.orderBy("__h", key).limit(k).drop("__h")
    one = ranked.groupBy(label).agg(F.min_by(F.struct(*df.columns), F.struct("__h", key)).alias("__one"), F.min(F.xxhash64(F.lit(seed), label)).alias("__c"))
    if policy == "k_class":
        one = one.orderBy("__c", label).limit(k)
    elif policy != "all_class":
        raise ValueError(f"unknown policy {policy!r}")
    return one.select("__one.*")


def chance_predictions(df: DataFrame, key: str, kind: str, seed: int, low: float = 0, high: float = 1) -> DataFrame:
    """Uniform guesses: integers in [low, high], floats in [low, high), or a place on the sphere in radians."""
    u, v = coin(seed, key), coin(seed + 7919, key)
    if kind == "int":
        return df.withColumn("guess", (F.floor(u * (high - low + 1)) + F.lit(low)).cast("long"))
    if kind == "float":
        return df.withColumn("guess", u * (high - low) + low)
    if kind == "place":
        return df.withColumn("guess", F.struct(F.asin(2 * u - 1).alias("lat"), ((2 * v - 1) * F.pi()).alias("lon")))
    raise ValueError(f"unknown kind {kind!r}")


def train_mode(df: DataFrame, value: str, index: str) -> DataFrame:
    """The most frequent value; of equals the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1)


def mask_phones(df: DataFrame, key: str, phones: str, ratio: float, mark: str = "[NOISE]", seed: int = 0) -> DataFrame:
    """Adds masked_phones; the first phone is never masked."""
    masked = F.transform(phones, lambda p, i: F.when((i > 0) & (coin(seed, F.col(key), i) < ratio), mark).otherwise(p))
    return df.withColumn("masked_phones", masked)


def chunk_ids(df: DataFrame, index: str, n_tasks: int, total: int | None = None) -> DataFrame:
    """Contiguous chunks of ceil(N / n_tasks) rows by index."""
    total = df.count() if total is None else total
    return df.withColumn("chunk", F.floor(F.col(index) / max(1, -(-total // n_tasks))).cast("long"))


def batches(total: int, size: int) -> Iterator[range]:
    for at in range(0, total, size):
        yield range(at, min(at + size, total))
