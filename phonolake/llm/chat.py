"""Chat formatting with cumulative-snapshot collapse.

A logging client often stores a conversation again after every turn, so that a log holds many prefixes of one talk.
For each conversation the turns are put in order and a rolling hash is kept for every prefix: the exclusive or of a
128-bit hash of (place, role, text) over the turns so far.  A conversation goes if its whole hash is the hash of a
proper prefix of another (an anti-join of two distinct sets, so a first turn that everyone shares is one row); of equal
conversations the one with the smallest id stays.  What remains is rendered as one string.

Defined results: turns are ordered by turn, then role, then text, nulls first; rows that repeat turn, role and text are
one turn; a null role is rendered as ``unknown`` and is not equal to that word in the hash; null text is rendered empty
and differs from the empty text in the hash; a null conversation id is one conversation; very long texts and conversations are
hashed whole; an empty table gives an empty one; columns other than the four named ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Boxed, stored

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (_conv, _turn, _role, _text) with _place and the rolling hash _h1, _h2 of the prefix that ends there."""
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text").asc_nulls_first())
    placed = turns.withColumn("_place", F.row_number().over(order))
    parts = ["_place", F.col("_role").isNull(), F.coalesce("_role", F.lit("")), F.col("_text").isNull(), F.coalesce("_text", F.lit(""))]
    hashed = placed.withColumn("_x1", F.xxhash64(*parts)).withColumn("_x2", F.xxhash64(F.lit(7), *parts))
    sofar = Window.partitionBy("_conv").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.withColumn("_h1", F.bit_xor("_x1").over(sofar)).withColumn("_h2", F.bit_xor("_x2").over(sofar)).drop("_x1", "_x2")


def collapse(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, n_turns, n_equal): the maximal conversations; n_equal counts conversations with the same turns."""
    whole, proper = _whole_and_proper(_prepared(turns, conv_col, turn_col, role_col, text_col))
    return _maximal(whole, proper).select(F.col("_conv").alias(conv_col), F.col("_n").cast("long").alias("n_turns"), F.col("_same").alias("n_equal"))


def _prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    box = Boxed(turns)
    return box.df.select(
        box.col(conv_col).alias("_conv"), box.col(turn_col).alias("_turn"),
        box.col(role_col).cast("string").alias("_role"), box.col(text_col).cast("string").alias("_text"),
    ).distinct()


def _whole_and_proper(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    slim = prefixes(turns).select("_conv", "_place", "_h1", "_h2")
    slim = stored(slim.withColumn("_n", F.max("_place").over(Window.partitionBy("_conv"))), "prefixes")
    whole = slim.where("_place = _n").groupBy("_n", "_h1", "_h2").agg(F.min("_conv").alias("_conv"), F.count("*").alias("_same"))
    proper = slim.where("_place < _n").select(F.col("_place").alias("_n"), "_h1", "_h2").distinct()
    return whole, proper


def _maximal(whole: DataFrame, proper: DataFrame) -> DataFrame:
    return whole.join(proper, ["_n", "_h1", "_h2"], "left_anti")


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, n_turns, n_equal, text): the maximal conversations, rendered."""
    base = _prepared(turns, conv_col, turn_col, role_col, text_col)
    whole, proper = _whole_and_proper(base)
    keep = _maximal(whole, proper).select(F.col("_conv").alias("_k"), F.col("_n"), F.col("_same"))
    left = base.join(keep, base["_conv"].eqNullSafe(keep["_k"]))
    line = F.concat(F.lit(START), F.coalesce("_role", F.lit("unknown")), F.lit("\n"), F.coalesce("_text", F.lit("")), F.lit(f"{END}\n"))
    got = left.groupBy("_conv", "_n", "_same").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text", line.alias("_line")))).alias("_all"))
    return got.select(
        F.col("_conv").alias(conv_col), F.col("_n").cast("long").alias("n_turns"), F.col("_same").alias("n_equal"),
        F.array_join(F.transform("_all", lambda x: x["_line"]), "").alias("text"),
    )
