"""Line dedup: lines that many documents share are kept in one of them only.

Lines are exploded and reduced to a 128-bit hash of their key; documents are counted for each hash; the positions of
the lines to drop go back to their document, where the remaining lines are joined again by position.  Only hashes and
positions are shuffled for the counts.  A hot line is one row for each document in an exchange on (hash, document) and
is summed in each task before the exchange on the hash.  The sums are stored before the joins that bring the verdict back,
so that both sides of a join are plain exchanges and Spark can split the partition of a hot hash.

Defined results:

* a null or empty text is one empty line;
* rows that repeat both id and text are one document; rows with the same id and another text are counted once for the
  id, and each is cleaned on its own;
* a null id counts as a document and is smaller than any other id;
* lines of any length are hashed whole, and texts of any length split whole; an empty table gives an empty one;
* among ties nothing is left open: the largest id holding the line keeps all its copies of it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Boxed, stored, text_of


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(ASCII_SPACE))


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z in lower case; other letters stay."""
    return F.translate(_bare(line), string.ascii_uppercase, string.ascii_lowercase)


def key_parts(bare: Column) -> tuple[Column, Column]:
    """Two strings that are equal for two stripped lines exactly where their keys are; much cheaper than translate().

    lower() also folds other letters, so beside it stand all non-ASCII characters as they are.  But for the two letters
    whose lower case holds ASCII, lower() keeps every character's place, and the two strings together give the key.
    """
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    odd = F.contains(bare, F.lit("\u212a")) | F.contains(bare, F.lit("\u0130"))
    folded = F.when(ascii_only | ~odd, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))
    others = F.when(ascii_only | odd, F.lit("")).otherwise(F.regexp_replace(bare, r"[\x00-\x7F]+", ""))
    return folded, others


def _dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_id, _th, _drop): for each document that loses lines, their positions."""
    lines = docs.select("_id", "_th", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    bare = lines.select("_id", "_th", "_pos", _bare(F.col("_line")).alias("_bare")).where(F.char_length("_bare") >= min_chars)
    parts = key_parts(F.col("_bare"))
    # two 64-bit hashes with different seeds: equal only for equal keys, for all practical sizes
    hashed = bare.select("_id", "_th", "_pos", F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(1), *parts).alias("_h2"))
    # lines are read once: the counts and the join back both start from this table of hashes
    held = stored(hashed.groupBy("_h1", "_h2", "_id", "_th").agg(F.collect_set("_pos").alias("_at")), "lines")
    per_id = held.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
    shared = (
        per_id.groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
    )
    # stored, so that both sides of the join are plain exchanges, of which Spark splits a hot hash's
    shared = stored(shared, "shared", few=True)
    lost = held.join(shared, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    return stored(lost.groupBy("_id", "_th").agg(F.flatten(F.collect_list("_at")).alias("_drop")), "drops", few=True)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """All rows of ``docs`` with the text cleaned, and the columns ``n_lines`` and ``n_dropped``.

    ``min_chars``: a key needs so many code points.  ``min_docs``: and so many documents.  Columns of ``docs`` named
    like the two new ones are replaced; other columns stay.
    """
    box = Boxed(docs)
    base = box.df.withColumn("_id", box.col(id_col)).withColumn("_text", text_of(box.col(text_col)))
    base = base.drop(f"c{box.names.index(text_col)}").withColumn("_th", F.xxhash64("_text"))
    drops = _dropped_positions(base.select("_id", "_text", "_th"), min_chars, min_docs)
    drops = drops.select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), "_drop")
    joined = base.join(drops, base["_id"].eqNullSafe(drops["_id2"]) & (base["_th"] == drops["_th2"]), "left")
    split = joined.withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _drop), i -> _lines[i])")
    values = {
        text_col: F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long"),
    }
    return box.restore(split, values)
