"""SimHash near-dedup by the segment-popcount embedding.

Each text becomes a 64-bit fingerprint.  A fingerprint is embedded as the numbers of set bits in segments of two bits.
One differing bit changes one count by one, so the Manhattan distance of two embeddings is a lower bound of the Hamming distance of the fingerprints.  Fingerprints that differ in at most three bits have,
in one half of the segments at least, counts that differ by one in all at most: each half is a grid whose cells are vectors of counts, and
the range-join pairs a cell with itself and with the cells one step up in one direction (the step down is the same pair
seen from the other side).  Candidates must then pass the Manhattan bound over all segments and the exact test.

Only distinct fingerprints are joined, so a group of copies of any size is one row.  Links are reduced to components by
alternating star contraction, whose rounds are written to the shared folder.  Nothing about documents is collected.

Defined results: null text has no words; texts without words have fingerprint zero and are linked like any other;
repeated rows get the same answer; a null id keeps its row and never becomes a component's id while another id is there;
very long texts are read whole, their bits counted in pieces; an empty table gives an empty one; columns other than id
and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Boxed, stored, tidy

SEED = 42
MAX_BITS = 3
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint_of(text: str | bytes | None, words: int = 3) -> int:
    """The signed 64-bit value of the fingerprint of one whole text, or of its UTF-8 bytes."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    # bytes.split() without an argument splits at exactly the six ASCII white space characters
    tokens = raw.translate(_LOWER).split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, _fp) for each row; ``_th`` tells texts of one id, or of none, apart."""
    box = Boxed(docs)
    text = box.col(text_col).cast("string")
    slim = box.df.select(box.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(x.as_py()) for x in b.column(2).cast(pa.binary())), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["_id", "_th", "_fp"])

    return slim.mapInArrow(tidy(run), "_id long, _th long, _fp long")


def _counts(fp: Column) -> Column:
    """Counts of set bits of all 32 segments of two bits, each in its own two bits of one long."""
    pairs = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(pairs), F.shiftrightunsigned(fp, 1).bitwiseAND(pairs)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _half(counts: Column, half: int) -> Column:
    return F.shiftrightunsigned(counts, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def _manhattan(a: Column, b: Column) -> Column:
    """Sum of the absolute differences of all 32 counts.  Counts are 0, 1 or 2; in unary (0, 1, 3) their difference is
    the number of differing bits."""
    twos = F.lit(-0x5555555555555556)

    def unary(c: Column) -> Column:
        return c.bitwiseOR(F.shiftrightunsigned(c.bitwiseAND(twos), 1))

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints of ``fps`` (one long column ``fp``, no repeats) that differ in at most
    ``max_bits`` bits, each once or twice.  ``max_bits`` may be up to 3, as the two grids guarantee no more."""
    if max_bits > 3:
        raise ValueError("two half grids with one step guarantee up to three bits")
    base = fps.select("fp", _counts(F.col("fp")).alias("counts"))
    halves = F.array(*[F.struct(F.lit(h).alias("half"), _half(F.col("counts"), h).alias("cell")) for h in (0, 1)])
    home = base.select("fp", "counts", F.explode(halves).alias("g")).select("fp", "counts", "g.half", "g.cell")
    # a step up in one of the half's 16 segments, where the count is below two
    steps = F.expr("filter(sequence(0, 15), s -> shiftrightunsigned(cell, 2 * s) % 4 < 2)")
    moved = F.expr("concat(array(cell), transform(_steps, s -> cell + shiftleft(1L, 2 * s)))")
    probe = home.withColumn("_steps", steps).select("fp", "counts", "half", F.explode(moved).alias("cell"))
    a = home.select(F.col("fp").alias("a"), F.col("counts").alias("ca"), "half", "cell")
    b = probe.select(F.col("fp").alias("b"), F.col("counts").alias("cb"), "half", "cell")
    near = (
        a.join(b, ["half", "cell"])
        .where(F.col("a") != F.col("b"))
        .where(_manhattan(F.col("ca"), F.col("cb")) <= max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    return near.select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (long columns a, b; any direction, repeats allowed) the smallest node
    of its component.  Alternating large-star and small-star rounds; each is written to the shared folder."""
    def checksum(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few=True)
    before = checksum(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node's smaller neighbours and itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v")
        new = stored(small.distinct(), "edges", few=True)
        e, after = new, checksum(new)
        if after == before:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classify(slim: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(_fp, _component, _root) for each distinct fingerprint of ``slim`` (_id, _fp); ``_root``, a fingerprint, tells
    components of the same smallest id apart."""
    classes = stored(slim.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("rep")), "classes", few=True)
    found = components(links(classes.select("fp"), max_bits))
    named = found.join(classes.withColumnRenamed("fp", "node"), "node")
    # stored, so that the join is of plain exchanges, of which Spark splits that of a component with very many members
    lowest = stored(named.groupBy("root").agg(F.min("rep").alias("low")), "lowest", few=True)
    linked = named.join(lowest, "root").select(F.col("node").alias("_fp"), "low", "root")
    per_class = classes.withColumnRenamed("fp", "_fp").join(linked, "_fp", "left")
    named = per_class.select("_fp", F.coalesce("low", "rep").alias("_component"), F.coalesce("root", "_fp").alias("_root"))
    # stored, so that the join with the rows is of plain exchanges, of which Spark splits a hot fingerprint's
    return stored(named, "named", few=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """For each row of ``docs`` its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable
    over links of at most ``max_bits`` bits."""
    slim = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = slim.join(classify(slim, max_bits), "_fp")
    return rows.select(F.col("_id").alias(id_col), hex_of(F.col("_fp")).alias("fingerprint"), F.col("_component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: that of the smallest id, null last, and of the smallest hash of the text where texts
    share that id.  Neither a null id nor one that comes back in another component keeps a row or loses one."""
    slim = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = slim.join(classify(slim, max_bits), "_fp")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_th"))
    keepers = rows.groupBy("_root").agg(first.alias("k")).select(F.col("k._id").alias("_keep"), F.col("k._th").alias("_kth"))
    box = Boxed(docs)
    base = box.df.withColumn("_id", box.col(id_col).cast("long")).withColumn("_th", F.xxhash64(box.col(text_col).cast("string")))
    left = base.join(keepers, base["_id"].eqNullSafe(keepers["_keep"]) & (base["_th"] == keepers["_kth"]), "left_semi")
    return box.restore(left.dropDuplicates(["_id", "_th"]), {})


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
