"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``CHUNK`` code points is encoded as it is.  A longer one is cut into chunks that overlap by ``OVERLAP`` code
points on either side of each seam; chunks of one text are encoded by different tasks.  Around a seam both neighbours list
their tokens with offsets.  A token that both have, at the same place, is a *proven stable* boundary: merges are made
by rank, leftmost first, so two adjacent tokens of one encoding stay apart in any text (a merge across them would
have happened in the chunk as well), and a sequence whose neighbours all stay apart is the encoding of the whole.  The token's
left neighbours come from one chunk, the token and its right neighbours from the other; the count is spliced there.  Texts
with a seam where the chunks agree on no token are encoded again with chunks and overlaps ``WIDEN`` times as long, at last
as one chunk.

Only codes of the tokens in the overlaps are shuffled by text, and the chunks of long texts once, dealt by text and
chunk: neither a text of any length nor its many copies meet in one task.

The proof needs a byte-pair model without normalization beyond the mark for white space; other models are refused.

Defined results: null text is empty and has no token; a text is read whole, its white space, control characters and strings
that look like special tokens as the library takes them; ids of any type are kept, null ids as well; repeated rows get a row
each; an empty table gives an empty one; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Boxed, stored, text_of, tidy

LIMIT = 4096
#: Code points of a chunk, and of the overlap on either side of a seam.
CHUNK, OVERLAP = 16_384, 128
#: How many times longer both are after a seam without a common token.
WIDEN = 4
#: Code points of short texts that are encoded in one call.
_CALL = 1 << 18


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A byte-pair model of pieces, and how many code points each id stands for."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        user_defined = proto.ModelProto.SentencePiece.USER_DEFINED
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces and rules.add_dummy_prefix
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not plain or any(p.type == user_defined for p in spec.pieces):
            raise ValueError("chunks can be spliced for byte-pair models without normalization only")
        # a byte stands for a code point if it begins one
        self.width = np.array(
            [int(p.piece[1:-1], 16) & 0xC0 != 0x80 if p.type == proto.ModelProto.SentencePiece.BYTE else len(p.piece) for p in spec.pieces], np.int64
        )

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each begins and ends; the first begins at -1, with the mark before the text."""
        ids = np.array(self.model.encode(text, num_threads=1), np.int64)
        ends = np.cumsum(self.width[ids]) - 1
        return ids, ends - self.width[ids], ends


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One for each worker process and file, kept over tasks."""
    return PieceModel(path)


def _short(path: str, texts: DataFrame, kind: str) -> DataFrame:
    """(_id, n_bytes, n_tokens) of texts that are one chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            found, held, size = [], [], 0
            for text in b.column("_text"):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= _CALL:
                    found += model.counts(held)
                    held, size = [], 0
            found += model.counts(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_bytes"), pa.array(found, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    return texts.select("_id", "n_bytes", "_text").mapInArrow(tidy(count), f"_id {kind}, n_bytes long, n_tokens long")


_KEY = ["_id", "_h1", "_h2", "n_bytes"]


def _chunks(texts: DataFrame, kind: str, chunk: int, overlap: int) -> DataFrame:
    """The key of a text, the number of a chunk and of chunks, and the chunk with its overlaps."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_KEY, "_k", "_m", "_text"]
        for b in batches:
            for row in range(b.num_rows):
                text = b.column("_text")[row].as_py()
                m = max(1, -(-len(text) // chunk))
                step = max(1, (1 << 22) // (chunk + 2 * overlap))  # chunks in a batch
                for first in range(0, m, step):
                    ks = range(first, min(m, first + step))
                    key = [pa.array([b.column(c)[row].as_py()] * len(ks), b.column(c).type) for c in _KEY]
                    parts = [text[max(0, k * chunk - overlap) : (k + 1) * chunk + overlap] for k in ks]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(ks, pa.int64()), pa.array([m] * len(ks), pa.int64()), pa.array(parts, pa.string())], names=names)

    return texts.select(*_KEY, "_text").mapInArrow(tidy(cut), f"_id {kind}, _h1 long, _h2 long, n_bytes long, _k long, _m long, _text string")


def _sides(path: str, chunks: DataFrame, kind: str, chunk: int, overlap: int) -> DataFrame:
    """Two rows a chunk: what it knows about the seam before it, with its count of tokens, and about the seam behind it.

    ``_codes`` holds place and id of each token that lies in the overlap; ``_out`` the tokens before the first of them, or
    from the first of them on: those that a splice there takes from the neighbour."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            rows = []
            for at, (k, m, text) in enumerate(zip(b.column("_k").to_pylist(), b.column("_m").to_pylist(), b.column("_text"), strict=True)):
                ids, begin, end = model.ids(text.as_py())
                base = max(0, k * chunk - overlap)
                begin, end = begin + base, end + base
                for side, seam in ((0, k), (1, k + 1)):
                    if side and seam == m:
                        continue
                    near = np.empty(0, np.int64)
                    if seam:  # whole tokens of at least one code point in the overlap
                        near = np.flatnonzero((begin >= max(base, seam * chunk - overlap)) & (end <= seam * chunk + overlap) & (end > begin))
                    first = int(near[0]) if len(near) else 0
                    place = begin[near] - (seam * chunk - overlap)
                    rows.append((at, seam, side, place * len(model.width) + ids[near], near - first, len(ids) - first if side else first, len(ids)))
            at, seam, side, codes, steps, out, n = map(list, zip(*rows, strict=True)) if rows else ([],) * 7
            key = [b.column(c).take(pa.array(at, pa.int64())) for c in _KEY]
            longs = pa.list_(pa.int64())
            cols = [pa.array(seam, pa.int64()), pa.array(side, pa.int64()), pa.array(codes, longs), pa.array(steps, longs), pa.array(out, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*key, *cols], names=[*_KEY, "_seam", "_side", "_codes", "_steps", "_out", "_n"])

    schema = f"_id {kind}, _h1 long, _h2 long, n_bytes long, _seam long, _side long, _codes array<long>, _steps array<long>, _out long, _n long"
    return chunks.mapInArrow(tidy(encode), schema)


def _spliced(sides: DataFrame) -> DataFrame:
    """The key of a text, its count of rows, and its tokens; null tokens where a seam has no common token."""

    def of(side: int, name: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(name)))

    seams = sides.groupBy(*_KEY, "_seam").agg(
        of(1, "_codes").alias("_left"), of(0, "_codes").alias("_right"), of(1, "_steps").alias("_left_steps"), of(0, "_steps").alias("_right_steps"),
        of(1, "_out").alias("_after"), of(0, "_out").alias("_before"), of(0, "_n").alias("_n"), F.sum(F.when(F.col("_side") == 0, 1)).alias("_rows"),
    )
    both = F.array_intersect("_left", "_right")
    seams = seams.withColumn("_common", F.when(F.size(both) > 0, both[0]))
    steps = {s: F.col(f"_{s}_steps")[F.array_position(f"_{s}", F.col("_common")).cast("int") - 1] for s in ("left", "right")}
    gone = F.when(F.col("_seam") == 0, 0).otherwise(F.col("_after") - steps["left"] + F.col("_before") + steps["right"])
    totals = seams.withColumn("_own", F.col("_n") - gone).groupBy(*_KEY).agg(
        F.sum("_own").alias("_sum"), F.bool_and(F.col("_own").isNotNull()).alias("_whole"), F.max("_rows").alias("_rows")
    )
    return totals.withColumn("n_tokens", F.when(F.col("_whole"), F.col("_sum"))).drop("_sum", "_whole")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``limit``: tokens beyond which ``over_limit`` holds."""
    if not 0 < 2 * overlap < chunk:
        raise ValueError("two overlaps must fit in a chunk")
    path = model or default_model()
    box = Boxed(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(box.col(text_col))
    slim = box.df.select(box.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    found = [_short(path, slim.where(F.char_length("_text") <= chunk), kind)]

    long_ones = slim.where(F.char_length("_text") > chunk)
    long_ones = long_ones.withColumns({"_h1": F.xxhash64("_text"), "_h2": F.xxhash64(F.lit(1), "_text")})
    left = long_ones
    while True:
        dealt = _chunks(left, kind, chunk, overlap).repartition("_h1", "_id", "_k")
        counted = stored(_spliced(_sides(path, dealt, kind, chunk, overlap)), "token-counts")
        good = counted.where("n_tokens is not null")
        found.append(good.select("_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_one")).drop("_one"))
        bad = counted.where("n_tokens is null").select(*[F.col(c).alias(f"{c}_bad") for c in _KEY])
        if bad.isEmpty():
            break
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_bad")) for c in _KEY])
        left = long_ones.join(bad, same, "left_semi")
        chunk, overlap = WIDEN * chunk, WIDEN * overlap
    every = reduce(DataFrame.unionAll, found)
    return every.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
