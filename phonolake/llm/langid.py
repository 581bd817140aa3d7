"""Language identification with string kernels.

A text is the set of its blended n-grams: all byte strings of one to ``MAX_N`` bytes of its UTF-8 form with A-Z in lower
case, digits, symbols and runs of white space reduced, each hashed to one of ``FEATURES`` numbers (blended spectrum,
presence only).  The kernel of two texts is the cosine of their sets.  Landmarks are drawn from a bounded sample of
labelled rows (Nystroem); the labelled sample is mapped by the landmarks and one ridge regression for each language
against the rest is solved.  As the kernel is a scalar product of explicit sets, landmark matrix, Nystroem map and
regression weights multiply out to one matrix of features by languages, and a batch of texts is scored by one matrix
product with it.

The sample is the only bounded thing: ``per_language`` rows of each language with the smallest hash of id and text, the
``MAX_LANGUAGES`` labels of the most rows, and ``MAX_LANDMARKS`` landmarks in all.  Executors sum the normal equations over the sample, so
no table of rows by features is ever in one place.  Whole texts are read, in training and in prediction.  Ids may be of any type.

Defined results: null text, or text without a letter (a character that Unicode counts as one; digits, fractions and
superscripts are none), is ``und`` with score 0; without any labelled row every text is ``und``; ties go to the language that
sorts first; repeated rows get equal answers and train once; a null id is held out by no rule and is predicted like any other; very long
texts are read in overlapping pieces; an empty table gives an empty one; columns other than id, text and language are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Boxed, stored, tidy

MAX_N = 4
FEATURES = 1 << 15
#: Documented bounds of the labelled sample and of the landmarks in it, for each language.
PER_LANGUAGE, LANDMARKS = 300, 48
#: Landmarks of all languages together: with more than 32 languages each has fewer.
MAX_LANDMARKS = 1536
#: Labels that are learned at most: those of the most rows.  Sums for so many reach the driver.
MAX_LANGUAGES = 1000
RIDGE = 1e-2
#: Every byte that is ASCII but no letter becomes a space; A-Z become a-z.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Bytes of one long text that are turned into n-grams at once; pieces overlap, so no n-gram is lost.
_BLOCK = 1 << 20
#: Features whose bits are unpacked at once.
_COLUMNS = 1 << 11


def presence(text: str) -> np.ndarray:
    """The set of the text's n-grams, as booleans by feature."""
    out = np.zeros(FEATURES, bool)
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    for at in range(0, len(raw), _BLOCK):
        v = np.frombuffer(raw[at : at + _BLOCK + MAX_N - 1], np.uint8).astype(np.uint32) + np.uint32(1)
        h = np.zeros(len(v), np.uint32)
        for n in range(1, MAX_N + 1):
            if len(v) < n:
                break
            h = h[: len(v) - n + 1] * np.uint32(0x01000193) + v[n - 1 :]
            out[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)] = True
    return out


def _unpack(packed: np.ndarray, at: int) -> np.ndarray:
    return np.unpackbits(packed[:, at // 8 : (at + _COLUMNS) // 8], axis=1).astype(np.float32)


def _norm(packed: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.bitwise_count(packed).sum(1, dtype=np.int64), 1)).astype(np.float32)[:, None]


class Landmarks:
    """Packed sets of the landmarks, and the map of kernels against them to K_mm^(-1/2).  Sets are unpacked a block of features at
    a time."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        value, vector = np.linalg.eigh(self.kernels(packed).astype(np.float64))
        keep = value > 1e-8 * value.max()
        self.root = vector[:, keep] / np.sqrt(value[keep])

    def kernels(self, packed: np.ndarray) -> np.ndarray:
        """Cosines of sets and landmarks."""
        out = np.zeros((len(packed), len(self.packed)), np.float32)
        for at in range(0, FEATURES, _COLUMNS):
            out += _unpack(packed, at) @ _unpack(self.packed, at).T
        return out / _norm(packed) / _norm(self.packed).T

    def mapped(self, packed: np.ndarray) -> np.ndarray:
        """Nystroem features of sets, and a constant."""
        return np.hstack([self.kernels(packed) @ self.root, np.ones((len(packed), 1))])

    def multiplied(self, b: np.ndarray) -> np.ndarray:
        """The matrix of features by languages that gives what kernels, map and weights ``b`` give one after the other."""
        by_mark = (self.root @ b).astype(np.float32) / _norm(self.packed)
        return np.concatenate([_unpack(self.packed, at).T @ by_mark for at in range(0, FEATURES, _COLUMNS)])


class Sums:
    """Sums of the normal equations over rows: products of features, and features by language, where a row weighs as little as its
    language has many in the sample."""

    def __init__(self, marks: Landmarks, share: np.ndarray):
        self.marks, self.share = marks, share
        n = marks.root.shape[1] + 1
        self.products, self.by_language = np.zeros((n, n)), np.zeros((n, len(share)))

    def add(self, packed: np.ndarray, y: np.ndarray) -> None:
        phi = self.marks.mapped(packed)
        weighted = phi * self.share[y][:, None]
        self.products += phi.T @ weighted
        np.add.at(self.by_language.T, y, weighted)


class KernelModel:
    """One matrix of features by languages, a constant for each, and the languages."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    @classmethod
    def none(cls) -> KernelModel:
        return cls([], np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32))

    @classmethod
    def solved(cls, languages: list[str], marks: Landmarks, products: np.ndarray, by_language: np.ndarray, ridge: float = RIDGE) -> KernelModel:
        """Ridge regression of each language (1) against the rest (-1)."""
        target = 2 * by_language - by_language.sum(1, keepdims=True)
        b = np.linalg.solve(products + ridge * np.trace(products) / len(products) * np.eye(len(products)), target)
        return cls(languages, marks.multiplied(b[:-1]), b[-1].astype(np.float32))

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
        """A fit of rows in memory.  x: rows of presences; labels: their languages."""
        languages = sorted(set(labels))
        y = np.array([languages.index(v) for v in labels])
        packed = np.packbits(x, axis=1)
        marks = Landmarks(packed[np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])])
        sums = Sums(marks, 1 / np.bincount(y))
        sums.add(packed, y)
        return cls.solved(languages, marks, sums.products, sums.by_language, ridge)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One matrix product for a batch of presences."""
        norm = np.sqrt(np.maximum(x.sum(1), 1)).astype(np.float32)
        return (x.astype(np.float32) @ self.weights) / norm[:, None] + self.bias

    def predict(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            has = [bool(t) and any(map(str.isalpha, t)) and bool(self.languages) for t in part]
            rows = [presence(t) for t, ok in zip(part, has, strict=True) if ok]
            best = iter(())
            if rows:
                s = self.scores(np.stack(rows))
                top = s.argmax(1)
                best = iter(zip(top.tolist(), ((s[np.arange(len(s)), top] + 1) / 2).clip(0, 1).tolist(), strict=True))
            for ok in has:
                k, v = next(best) if ok else (None, 0.0)
                names.append("und" if k is None else self.languages[k])
                scores.append(float(v))
        return names, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _by_language(values: dict[str, int], none: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in sorted(values.items()) for v in kv]), F.col("lang")), F.lit(none))


def sample(labelled: DataFrame, per_language: int, landmarks: int) -> DataFrame | None:
    """(lang, bits, mark): the packed sets of the rows that train, and whether they are landmarks; None without labelled rows.  What
    reaches the driver are three numbers a language."""
    rows = labelled.where("text is not null and lang is not null").withColumn("_u", F.xxhash64(F.lit(3), "doc_id", "text").bitwiseAND(F.lit(2**40 - 1)))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not most:
        return None
    # so many are expected under this hash that fewer than per_language are unlikely; the rest is cut below
    cut = {r["lang"]: min(2**40, int(2**40 * (2 * per_language + 30) / r["n"])) for r in most}
    few = rows.where(F.col("_u") < _by_language(cut, 0)).groupBy("lang", "_u").agg(F.min("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(presence(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("_u"), pa.array(bits, pa.binary())], names=["lang", "_u", "bits"])

    few = stored(few.mapInArrow(tidy(sets), "lang string, _u long, bits binary"), "langid")
    each = max(1, min(landmarks, MAX_LANDMARKS // len(most)))
    hashes = F.array_sort(F.collect_list("_u"))  # some 2 * per_language numbers
    last = lambda n: F.coalesce(F.get(hashes, F.lit(n - 1)), F.lit(2**40))
    ends = few.groupBy("lang").agg(last(per_language).alias("row"), last(each).alias("mark")).collect()
    row, mark = (_by_language({r["lang"]: r[c] for r in ends}, -1) for c in ("row", "mark"))
    return few.where(F.col("_u") <= row).select("lang", "bits", (F.col("_u") <= mark).alias("mark"), "_u")


def _packed(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), FEATURES // 8)


def _row_batches(products: np.ndarray, by_language: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of the sums, a few at a time."""
    both = np.hstack([products, by_language])
    width = both.shape[1]
    for at in range(0, len(rows), 256):
        part = both[at : at + 256]
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width, dtype=np.int32)), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + 256], pa.int32()), values], names=["row", "values"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> KernelModel:
    """``labelled``: doc_id, text, lang; rows without text or language are left out, equal rows count once.

    Executors map the sample by the landmarks and sum the normal equations; the driver holds the landmarks' packed sets, the sums (a
    row for each landmark) and the final matrix."""
    rows = sample(labelled, per_language, landmarks)
    if rows is None:
        return KernelModel.none()
    spark = labelled.sparkSession
    found = rows.where("mark").select("lang", "_u", "bits").collect()
    found.sort(key=lambda r: (r["lang"], r["_u"]))
    marks = Landmarks(_packed([bytes(r["bits"]) for r in found]))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    place = {v: k for k, v in enumerate(languages)}
    share = 1 / np.array([counts[v] for v in languages])
    known = spark.sparkContext.broadcast((marks, place, share))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, place, share = known.value
        sums = None
        for b in batches:
            names, bits = b.column("lang").to_pylist(), b.column("bits").to_pylist()
            for at in range(0, len(names), 256):
                sums = sums or Sums(marks, share)
                sums.add(_packed(bits[at : at + 256]), np.array([place[v] for v in names[at : at + 256]]))
        if sums:
            yield from _row_batches(sums.products, sums.by_language, np.arange(len(sums.products)))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            values = b.column("values")
            for row, v in zip(b.column("row").to_pylist(), values, strict=True):
                v = v.values.to_numpy()
                sums[row] = sums[row] + v if row in sums else v.copy()
        if sums:
            both = np.stack([sums[k] for k in sorted(sums)])
            n = len(known.value[0].root[0]) + 1
            yield from _row_batches(both[:, :n], both[:, n:], np.array(sorted(sums)))

    kind = "row int, values array<double>"
    got = rows.select("lang", "bits").mapInArrow(tidy(partial), kind).repartition("row").mapInArrow(tidy(total), kind).collect()
    both = np.array([r["values"] for r in sorted(got, key=lambda r: r["row"])])
    n = marks.root.shape[1] + 1
    return KernelModel.solved(languages, marks, both[:, :n], both[:, n:])


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE
) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; learnt from the rows that are not held out."""
    box = Boxed(docs)
    named = box.df.select(box.col(id_col).alias("doc_id"), box.col(text_col).cast("string").alias("text"), box.col(lang_col).cast("string").alias("lang"))
    model = train(named.where(~held_out(F.col("doc_id"))), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    inputs = named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = inputs.schema["doc_id"].dataType.simpleString()
    return inputs.mapInArrow(tidy(score), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
