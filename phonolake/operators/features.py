"""Feature distances of phones.

The features below are articulatory features of the published IPA chart for the 39 phones.  They are an approximation:
weights and features of other tools differ, and so do their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import align_batch

_PLACES = {"labial": "p b f v m w", "coronal": "t d θ ð s z ʃ ʒ n l ɹ t͡ʃ d͡ʒ", "dorsal": "k ɡ ŋ j w", "glottal": "h"}
_SETS = {
    **_PLACES,
    "voiced": "b d ɡ d͡ʒ v ð z ʒ m n ŋ l ɹ w j i ɪ eɪ ɛ æ ɑ ɔ oʊ ʊ u ʌ ə˞ aɪ aʊ ɔɪ",
    "nasal": "m n ŋ",
    "continuant": "f v θ ð s z ʃ ʒ h l ɹ w j i ɪ eɪ ɛ æ ɑ ɔ oʊ ʊ u ʌ ə˞ aɪ aʊ ɔɪ",
    "strident": "s z ʃ ʒ t͡ʃ d͡ʒ f v",
    "sonorant": "m n ŋ l ɹ w j i ɪ eɪ ɛ æ ɑ ɔ oʊ ʊ u ʌ ə˞ aɪ aʊ ɔɪ",
    "syllabic": "i ɪ eɪ ɛ æ ɑ ɔ oʊ ʊ u ʌ ə˞ aɪ aʊ ɔɪ",
    "anterior": "p b t d f v θ ð s z m n l",
    "affricate": "t͡ʃ d͡ʒ",
    "lateral": "l",
    "rhotic": "ɹ ə˞",
    "high": "i ɪ u ʊ w j k ɡ ŋ ʃ ʒ t͡ʃ d͡ʒ",
    "low": "æ ɑ aɪ aʊ",
    "back": "u ʊ oʊ ɔ ɑ ʌ w k ɡ ŋ ɔɪ",
    "round": "u ʊ oʊ ɔ w ɔɪ",
    "tense": "i eɪ u oʊ ɔɪ aɪ aʊ",
    "diphthong": "eɪ oʊ aɪ aʊ ɔɪ",
}
FEATURES = tuple(_SETS)
VECTORS = {p: tuple(p in v.split() for v in _SETS.values()) for p in {x for v in _SETS.values() for x in v.split()}}


def hamming(a: str, b: str) -> float:
    """Share of differing features; an unknown phone differs in all from any other."""
    if a == b:
        return 0.0
    x, y = VECTORS.get(a), VECTORS.get(b)
    return 1.0 if x is None or y is None else sum(p != q for p, q in zip(x, y, strict=True)) / len(FEATURES)


#: The distances of all phones and, behind them, of an unknown one.
_PHONES = {p: i for i, p in enumerate(VECTORS)}
#: Symbols of a batch for whose pairs a table of distances is made.
_MOST = 2000
_COST = np.array([[hamming(a, b) for b in [*VECTORS, "?"]] for a in [*VECTORS, "!"]])


def feature_distance(a: Sequence[str], b: Sequence[str], gap: float = 1.0) -> float:
    """Least cost of turning one sequence into the other; a row of the table is one step of numpy."""
    y = np.array([_PHONES.get(p, len(_PHONES)) for p in b], np.int64)
    known = {p: _COST[_PHONES.get(p, len(_PHONES))][y] if p in _PHONES else np.array([hamming(p, q) for q in b]) for p in set(a)}
    reach = gap * np.arange(len(b) + 1)
    row = reach
    for x in a:
        t = row + gap
        t[1:] = np.minimum(t[1:], row[:-1] + known[x])
        row = np.minimum.accumulate(t - reach) + reach
    return round(float(row[-1]), 9)


def feature_rates(distance: str, n_phones: str) -> list[Column]:
    """Aggregates over utterances: FED, the sum of their feature edit distances, FER, that sum in percent of the phones, and
    PFER, the mean distance of an utterance; zero without phones or rows."""
    total = F.coalesce(F.sum(distance), F.lit(0.0))
    fer = F.coalesce(F.try_divide(100.0 * total, F.sum(n_phones)), F.lit(0.0))
    return [total.alias("FED"), fer.alias("FER"), F.coalesce(F.avg(distance), F.lit(0.0)).alias("PFER")]


def _feature_edit_distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``feature_distance`` of many rows at once."""
    for piece in align_batch.pieces(batches):
        names, columns = align_batch.numbered(*piece)
        few, which = align_batch.distinct(*columns)
        known = np.array([_PHONES.get(p, len(_PHONES)) for p in names])
        if len(names) <= _MOST:
            cost = np.where(np.eye(len(names), dtype=bool), 0.0, _COST[known[:, None], known])
            yield pa.array(np.round(align_batch.weighted_distances(*few, cost, 1.0), 9)[which])
        else:
            found = [feature_distance(names[few[0].row(k)], names[few[1].row(k)]) for k in range(len(few[0]))]
            yield pa.array(np.array(found)[which])


_feature_edit_distance.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
feature_edit_distance = F.arrow_udf(_feature_edit_distance, T.DoubleType())
