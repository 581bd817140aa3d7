"""Decoding of frame-wise scores: the best symbol sequences by prefix beam search.

A row holds an utterance's frames, each an array of log probabilities of all symbols, one of which is the blank.  Many
frame-wise paths spell one sequence, so a beam keeps sequences (prefixes), each with the mass of its paths that end in a
blank and of those that do not; paths that meet in a prefix are summed.  Utterances of an Arrow batch are searched together,
a frame at a time, in groups of bounded size.  Each row is searched by itself, so no shuffle is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NBEST_TYPE = "array<struct<ids: array<int>, score: double>>"
_NBEST = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64())]))
#: Candidates of a frame that are held at once.
_CELLS = 1 << 20
#: Scores that agree in so many decimals are ties; the sequence that sorts first then goes first.
_DIGITS = 9
_RATES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _follow(h: np.ndarray, symbol: np.ndarray, rate: np.uint64) -> np.ndarray:
    """The number of a prefix with one more symbol."""
    h = (h ^ (symbol.astype(np.uint64) + np.uint64(1))) * rate
    return h ^ (h >> np.uint64(31))


class _Beams:
    """The prefixes of n utterances, at most ``width`` each; masses are logarithms.  A prefix is told by two numbers of 64 bits,
    which its parent's numbers and its last symbol give."""

    def __init__(self, n: int, width: int):
        self.blank, self.other = np.full((n, width), -np.inf), np.full((n, width), -np.inf)
        self.blank[:, 0] = 0.0
        self.last = np.full((n, width), -1)
        self.name = [np.zeros((n, width), np.uint64) for _ in _RATES]  # zero where the beam has no prefix
        for name, rate in zip(self.name, _RATES, strict=True):
            name[:, 0] = np.arange(1, n + 1, dtype=np.uint64) * rate
        self.parent = [np.zeros((n, width), np.uint64) for _ in _RATES]
        self.node = np.full((n, width), -1)
        self.made_from, self.made_of, self.size = [], [], 0

    def step(self, scores: np.ndarray, blank: int) -> None:
        """One frame of the first utterances, as many as ``scores`` has rows."""
        n, symbols = scores.shape
        width = self.last.shape[1]
        b, o, last = self.blank[:n], self.other[:n], self.last[:n]
        total = np.logaddexp(b, o)
        own = np.take_along_axis(scores, last.clip(0), 1)
        stay_blank, stay_other = total + scores[:, blank : blank + 1], np.where(last >= 0, o + own, -np.inf)
        more = total[:, :, None] + scores[:, None, :]
        # a symbol after itself is a new one only behind a blank
        np.put_along_axis(more, last.clip(0)[:, :, None], np.where(last >= 0, b + own, np.take_along_axis(more, last.clip(0)[:, :, None], 2)[:, :, 0])[:, :, None], 2)
        more[:, :, blank] = -np.inf
        # a longer prefix that is in the beam already takes what its parent passes on
        names, wanted = self.name[0][:n].ravel(), self.parent[0][:n].ravel()
        order = np.argsort(names)
        at = order[np.searchsorted(names[order], wanted).clip(0, len(order) - 1)]
        same = (names[at] == wanted) & (self.name[1][:n].ravel()[at] == self.parent[1][:n].ravel()) & (last.ravel() >= 0)
        child = np.flatnonzero(same & (total.ravel() > -np.inf) & (total.ravel()[at] > -np.inf))
        flat, key = more.reshape(-1), at[child] * symbols + last.ravel()[child]
        joined = stay_other.reshape(-1)
        joined[child] = np.logaddexp(joined[child], flat[key])
        flat[key] = -np.inf

        every = np.concatenate([np.logaddexp(stay_blank, stay_other), more.reshape(n, -1)], 1)
        few = np.sort(np.argpartition(-every, width - 1, axis=1)[:, :width], axis=1)
        best = np.take_along_axis(few, np.argsort(-np.take_along_axis(every, few, 1), axis=1, kind="stable"), 1)
        stays = best < width
        beam, symbol = np.where(stays, best, (best - width) // symbols), np.where(stays, -1, (best - width) % symbols)
        pick = lambda a: np.take_along_axis(a, beam, 1)
        found = np.take_along_axis(every, best, 1) > -np.inf
        new = ~stays & found
        self.blank[:n] = np.where(stays, pick(stay_blank), -np.inf)
        self.other[:n] = np.where(stays, pick(stay_other), np.take_along_axis(every, best, 1))
        self.last[:n] = np.where(stays, pick(last), symbol)
        for k, rate in enumerate(_RATES):
            old, before = pick(self.name[k][:n]), pick(self.parent[k][:n])
            self.name[k][:n] = np.where(found, np.where(stays, old, _follow(old, symbol, rate)), np.uint64(0))
            self.parent[k][:n] = np.where(stays, before, old)
        node = pick(self.node[:n])
        self.made_from.append(node[new])
        self.made_of.append(symbol[new])
        node[new] = self.size + np.arange(int(new.sum()))
        self.size += int(new.sum())
        self.node[:n] = node

    def found(self, n_best: int, bonus: float) -> list[list[tuple[list[int], float]]]:
        made_from = np.concatenate(self.made_from).tolist() if self.made_from else []
        made_of = np.concatenate(self.made_of).tolist() if self.made_of else []
        total = np.logaddexp(self.blank, self.other)
        if bonus:
            length = np.zeros(len(made_from) + 1)  # the last is the empty prefix
            for node, before in enumerate(made_from):
                length[node] = length[before] + 1
            total = total + bonus * length[self.node]
        least = np.sort(total, axis=1)[:, -n_best][:, None] - 2 * 10.0**-_DIGITS  # with room for ties
        out = []
        for scores, nodes, near in zip(total, self.node, (total >= least) & (total > -np.inf), strict=True):
            own = []
            for score, node in zip(scores[near].tolist(), nodes[near].tolist(), strict=True):
                ids = []
                while node >= 0:
                    ids.append(made_of[node])
                    node = made_from[node]
                own.append((ids[::-1], score))
            out.append(sorted(own, key=lambda x: (-round(x[1], _DIGITS), x[0]))[:n_best])
        return out


def search(frames: list[np.ndarray], width: int, n_best: int, blank: int = 0, bonus: float = 0.0) -> list[list[tuple[list[int], float]]]:
    """Of each utterance (frames x symbols, log probabilities) the best sequences with their scores, best first."""
    out: list[list[tuple[list[int], float]]] = [[] for _ in frames]
    order = sorted(range(len(frames)), key=lambda k: -len(frames[k]))
    at = 0
    while at < len(order):
        symbols = max([frames[k].shape[1] for k in order[at : at + 1]], default=1)
        group = order[at : at + max(1, _CELLS // (width * (symbols + 1)))]
        group = [k for k in group if frames[k].shape[1] == symbols or not len(frames[k])]
        at += len(group)
        beams = _Beams(len(group), width)
        lengths = np.array([len(frames[k]) for k in group])
        for t in range(int(lengths[0])):
            beams.step(np.stack([frames[k][t] for k in group[: int((lengths > t).sum())]]), blank)
        for k, found in zip(group, beams.found(n_best, bonus), strict=True):
            out[k] = found
    return out


def nbest(log_probs: Column, width: int, n_best: int = 1, blank: int = 0, bonus: float = 0.0) -> Column:
    """The ``n_best`` sequences of ids with their log probabilities, best first, from an array of frames, each an array of as
    many log probabilities as there are symbols.  ``width``: prefixes kept after a frame; ``bonus`` is added for each
    symbol.  Null stays null; without frames there is the empty sequence; frames of different sizes are an error."""
    if width < 1 or not 1 <= n_best <= width:
        raise ValueError("the beam holds one prefix at least, and the best are of the beam")

    @F.arrow_udf(NBEST_TYPE)
    def run(batch: pa.Array) -> pa.Array:
        known = [k for k, v in enumerate(batch.is_valid().to_pylist()) if v]
        frames = []
        for k in known:
            own = batch[k].values
            sizes = np.diff(own.offsets.to_numpy()) if len(own) else np.array([], int)
            if len(set(sizes.tolist())) > 1 or own.null_count:
                raise ValueError("the frames of an utterance must have a score for each symbol")
            frames.append(own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 1)))
        out: list = [None] * len(batch)
        seen: dict[tuple, int] = {}  # equal utterances of a batch are searched once
        which = [seen.setdefault((f.shape, f.tobytes()), len(seen)) for f in frames]
        few = [frames[i] for i in np.unique(which, return_index=True)[1].tolist()]
        found = [[{"ids": ids, "score": score} for ids, score in x] for x in search(few, width, n_best, blank, bonus)]
        for k, i in zip(known, which, strict=True):
            out[k] = found[i]
        return pa.array(out, _NBEST)

    return run(log_probs.cast("array<array<double>>"))
