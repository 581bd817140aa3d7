"""Vectorised reading of words: boundaries, hashes and remembered facts of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shared import Growing

_RATES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xDA942042E4DD58B5))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes read at once, and the longest word that is remembered.  Beyond that length a word is looked at by itself, as the
#: sums that serve as hashes are sound for short strings only.
BATCH_BYTES = 1 << 20
MAX_WORD = 256
#: Bytes whose sums are held at once, however long a text is.
_BLOCK = 1 << 17


def _inverse_powers(n: int, rate: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = rate
        for _ in range(6):  # Newton's iteration for the inverse of an odd number
            inverse = inverse * (np.uint64(2) - rate * inverse)
        up = np.cumprod(np.full(n, rate))
        down = np.cumprod(np.full(n, inverse))
    return up, down


class WordHasher:
    """64-bit hashes of byte ranges: sums of a random number for each byte times the powers of an odd number.  ``which``
    of two independent ones: together they tell words by 128 bits."""

    def __init__(self, fold: np.ndarray | None = None, which: int = 0):
        table = np.random.default_rng(20240607 + which).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table = table if fold is None else table[fold]
        self.up, self.down = _inverse_powers(_BLOCK + MAX_WORD, _RATES[which])

    def hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of ranges of up to ``MAX_WORD`` bytes, in order of their starts."""
        out = np.empty(len(start), np.uint64)
        edges = np.searchsorted(start, np.arange(0, len(raw) + _BLOCK, _BLOCK)).tolist()
        sums = np.zeros(_BLOCK + MAX_WORD + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a == b:
                    continue
                base = k * _BLOCK
                part = raw[base : base + _BLOCK + MAX_WORD]
                np.cumsum(self.table[part] * self.up[: len(part)], out=sums[1 : len(part) + 1])
                here = start[a:b] - base
                h = (sums[end[a:b] - base] - sums[here]) * self.down[here]
                h ^= (end[a:b] - start[a:b]).astype(np.uint64) << np.uint64(56)
                h ^= h >> np.uint64(32)
                h *= _MIX
                h ^= h >> np.uint64(29)
                out[a:b] = h
        return np.maximum(out, np.uint64(1))  # 0 marks an empty place


class HashIndex:
    """Numbers 0, 1, 2, ... of 64-bit keys, by open addressing; all operations take arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            seen, want = self.keys[at], keys[open_]
            hit = seen == want
            out[open_[hit]] = self.values[at[hit]]
            left = ~hit & (seen != 0)
            open_, at = open_[left], at[left]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Keys that are new and distinct; they get the next numbers in order."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            known, values = self.keys[old], self.values[old]
            while 2 * (self.size + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(known, values)
        self._place(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def skip(self) -> int:
        """The next number, which then belongs to no key."""
        self.size += 1
        return self.size - 1

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            ok = free & first
            self.keys[at[ok]], self.values[at[ok]] = keys[ok], values[ok]
            keys, values, at = keys[~ok], values[~ok], at[~ok]
            at = (at + 1) & mask  # all that is left met a place that is taken by now


class Remembered:
    """Numbers for words by 128 bits of hash, with the words themselves shown once to whoever learns facts about them.

    The index goes by the first 64 bits; a word whose other 64 bits are not those of the word that it meets there is kept
    by its bytes."""

    def __init__(self, fold: np.ndarray | None = None, most: int = 1_500_000):
        self.hasher, self.checker, self.most = WordHasher(fold), WordHasher(fold, 1), most
        self.reset()

    def reset(self) -> None:
        self.index, self.checks, self.clashing = HashIndex(), Growing("u8"), {}

    @property
    def full(self) -> bool:
        return self.index.size > self.most

    def numbers(self, joined: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray, learn: Callable[[list[bytes]], None]) -> np.ndarray:
        """The number of each range; ``learn`` gets the list of new words, in the order of their numbers."""
        keys, checks = self.hasher.hashes(raw, start, end), self.checker.hashes(raw, start, end)
        out = self.index.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            where = new[first]
            learn([joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            self.index.add(distinct)
            self.checks.extend(checks[where])
            out[new] = self.index.find(keys[new])
        for k in np.flatnonzero(self.checks.room[out] != checks).tolist():
            word = joined[start[k] : end[k]]
            if word not in self.clashing:
                learn([word])
                self.clashing[word] = self.index.skip()
                self.checks.extend(checks[k : k + 1])
            out[k] = self.clashing[word]
        return out
