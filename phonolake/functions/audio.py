"""Recordings as binary columns: decoding of PCM wave files, mono mix, resampling and trimming, in Arrow batches."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Zero crossings of the windowed sinc on either side, the shape of its Kaiser window, and output samples made at once.
_ZEROS, _BETA, _BLOCK = 32, 10.0, 1 << 15


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """Samples at ``rate`` of samples at ``own``: a windowed sinc as a polyphase filter.  It passes what both rates can hold, so a
    higher tone is gone and does not come back as a lower one; it is made for each of the phases that two whole rates meet
    in, and the output block by block."""
    common = math.gcd(own, rate)
    up, down = rate // common, own // common
    # the part of the input's tones that stays; its slope ends below the output's highest.  A higher rate holds them all, and a
    # filter of them all leaves the input's own samples as they are
    cut = up / down * (1 - 2.0 / _ZEROS) if up < down else 1.0
    reach = math.ceil(_ZEROS / cut)
    taps = np.arange(-reach, reach + 1)
    n = int(len(x) * rate / own)
    out = np.empty(n)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    for begin in range(0, n, _BLOCK):
        at = np.arange(begin, min(n, begin + _BLOCK), dtype=np.int64) * down
        phases, which = np.unique(at % up, return_inverse=True)
        shift = taps[None, :] - (phases / up)[:, None]
        window = np.i0(_BETA * np.sqrt(np.clip(1 - (shift / (reach + 1)) ** 2, 0, None))) / np.i0(_BETA)
        filters = cut * np.sinc(cut * shift) * window
        filters /= filters.sum(1, keepdims=True)
        seen = np.lib.stride_tricks.sliding_window_view(padded, len(taps))
        out[begin : begin + len(at)] = np.einsum("nk,nk->n", seen[at // up], filters[which])
    return out


def _samples(data: bytes, width: int) -> np.ndarray:
    if width == 3:  # the three bytes are the upper ones of four
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return wide.reshape(-1).view("<i4") / 2147483648.0
    kinds = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    if width not in kinds:
        raise ValueError(f"{8 * width} bit samples are not supported")
    kind, zero, scale = kinds[width]
    return (np.frombuffer(data, kind).astype(np.float64) - zero) / scale


def decode(raw: bytes, rate: int = 16000, seconds: float | None = None) -> np.ndarray:
    """Mono samples in [-1, 1) at ``rate``; at most ``seconds`` of them.  8, 16, 24 and 32 bit PCM."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, own, n = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()
        if seconds is not None:
            n = min(n, int(seconds * own))
        data = f.readframes(n)
    x = _samples(data, width).reshape(-1, channels).mean(1)
    return resample(x, own, rate) if own != rate and len(x) else x


def decoder(rate: int = 16000, seconds: float | None = None) -> Callable[[Column], Column]:
    """A column function from wave bytes to float samples; what cannot be decoded is null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for raw in s:
                try:
                    out.append(None if raw is None else decode(bytes(raw), rate, seconds).astype(np.float32))
                except (wave.Error, EOFError, ValueError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run


def wave_frames(raw: Column) -> Column:
    """Frames of a canonical PCM wave file by its header alone, without decoding: data bytes / block alignment."""
    return F.when(F.octet_length(raw) >= 44, F.floor(_little(raw, 41, 4) / _little(raw, 33, 2)))


def _little(raw: Column, at: int, size: int) -> Column:
    """The little-endian number of ``size`` bytes from place ``at`` (from 1)."""
    parts = [F.conv(F.hex(F.substring(raw, at + i, 1)), 16, 10).cast("long") * (256**i) for i in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out
