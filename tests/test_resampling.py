"""Resampling keeps the tones that the new rate can hold, and no others."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest

from phonolake.functions import audio


def tone(hertz, rate, seconds=1.0):
    return np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


def level(x):
    return 20 * np.log10(np.sqrt((x[len(x) // 8 : -len(x) // 8] ** 2).mean()) + 1e-12)


@pytest.mark.parametrize("own", [48000, 44100, 22050])
def test_high_tones_are_gone_and_low_ones_stay(own):
    kept = audio.resample(tone(3000, own), own, 16000)
    assert len(kept) == 16000 and level(kept) == pytest.approx(level(tone(3000, 16000)), abs=0.05)
    middle = slice(2000, 14000)
    assert np.abs(kept[middle] - tone(3000, 16000)[middle]).max() < 2e-3
    if own > 22050:
        for hertz in (9000, 12000, 15500):
            assert level(audio.resample(tone(hertz, own), own, 16000)) < level(tone(3000, 16000)) - 60


def test_upsampling_and_blocks(monkeypatch):
    up = audio.resample(tone(1000, 8000), 8000, 16000)
    assert np.abs(up[1000:15000] - tone(1000, 16000)[1000:15000]).max() < 2e-3
    whole = audio.resample(tone(500, 44100), 44100, 16000)
    monkeypatch.setattr(audio, "_BLOCK", 777)
    assert np.allclose(audio.resample(tone(500, 44100), 44100, 16000), whole)
    assert len(audio.resample(np.zeros(1), 48000, 16000)) == 0


def test_24_bits():
    x = np.array([0, 1, -1, 8388607, -8388608, 4096])
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(3)
        f.setframerate(16000)
        f.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in x))
    assert np.allclose(audio.decode(raw.getvalue()), x / 8388608)
