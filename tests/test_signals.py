"""Decoders and spectral measures on signals with a known answer."""

from __future__ import annotations

import numpy as np
import pytest

from oreweave.functions import codecs, spectral

TONE = lambda f, rate=22050, n=22050: np.sin(2 * np.pi * f * np.arange(n) / rate)


def test_linear_samples():
    assert codecs.pcm(b"\x00\x80\xff\x7f\x01").tolist() == [-1, 32767 / 32768]
    assert codecs.pcm(b"\x80\x00", big=True).tolist() == [-1]
    assert codecs.pcm(b"\x00\x80\xff", bits=8).tolist() == [-1, 0, 127 / 128]
    assert codecs.pcm(b"\x00\x00\x80\xff\xff\x7f", bits=24).tolist() == [-1, (2**23 - 1) / 2**23]
    assert codecs.pcm(np.array([0.5, -2], "<f4").tobytes(), bits=32, floating=True).tolist() == [0.5, -2]


def test_companding_is_odd_and_rising():
    mu, a = codecs.mu_law(bytes(range(256))), codecs.a_law(bytes(range(256)))
    assert mu[0] == pytest.approx(-32124 / 32768) and mu[128] == pytest.approx(32124 / 32768) and mu[127] == mu[255] == 0
    assert np.allclose(mu[:128], -mu[128:]) and np.allclose(a[:128], -a[128:])
    assert a[0xD5] == 8 / 32768 and np.abs(a).max() == 32256 / 32768
    assert (np.diff(mu[128:]) < 0).all()


def test_adpcm_follows_a_tone():
    wave = (TONE(200, 8000, 400) * 12000).astype(int)
    value, index, codes = int(wave[0]), 0, []
    for x in wave[1:]:
        step, diff = codecs.IMA_STEPS[index], int(x) - value
        code = (8 if diff < 0 else 0) | min(7, abs(diff) * 4 // step)
        change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - change if code & 8 else value + change))
        index = max(0, min(88, index + codecs.IMA_INDEX[code & 7]))
        codes.append(code)
    codes += [0] * (len(codes) % 2)
    data = int(wave[0]).to_bytes(2, "little", signed=True) + b"\0\0" + bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2], strict=True))
    got = codecs.ima_block(data)[: len(wave)] * 32768
    assert np.corrcoef(got[50:], wave[50:])[0, 1] > 0.99
    assert codecs.ima_block(b"abc").size == 0


def test_fibonacci_delta():
    assert (codecs.fibonacci_delta(b"\0\x05\x9f") * 128).tolist() == [6, 27]
    assert (codecs.fibonacci_delta(b"\0\x7f\x9f") * 128).tolist() == [-128, -107]


def test_checksums():
    assert codecs.crc8(b"123456789") == 0xF4 and codecs.crc16(b"123456789") == 0xFEE8


def test_chroma_and_bandwidth():
    assert spectral.chroma(TONE(440.0), 22050).argmax() == 9
    assert spectral.chroma(np.zeros(10), 22050).tolist() == [0] * 12
    noise = np.random.default_rng(1).normal(size=44100)
    spectrum = np.fft.rfft(noise)
    spectrum[len(spectrum) // 2 :] = 0
    cut = spectral.bandwidth(np.fft.irfft(spectrum), 44100)
    assert cut["rolloff"] == pytest.approx(11000, abs=300) and cut["wall_db"] > 40
    assert spectral.bandwidth(noise, 44100)["wall_db"] < 10


def test_stereo_and_coherence():
    tone, noise = TONE(200), np.random.default_rng(2).normal(size=22050)
    assert spectral.stereo(tone, tone) == "dual-mono"
    assert spectral.stereo(tone, tone + 1e-5 * noise) == "near-mono"
    assert spectral.stereo(tone, noise) == "stereo"
    assert spectral.coherence(tone)["lag1"] > 0.99 and abs(spectral.coherence(noise)["lag1"]) < 0.05
