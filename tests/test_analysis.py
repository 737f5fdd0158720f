"""Features, keys, tempi and verdicts on signals with a known answer."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreweave.functions import spectral
from oreweave.operators import analysis, signals
from oreweave.sources import extract

RATE = 22050
tone = lambda f, n=RATE * 2, rate=RATE: np.sin(2 * np.pi * f * np.arange(n) / rate)
NOTES = {"C": 261.63, "D": 293.66, "D#": 311.13, "E": 329.63, "G": 392.0, "A": 440.0, "B": 493.88}


def chord(*names):
    return sum(tone(4 * NOTES[n]) for n in names) / len(names)


def clicks(bpm, seconds=12, rate=RATE):
    x = np.zeros(seconds * rate)
    r = np.random.default_rng(1)
    for at in np.arange(0, seconds, 60 / bpm):
        i = int(at * rate)
        x[i : i + 800] += (r.normal(size=800) * np.exp(-np.arange(800) / 150))[: len(x) - i]
    return x / np.abs(x).max()


def test_percussion_is_taken_out():
    x = 0.3 * tone(440.0)
    hit = x + clicks(240, 2)
    steady, beaten = spectral.harmonic_chroma(x, RATE), spectral.harmonic_chroma(hit, RATE)
    assert steady.argmax() == beaten.argmax() == 9
    plain = spectral.chroma(hit, RATE)
    rest = lambda c: np.delete(c / c.max(), 9).mean()
    assert rest(beaten) < rest(plain)
    assert not spectral.harmonic_chroma(x[:100], RATE).any() and not spectral.harmonic_chroma(np.zeros(9000), RATE).any()
    m = np.random.default_rng(2).random((30, 40))
    assert np.array_equal(spectral.running_median(m, 5, 0)[10], np.median(m[8:13], axis=0)) and spectral.running_median(m[:2], 17, 0).shape == (2, 40)


def test_keys_of_chords(spark):
    rows = [("C", chord("C", "E", "G")), ("Cm", chord("C", "D#", "G")), ("Am", chord("A", "C", "E")), ("G", chord("G", "B", "D"))]
    df = spark.createDataFrame([(k, spectral.harmonic_chroma(x, RATE).tolist()) for k, x in rows], "key string, chroma array<double>")
    got = df.select("key", signals.detailed_key(F.col("chroma")).alias("k")).collect()
    assert all(r.k.key == r.key and r.k.margin > 0 for r in got)
    few = spark.createDataFrame([([0.0] * 12,), ([1.0] + [0.0] * 11,), ([1.0] * 12,)], "c array<double>")
    assert [r.k for r in few.select(signals.detailed_key(F.col("c")).alias("k")).collect()] == [None, None, None]


def test_detailed_keys_match_plain_correlation(spark):
    r = np.random.default_rng(3)
    rows = np.abs(r.normal(size=(40, 12)))
    got = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "i int, c array<double>").select("i", signals.detailed_key(F.col("c")).alias("k")).orderBy("i").collect()
    names = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    for x, g in zip(rows, got, strict=True):
        scores = [(np.corrcoef(x, np.roll(p, t))[0, 1], t, m) for t in range(12) for m, p in (("", signals.MAJOR), ("m", signals.MINOR))]
        scores.sort(key=lambda s: -s[0])
        best, other = scores[0], next(s for s in scores if s[1] != scores[0][1])
        assert g.k.key == names[best[1]] + best[2] and g.k.margin == pytest.approx(best[0] - other[0], abs=1e-6)
        second = scores[1]
        major, minor = (best, second) if best[2] == "" else (second, best)
        pair = best[2] != second[2] and (minor[1] + 3) % 12 == major[1]
        assert g.k.relative == (names[second[1]] + second[2] if pair else None)


@pytest.mark.parametrize("bpm", [90, 120, 140])
def test_tempi(bpm):
    assert spectral.tempo(clicks(bpm), RATE) == pytest.approx(bpm, rel=0.02)
    assert spectral.tempo(np.zeros(RATE * 4), RATE) == spectral.tempo(np.ones(10), RATE) == 0.0


def test_walls():
    noise = np.random.default_rng(4).normal(size=1 << 17)
    assert spectral.band_verdict(noise, 44100)["verdict"] == "no-wall"
    spectrum = np.fft.rfft(noise)
    spectrum[int(16000 / 22050 * len(spectrum)) :] = 0
    cut = spectral.band_verdict(np.fft.irfft(spectrum), 44100)
    assert cut["verdict"] == "brick-wall" and 15_000 < cut["wall_at"] < 17_000 and cut["rolloff"] < 16_500
    assert spectral.band_verdict(noise[:1000], 44100) is None and spectral.band_verdict(np.zeros(1 << 15), 44100) is None


def test_feature_vectors():
    assert len(spectral.FEATURES) == 45 and len(set(spectral.FEATURES)) == 45
    x = np.column_stack([tone(1000.0), tone(1000.0)])
    f = spectral.features(x, RATE)
    assert f["duration"] == 2.0 and f["centroid_mean"] == pytest.approx(1000, rel=0.02) and f["width"] == 0 and f["peak"] == pytest.approx(1, abs=1e-3) and f["crest"] == pytest.approx(2**0.5, rel=1e-2)
    assert f["crossings_mean"] == pytest.approx(2000 / RATE, rel=0.05)
    assert not any(spectral.features(np.zeros((0, 1)), RATE).values()) and np.isfinite(spectral.vector(spectral.features(np.zeros(50), RATE))).all()
    assert spectral.vector({"duration": float("nan"), "tempo": None}).tolist() == [0.0] * 45


def test_readings_and_hidden_samples():
    t = np.arange(40_000)
    pcm = (9000 * np.sin(t / 12.0) + 2000 * np.sin(t / 3.1)).astype("<i2").tobytes()
    best = max(analysis.smoothness(pcm).items(), key=lambda x: x[1])
    assert best[0] == "s16le" and best[1] > 0.9
    assert max(analysis.smoothness(np.frombuffer(pcm, "<i2").astype(">i2").tobytes()).items(), key=lambda x: x[1])[0] == "s16be"
    eight = (60 * np.sin(t / 20) + 30 * np.sin(t / 7)).astype(np.int8).view(np.uint8)
    secret = eight.tobytes().translate(analysis.TRANSFORMS["swap"])
    found = analysis.hidden(bytes(3000) + secret[:30_000] + bytes(3000))
    assert len(found) == 1 and found[0][2] in ("rotate4", "swap") and found[0][3] >= 0.6 and abs(found[0][0] - 3000) <= 2 * 1024
    assert analysis.hidden(b"plain text here\n" * 2000) == [] == analysis.hidden(b"")


def test_analyzed_files(spark):
    wav = lambda x: bytearray(extract.wave_file((x * 30_000).astype(int), RATE))
    files = [("/s/pad_Am.wav", "wav", wav(chord("C", "E", "G"))), ("/s/chord.wav", "wav", wav(chord("C", "E", "G"))), ("/s/beat_60.wav", "wav", wav(clicks(120, 6))), ("/s/x.txt", None, bytearray(b"no")), ("/s/none.wav", "wav", None)]
    got = {r.path: r for r in analysis.analyzed(spark.createDataFrame(files, "path string, format string, content binary").repartition(2), 0.0).collect()}
    assert set(got) == {"/s/pad_Am.wav", "/s/chord.wav", "/s/beat_60.wav"}
    assert got["/s/pad_Am.wav"].key == "Am" and got["/s/pad_Am.wav"].heard_key == got["/s/chord.wav"].key == "C"
    assert got["/s/beat_60.wav"].heard_bpm == pytest.approx(120, rel=0.03) and got["/s/beat_60.wav"].bpm == pytest.approx(60, rel=0.03)
    assert all(len(r.vec) == 45 for r in got.values())


def test_filled_holes(spark):
    n = analysis.FRAME
    noise = np.random.default_rng(8).normal(size=30 * n) * 3000
    x = np.round(noise)
    x[5 * n : 6 * n] = 0
    x[9 * n : 10 * n] = 700
    x[14 * n : 15 * n] = np.linspace(x[14 * n - 1], x[15 * n], n + 2)[1:-1]
    x[20 * n : 21 * n] = x[19 * n : 20 * n]
    found = analysis.concealment(x)
    assert [(round(a / n), s) for a, _, s in found] == [(5, "mute"), (9, "hold"), (14, "interp"), (20, "repeat")]
    assert all(abs(a - round(a / n) * n) <= 2 and abs(b - a - n) <= 3 for a, b, _ in found)
    # Off the grid, of another length, in quiet sound, or without neighbours there is nothing.
    y = np.round(noise)
    y[5 * n + 100 : 6 * n + 100] = 0
    y[9 * n : 12 * n] = 0
    assert analysis.concealment(y) == [] == analysis.concealment(np.zeros(9000)) == analysis.concealment(np.zeros(0))
    assert analysis.concealment(np.round(200 * np.sin(np.arange(9000) / 900))) == []
    pcm = np.column_stack([x, np.round(noise)]).ravel().astype(int).clip(-32768, 32767)
    files = [("a.wav", "wav", bytearray(extract.wave_file(pcm, 44_100, 2))), ("b", None, bytearray(b"no"))]
    got = analysis.concealed_holes(spark.createDataFrame(files, "path string, format string, content binary")).collect()
    assert {(r.channel, r.strategy) for r in got} >= {(0, "mute"), (0, "hold"), (0, "repeat")} and {r.channel for r in got} == {0}
