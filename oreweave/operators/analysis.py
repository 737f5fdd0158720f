"""Sounds of files heard: vectors of features, key and tempo, verdicts on bandwidth, readings of bare bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.functions import codecs, music, spectral
from oreweave.operators import bytestrings as bs
from oreweave.operators import regions, signals
from oreweave.sources import extract

HEARD = "path string, rate int, channels int, duration double, tempo double, vec array<float>, chroma array<double>, verdict string, rolloff double, wall_db double, note string"


def sound_of(data: bytes, kind: str | None) -> extract.Sample | None:
    """The first sample of a file that has any frames."""
    return next((s for s in extract.samples(data, kind) if len(s.pcm) and s.rate), None)


def heard(files: DataFrame) -> DataFrame:
    """HEARD rows of the files (path, format, content) that have a sound."""
    names = [x.split(" ")[0] for x in HEARD.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.string(), pa.float64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = sound_of(data.as_py() or b"", kind.as_py())
                if s is None:
                    continue
                x = (s.pcm[: len(s.pcm) // s.channels * s.channels].reshape(-1, s.channels)) / float(1 << s.bits - 1)
                found, bands = spectral.features(x, s.rate), spectral.band_verdict(x.mean(1), s.rate) or {}
                row = (path.as_py(), s.rate, s.channels, found["duration"], found["tempo"], spectral.vector(found), spectral.harmonic_chroma(x.mean(1), s.rate), bands.get("verdict"), bands.get("rolloff"), bands.get("wall_db"), s.note)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return files.select("path", "format", "content").mapInArrow(run, HEARD)


def analyzed(files: DataFrame, least_margin: float = 0.15) -> DataFrame:
    """heard with key and tempo, as far as the sound and the file's name tell them.

    A key of the sound counts from a margin of `least_margin` over any other root; one in the name wins over it.
    """
    rows = heard(files).withColumn("found", signals.detailed_key(F.col("chroma")))
    by_ear = F.when(F.col("found.margin") >= least_margin, F.col("found.key"))
    name = F.element_at(F.split("path", "/"), -1)
    tempo = F.when(F.col("tempo") > 0, F.col("tempo"))
    return rows.select(
        "path", "rate", "channels", "duration", "verdict", "rolloff", "wall_db", "vec", "note", by_ear.alias("heard_key"), F.col("found.margin").alias("key_margin"), F.col("found.relative").alias("key_relative"),
        music.fused_key(by_ear, music.key_from_path(F.col("path"))).alias("key"), tempo.alias("heard_bpm"), music.improved_bpm(tempo, music.bpm_from_name(name)).alias("bpm"),
    )


#: How bare bytes may be read as samples.
READINGS = {
    "u8": lambda d: codecs.pcm(d, 8), "s8": lambda d: np.frombuffer(d, np.int8) / 128.0, "s16le": lambda d: codecs.pcm(d, 16), "s16be": lambda d: codecs.pcm(d, 16, big=True),
    "s24le": lambda d: codecs.pcm(d, 24), "s24be": lambda d: codecs.pcm(d, 24, big=True), "f32le": lambda d: codecs.pcm(d, 32, floating=True), "f32be": lambda d: codecs.pcm(d, 32, big=True, floating=True),
}


def smoothness(data: bytes) -> dict[str, float]:
    """Lag-1 correlation of the bytes under each reading; 0 for readings that give no finite numbers."""
    out = {}
    for name, read in READINGS.items():
        with np.errstate(all="ignore"):
            x = read(data)
            good = len(x) > 8 and bool(np.isfinite(x).all()) and float(np.abs(x).max()) < 1e6
            out[name] = round(spectral.coherence(x)["lag1"], 6) if good else 0.0
    return out


def readings(files: DataFrame) -> DataFrame:
    """file, place, reading, lag1: all readings of each file, the smoothest first; of equals the first of READINGS."""

    def found(data: np.ndarray) -> dict:
        scores = smoothness(data.tobytes()) if len(data) else {}
        order = sorted(scores, key=lambda k: -scores[k])
        return {"place": list(range(len(order))), "reading": order, "lag1": [scores[k] for k in order]}

    return bs.per_file(files, "place int, reading string, lag1 double", found)


#: Reversible transforms that hide samples: all keys of an exclusive or, all rotations, swapped halves.
TRANSFORMS = {**{f"xor{k}": bs.table_of(key=k) for k in range(1, 256)}, **{f"rotate{r}": bs.table_of(rotate=r) for r in range(1, 8)}, "swap": bs.table_of(swap=True)}
PLAIN_MOST, HIDDEN_LEAST, HOLD, BRIDGE, LEAST = 0.25, 0.40, 0.60, 5, 6
ENTROPY = (2.0, 7.7)


def hidden(data: bytes, size: int = regions.WINDOW, step: int = regions.WINDOW) -> list[tuple[int, int, str, float]]:
    """(offset, end, transform, share) of stretches that look like samples under one transform and not as they are.

    Windows that score low as they are, and whose entropy is neither low nor full, are scored under all transforms; runs of
    hits become a stretch if the transform of the least mean roughness over it holds on HOLD of its windows.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(0, (len(raw) - size) // step + 1)
    names, tables = list(TRANSFORMS), np.stack([np.frombuffer(t, dtype=np.uint8) for t in TRANSFORMS.values()])
    hit = np.zeros(n, dtype=bool)
    part = lambda i: raw[i * step : i * step + size]
    for i in range(n):
        bits = bs.entropy_of(part(i))
        if ENTROPY[0] <= bits <= ENTROPY[1] and bs.score_of(part(i)[None, :])[0] < PLAIN_MOST:
            hit[i] = bs.score_of(tables[:, part(i)]).max() >= HIDDEN_LEAST
    at = np.flatnonzero(hit)
    out = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > BRIDGE + 1) + 1) if len(at) else []:
        if len(run) < LEAST:
            continue
        whole = raw[run[0] * step : run[-1] * step + size]
        rough = [np.abs(np.diff(t[whole].astype(np.int16))).mean() for t in tables]
        best = int(np.argmin(rough))
        share = float(np.mean([bs.score_of(tables[best][part(i)][None, :])[0] >= HIDDEN_LEAST for i in run]))
        if share >= HOLD:
            out.append((int(run[0]) * step, int(run[-1]) * step + size, names[best], round(share, 3)))
    return out


def transformed_regions(files: DataFrame) -> DataFrame:
    """file, offset, end, transform, share of hidden samples in files."""

    def found(data: np.ndarray) -> dict:
        rows = hidden(data.tobytes())
        return {c: [r[i] for r in rows] for i, c in enumerate(("offset", "end", "transform", "share"))}

    return bs.per_file(files, "offset long, end long, transform string, share double", found)


#: A disc's frame in samples; how far a hole's length and start may be off; how much sharper both neighbours must be, in dB.
FRAME, LENGTH_OFF, START_OFF, CONTRAST = 588, 0.35, 2, 12.0
STRATEGIES = ("mute", "hold", "interp", "repeat")


def _sharpness(x: np.ndarray) -> float:
    """Mean power of the second differences, in dB."""
    return 10 * float(np.log10((np.diff(x, 2) ** 2).mean() + 1e-12)) if len(x) > 2 else -120.0


def concealment(samples: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, strategy) of holes of about one frame, on the grid of frames, that a reader has filled in.

    mute: zeros; hold: one value; interp: a straight line; repeat: the frame before once more, and not again. What stands on
    both sides must be sharper by CONTRAST (of a repeat: sharp at all). Of holes that overlap the more specific one stays.
    """
    x = np.asarray(samples, dtype=float)
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, strategy: str) -> None:
        off = (start + FRAME // 2) % FRAME - FRAME // 2
        if abs(end - start - FRAME) > LENGTH_OFF * FRAME or abs(off) > START_OFF or any(start < b and a < end for a, b, _ in found):
            return
        before, after, inside = x[max(0, start - FRAME) : start], x[end : end + FRAME], x[start:end]
        if min(len(before), len(after)) < FRAME // 4:
            return
        floor = -60.0 if strategy == "repeat" else _sharpness(inside) + CONTRAST
        if min(_sharpness(before), _sharpness(after)) >= floor:
            found.append((start, end, strategy))

    step, bend = np.diff(x), np.diff(x, 2)
    masks = {"mute": x == 0, "hold": np.append(step == 0, False) | np.insert(step == 0, 0, False), "interp": np.pad(np.abs(bend) < 1e-9, 1)}
    for strategy, mask in masks.items():
        for first, last in zip(*bs.runs(np.flatnonzero(mask)), strict=True):
            more = 1 if strategy == "interp" else 0
            add(int(first) - more + (1 if strategy == "interp" and first > 1 else 0), int(last) + 1, strategy)
    same = x[FRAME:] == x[:-FRAME] if len(x) > FRAME else np.empty(0, bool)
    for first, last in zip(*bs.runs(np.flatnonzero(same)), strict=True):
        start, end = int(first) + FRAME, int(last) + 1 + FRAME
        if np.ptp(x[start:end]) > 0:
            add(start, end, "repeat")
    return sorted(found)


def concealed_holes(files: DataFrame) -> DataFrame:
    """path, channel, start, end, strategy of the filled holes in the sounds of files (path, format, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "channel", "start", "end", "strategy"], (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = sound_of(data.as_py() or b"", kind.as_py())
                if s is not None:
                    x = s.pcm[: len(s.pcm) // s.channels * s.channels].reshape(-1, s.channels)
                    rows += [(path.as_py(), c, *hole) for c in range(s.channels) for hole in concealment(x[:, c])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "format", "content").mapInArrow(run, "path string, channel int, start long, end long, strategy string")
