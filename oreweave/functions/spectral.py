"""Spectral measures of whole signals in numpy: chroma, bandwidth, stereo image, coherence."""

from __future__ import annotations

import numpy as np


def frames(signal: np.ndarray, size: int, step: int) -> np.ndarray:
    """Hann-windowed frames; a signal shorter than one frame is padded with zeros."""
    if len(signal) < size:
        signal = np.pad(signal, (0, size - len(signal)))
    view = np.lib.stride_tricks.sliding_window_view(signal, size)[::step]
    return view * np.hanning(size)


def chroma(signal: np.ndarray, rate: int, size: int = 4096, step: int = 1024, low: float = 55.0, high: float = 5000.0) -> np.ndarray:
    """Twelve sums of logarithmic magnitudes by pitch class, C first, scaled to a largest value of 1."""
    magnitude = np.abs(np.fft.rfft(frames(np.asarray(signal, dtype=float), size, step), axis=1))
    peak = magnitude.max()
    if peak <= 0:
        return np.zeros(12)
    level = np.log1p(100 * magnitude / peak).mean(0)
    frequency = np.fft.rfftfreq(size, 1 / rate)
    inside = (frequency >= low) & (frequency <= high)
    pitch = np.round(69 + 12 * np.log2(frequency[inside] / 440.0)).astype(int) % 12
    out = np.bincount(pitch, weights=level[inside], minlength=12)
    return out / out.max() if out.max() > 0 else out


def bandwidth(signal: np.ndarray, rate: int, size: int = 8192, share: float = 0.99) -> dict[str, float]:
    """The frequency below which `share` of the power lies, and the steepest drop between neighbouring bands, in dB."""
    power = (np.abs(np.fft.rfft(frames(np.asarray(signal, dtype=float), size, size // 2), axis=1)) ** 2).mean(0)
    frequency = np.fft.rfftfreq(size, 1 / rate)
    total = power.sum()
    if total <= 0:
        return {"rolloff": 0.0, "wall_at": 0.0, "wall_db": 0.0}
    rolloff = float(frequency[np.searchsorted(np.cumsum(power), share * total)])
    bands = 10 * np.log10(np.array([np.median(b) for b in np.array_split(power, 64)]) + 1e-12 * power.max())
    drops = bands[:-1] - bands[1:]
    at = int(np.argmax(drops))
    return {"rolloff": rolloff, "wall_at": float(frequency[min(len(frequency) - 1, (at + 1) * len(frequency) // 64)]), "wall_db": float(drops[at])}


def coherence(signal: np.ndarray) -> dict[str, float]:
    """Lag-1 autocorrelation, peak and root mean square."""
    x = np.asarray(signal, dtype=float)
    if not len(x):
        return {"lag1": 0.0, "peak": 0.0, "rms": 0.0}
    d = x - x.mean()
    square = float(d @ d)
    return {"lag1": float(d[1:] @ d[:-1]) / square if square > 0 else 0.0, "peak": float(np.abs(x).max()), "rms": float(np.sqrt(x @ x / len(x)))}


def stereo(left: np.ndarray, right: np.ndarray) -> str:
    """dual-mono, near-mono (correlation of 0.9995 and a side 60 dB down) or stereo."""
    if np.array_equal(left, right):
        return "dual-mono"
    side, mid = float(((left - right) ** 2).sum()), float(((left + right) ** 2).sum())
    r = float(np.corrcoef(left, right)[0, 1]) if left.std() > 0 and right.std() > 0 else 0.0
    return "near-mono" if r >= 0.9995 and mid > 0 and 10 * np.log10(max(side, 1e-300) / mid) <= -60 else "stereo"


#: Spans of the running medians, in frames and in bins.
SPAN = 17
#: Bandwidth: size of the transform, width of the bands that are compared, candidates, their range of the Nyquist frequency, and the drop that is a wall.
BANDS, RATIO, GRID, RANGE, WALL = 8192, 1.12, 240, (0.08, 0.97), 40.0


def running_median(x: np.ndarray, span: int, axis: int) -> np.ndarray:
    """Medians of odd spans along an axis, edges repeated; short axes get shorter spans."""
    span = min(span, x.shape[axis] - 1 + x.shape[axis] % 2)
    if span < 3:
        return x
    pad = [(0, 0)] * x.ndim
    pad[axis] = (span // 2, span // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), span, axis=axis), axis=-1)


def harmonic(magnitude: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Magnitudes (frames, bins) less what is percussive: steady in time weighs against spread in frequency, squared."""
    steady, spread = running_median(magnitude, span, 0) ** 2, running_median(magnitude, span, 1) ** 2
    total = steady + spread
    return magnitude * np.divide(steady, total, out=np.zeros_like(total), where=total > 0)


def harmonic_chroma(signal: np.ndarray, rate: int, size: int = 4096, step: int = 1024, low: float = 55.0, high: float = 5000.0) -> np.ndarray:
    """Twelve compressed sums by pitch class, C first, of the harmonic part, loud frames counting more; zeros if it is too short."""
    x = np.asarray(signal, dtype=float)
    frequency = np.fft.rfftfreq(size, 1 / rate)
    inside = (frequency >= low) & (frequency <= min(high, rate / 2))
    if len(x) < size or not inside.any():
        return np.zeros(12)
    # A few MB of frames at a time would change the medians at their borders; a song's frames are all held.
    level = harmonic(np.abs(np.fft.rfft(frames(x, size, step), axis=1))[:, inside])
    pitch = np.round(69 + 12 * np.log2(frequency[inside] / 440.0)).astype(int) % 12
    out = np.bincount(pitch, weights=(level * level.sum(1, keepdims=True)).sum(0), minlength=12)
    return np.log1p(100 * out / out.max()) if out.max() > 0 else out


def band_verdict(signal: np.ndarray, rate: int) -> dict | None:
    """Where the content ends and the steepest drop of the mean spectrum; `brick-wall` from WALL dB up. None if too short or silent.

    A drop is that between the medians just below and just above a frequency, so a slope counts for a sixth of an octave.
    """
    x = np.asarray(signal, dtype=float)
    if len(x) < 2 * BANDS:
        return None
    power, n = np.zeros(BANDS // 2 + 1), 0
    for at in range(0, len(x) - BANDS + 1, BANDS // 2):
        part = x[at : at + BANDS]
        if part.any():
            power += np.abs(np.fft.rfft(part * np.hanning(BANDS))) ** 2
            n += 1
    if not n:
        return None
    power, frequency, top = power / n, np.fft.rfftfreq(BANDS, 1 / rate), rate / 2
    level = 10 * np.log10(power + 1e-30)
    rolloff = float(frequency[min(int(np.searchsorted(np.cumsum(power), 0.99 * power.sum())), len(frequency) - 1)])
    best, where = 0.0, 0.0
    for at in np.geomspace(RANGE[0] * top, RANGE[1] * top, GRID):
        low, middle, high = np.searchsorted(frequency, (at / RATIO, at, min(at * RATIO, top)), side="right")
        if middle - low >= 3 and high - middle >= 3:
            drop = float(np.median(level[low:middle]) - np.median(level[middle:high]))
            best, where = (drop, float(at)) if drop > best else (best, where)
    return {"verdict": "brick-wall" if best >= WALL else "no-wall", "rolloff": round(rolloff, 1), "wall_db": round(best, 1), "wall_at": round(where, 1) if best >= WALL else None}


def tempo(signal: np.ndarray, rate: int, low: float = 60.0, high: float = 200.0) -> float:
    """Beats a minute by the autocorrelation of the onsets' strength; 0 without onsets that come back."""
    x = np.asarray(signal, dtype=float)
    step = max(1, rate // 100)
    if len(x) < 4 * rate // 2:
        return 0.0
    energy = np.sqrt(np.add.reduceat(x * x, np.arange(0, len(x) - step + 1, step)) / step)
    onset = np.maximum(np.diff(energy), 0)
    onset = onset - onset.mean()
    if not onset.any():
        return 0.0
    spectrum = np.fft.rfft(onset, 2 * len(onset))
    r = np.fft.irfft(np.abs(spectrum) ** 2)[: len(onset)]
    hz = rate / step
    lags = np.arange(max(1, int(60 * hz / high)), min(len(r) - 1, int(60 * hz / low)) + 1)
    if not len(lags):
        return 0.0
    # A pulse at about two a second is preferred among multiples.
    weight = np.exp(-0.5 * (np.log2(60 * hz / lags / 120) / 1.0) ** 2)
    at = int(lags[np.argmax(r[lags] * weight)])
    # Steady sound has no beat: its steps are small against its level, or do not come back.
    if r[at] < 0.2 * r[0] or onset.max() < 0.05 * energy.max():
        return 0.0
    a, b, c = (r[at - 1], r[at], r[at + 1]) if 0 < at < len(r) - 1 else (0.0, 1.0, 0.0)
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(60 * hz / (at + float(np.clip(shift, -0.5, 0.5))))


BAND_EDGES = np.geomspace(40.0, 16_000.0, 13)
#: The order of the numbers in a vector of features; a change needs a new version.
FEATURES = [
    "duration", "tempo", *(f"{m}_{s}" for m in ("loudness", "crossings", "centroid", "spread", "rolloff", "flatness") for s in ("mean", "std")),
    *(f"chroma{i}" for i in range(12)), *(f"band{i}" for i in range(12)), "peak", "crest", "attack", "onsets", "lag1", "quiet", "width",
]


def features(channels: np.ndarray, rate: int) -> dict[str, float]:
    """FEATURES of a sound (frames, channels); what can't be told is 0."""
    x = np.asarray(channels, dtype=float)
    x = x[:, None] if x.ndim == 1 else x
    mono = x.mean(1) if x.size else np.zeros(0)
    out = dict.fromkeys(FEATURES, 0.0)
    if not len(mono) or not rate:
        return out
    part = frames(mono, 2048, 1024)
    power = np.abs(np.fft.rfft(part, axis=1)) ** 2
    frequency, total = np.fft.rfftfreq(2048, 1 / rate), power.sum(1)
    share = np.divide(power, total[:, None], out=np.zeros_like(power), where=total[:, None] > 0)
    centroid = share @ frequency
    spread = np.sqrt(np.maximum(share @ frequency**2 - centroid**2, 0))
    rolloff = frequency[np.minimum((np.cumsum(share, 1) < 0.85).sum(1), len(frequency) - 1)]
    flat = np.where(total > 0, np.exp(np.log(power + 1e-20).mean(1)) / (power.mean(1) + 1e-20), 0.0)
    loud = np.sqrt((part**2).mean(1))
    crossings = (np.diff(np.signbit(part), axis=1)).mean(1)
    for name, v in (("loudness", loud), ("crossings", crossings), ("centroid", centroid), ("spread", spread), ("rolloff", rolloff), ("flatness", flat)):
        out[f"{name}_mean"], out[f"{name}_std"] = float(v.mean()), float(v.std())
    out |= {f"chroma{i}": float(v) for i, v in enumerate(chroma(mono, rate))}
    for i, (a, b) in enumerate(zip(BAND_EDGES, BAND_EDGES[1:], strict=False)):
        inside = (frequency >= a) & (frequency < b)
        out[f"band{i}"] = float(np.log1p(power[:, inside].sum(1)).mean()) if inside.any() else 0.0
    peak, rms = float(np.abs(mono).max()), float(np.sqrt((mono**2).mean()))
    rise = np.maximum(np.diff(loud), 0)
    out |= {"duration": len(mono) / rate, "tempo": tempo(mono, rate), "peak": peak, "crest": peak / rms if rms else 0.0, "attack": float(np.argmax(np.abs(mono))) / rate, "onsets": float((rise > 0.1 * max(peak, 1e-9)).sum()) * rate / len(mono)}
    out |= {"lag1": coherence(mono)["lag1"], "quiet": float((loud < 0.1 * loud.max()).mean()) if loud.max() > 0 else 1.0}
    if x.shape[1] > 1:
        side, mid = ((x[:, 0] - x[:, 1]) ** 2).sum(), ((x[:, 0] + x[:, 1]) ** 2).sum()
        out["width"] = float(side / (side + mid)) if side + mid > 0 else 0.0
    return {k: v if np.isfinite(v) else 0.0 for k, v in out.items()}


def vector(found: dict[str, float]) -> np.ndarray:
    """FEATURES in their order as 32-bit floats; what is missing or no number is 0."""
    v = np.array([found.get(k, 0.0) or 0.0 for k in FEATURES], dtype=np.float32)
    return np.where(np.isfinite(v), v, np.float32(0))
