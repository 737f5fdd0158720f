"""Where the sound is in a blob of bytes: containers by their magic, chains of frames, windows that look like samples.

Three engines each give regions, and these are joined up: a container ends where it says, or where the sound behind its
header ends, or where the next region begins; what lies mostly in a container or chain is no region of its own; neighbours
of one kind are merged. All engines read a file's bytes as one numpy array; a file is a row, and so is a region.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreweave.functions import frames
from oreweave.operators import bytestrings as bs
from oreweave.operators import islands as isl
from oreweave.sources import walkers

#: What a container starts with, and its format by the id that may follow at byte 8.
MAGICS = (b"RIFF", b"RIFX", b"RF64", b"FORM", b"MThd", b"fLaC", b"OggS", b".snd", b"caff")
FORMS = {b"WAVE": "wav", b"sfbk": "sf2", b"RMID": "rmid", b"AIFF": "aiff", b"AIFC": "aifc", b"8SVX": "8svx"}
CONTAINER, BLOB_MOST, BLOB_LEAST = 0.9, 0.89, 0.4
#: Bytes: from a header to its sound, between parts of one sound, between blobs that are one.
HEADER, GAP, MERGE = 4096, 4096, 32 << 10
WINDOW, STEP, BRIDGE, LEAST_WINDOWS = 1024, 512, 4, 4
HIGH, LOW = 0.45, 0.25


def container_at(data: bytes, at: int) -> tuple[str, int | None] | None:
    """Format and end of the container at a place; no end if its size can't be; None if there is no container."""
    head = data[at : at + 48]
    magic, form = head[:4], head[8:12]
    if magic in (b"RIFF", b"RIFX", b"RF64", b"FORM"):
        kind = FORMS.get(form)
        if kind is None or (magic == b"FORM") != (kind in ("aiff", "aifc", "8svx")):
            return None
        size = struct.unpack(">I" if magic in (b"RIFX", b"FORM") else "<I", head[4:8])[0]
        if magic == b"RF64" and head[12:16] == b"ds64" and len(head) >= 28:
            kind, size = "rf64", struct.unpack("<Q", head[20:28])[0]
        end = at + 8 + size
        return kind, end if size >= 4 and end <= len(data) else None
    if magic == b"MThd" and head[4:8] == b"\0\0\0\6" and len(head) >= 14 and head[8] == 0 and head[9] < 3:
        to = at + 14
        for _ in range(int.from_bytes(head[10:12], "big")):
            if data[to : to + 4] != b"MTrk" or to + 8 > len(data):
                return "midi", None
            to += 8 + int.from_bytes(data[to + 4 : to + 8], "big")
        return "midi", to if to <= len(data) else None
    if magic == b"fLaC" and len(head) >= 8 and head[4] & 0x7F == 0 and head[5:8] == b"\0\0\x22":
        return "flac", None
    if magic == b".snd" and len(head) >= 24:
        start, size, coding, rate, channels = struct.unpack(">5I", head[4:24])
        if start < 24 or not 1 <= coding <= 27 or not rate or not 1 <= channels <= 64:
            return None
        return "au", at + start + size if size != 0xFFFFFFFF and at + start + size <= len(data) else None
    if magic == b"caff" and head[4:8] == b"\0\1\0\0":
        return "caf", None
    return None


def sweep(data: bytes) -> list[dict]:
    """Containers by their magic, in order; of Ogg one for each run of streams."""
    out = []
    for magic in MAGICS:
        if magic == b"OggS":
            continue
        for at in bs.places(data, magic):
            if found := container_at(data, at):
                out.append({"kind": "container", "format": found[0], "offset": at, "end": found[1]})
    out += [{"kind": "container", "format": "ogg", "offset": a, "end": b, "open": not whole} for a, b, _, whole in frames.ogg_streams(data)]
    return sorted(out, key=lambda r: r["offset"])


def scores(data: bytes) -> np.ndarray:
    """How much each window looks like samples of 8 or 16 bits."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(0, (len(raw) - WINDOW) // STEP + 1)
    out = np.empty(n)
    for at in range(0, n, 256):
        out[at : at + 256] = bs.score_of(raw[np.arange(at, min(n, at + 256))[:, None] * STEP + np.arange(WINDOW)])
    return out


def blobs(data: bytes) -> list[dict]:
    """Runs of windows above LOW that have one above HIGH; up to BRIDGE weaker windows in a row don't end a run."""
    score = scores(data)
    good = np.flatnonzero(score >= LOW)
    if not len(good):
        return []
    heads = np.flatnonzero(np.append(True, np.diff(good) > BRIDGE + 1))
    out = []
    for run in np.split(good, heads[1:]):
        if len(run) >= LEAST_WINDOWS and score[run].max() >= HIGH:
            best = float(score[run].mean()) * BLOB_MOST
            out.append({"kind": "blob", "format": None, "offset": int(run[0]) * STEP, "end": int(run[-1]) * STEP + WINDOW, "confidence": round(best, 3)})
    return out


def _ends(containers: list[dict], sounds: list[dict], size: int) -> None:
    """An end for containers that have none: that of the sound behind the header, else the next region's start."""
    starts = [*(c["offset"] for c in containers), size]
    for c, after in zip(containers, starts[1:], strict=True):
        c["declared"] = c["end"] is not None and not c.get("open")
        if c["end"] is not None:
            continue
        reach = c["offset"] + HEADER
        chained = [s for s in sounds if c["offset"] <= s["offset"] < after]
        if chained and chained[0]["offset"] <= reach:
            end = chained[0]["end"]
            for s in chained[1:]:
                if s["offset"] - end > GAP:
                    break
                end = max(end, s["end"])
            c["end"] = min(end, after)
        else:
            c["end"] = next((s["offset"] for s in chained if s["offset"] > reach), after)


def _covered(r: dict, spans: list[dict]) -> bool:
    """Whether one of the spans holds half of a region or more."""
    return any(2 * (min(r["end"], s["end"]) - max(r["offset"], s["offset"])) >= r["end"] - r["offset"] for s in spans)


def locate(data: bytes, mode: str = "normal") -> list[dict]:
    """Regions in order: kind, format, offset, end, confidence, declared (the end is what the container says).

    strict: containers and chains alone. normal: blobs of BLOB_LEAST and more too. aggressive: all blobs.
    """
    if mode not in ("strict", "normal", "aggressive"):
        raise ValueError(f"no such mode: {mode}")
    containers, sounds = sweep(data), [] if mode == "strict" else blobs(data)
    streams = [{"kind": "stream", "format": "mp3", "offset": a, "end": b, "confidence": round(min(0.95, 0.7 + n / 200), 3)} for a, b, n in frames.mpeg_streams(data)]
    _ends(containers, sorted(sounds + streams, key=lambda r: r["offset"]), len(data))
    # A container inside another one is that one's payload.
    top: list[dict] = []
    for c in containers:
        if not any(t["offset"] <= c["offset"] < t["end"] for t in top[-1:]):
            top.append(c | {"confidence": CONTAINER})
    streams = [s for s in streams if not any(t["offset"] <= s["offset"] < t["end"] for t in top)]
    sounds = [s for s in sounds if not _covered(s, top + streams) and (mode == "aggressive" or s["confidence"] >= BLOB_LEAST)]
    out: list[dict] = []
    for r in sorted(top + streams + sounds, key=lambda r: (r["offset"], r["end"])):
        if out and r["kind"] == out[-1]["kind"] == "blob" and r["offset"] - out[-1]["end"] <= MERGE:
            out[-1] |= {"end": max(out[-1]["end"], r["end"]), "confidence": max(out[-1]["confidence"], r["confidence"])}
        else:
            out.append(dict(r))
    return out


def located(files: DataFrame, mode: str = "normal") -> DataFrame:
    """file, kind, format, offset, end, confidence, declared of each region of files (file, data)."""

    def found(data: np.ndarray) -> dict:
        rows = locate(data.tobytes(), mode)
        return {c: [r.get(c) for r in rows] for c in ("kind", "format", "offset", "end", "confidence", "declared")}

    return bs.per_file(files, "kind string, format string, offset long, end long, confidence double, declared boolean", found)


def resync(data: bytes) -> list[dict]:
    """The longest chains of chunks without a header, in either byte order: offset, end, chunks, order.

    A chunk counts if another one or the end of the data follows it. Of equal chains the longer stretch wins, and what lies
    in a chain is no chain of its own.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    printable = (raw >= 32) & (raw < 127)
    runs = np.flatnonzero(printable[:-7] & printable[1:-6] & printable[2:-5] & printable[3:-4]) if len(raw) >= 8 else np.empty(0, np.int64)
    best = []
    for order in ("<", ">"):
        size = raw[np.add.outer(runs, np.arange(4, 8))].astype(np.int64) @ (1 << 8 * np.arange(4)[:: 1 if order == "<" else -1])
        ends = runs + 8 + size + size % 2
        fits = (size > 0) & (runs + 8 + size <= len(raw))
        at, ends = runs[fits], np.minimum(ends[fits], len(raw))
        after = np.minimum(np.searchsorted(at, ends), max(0, len(at) - 1))
        linked = at[after] == ends if len(at) else np.empty(0, bool)
        whole = ends == len(raw)
        # From the right: how many chunks follow, and where the last one ends.
        chain, reach = np.ones(len(at), dtype=np.int64), ends.copy()
        for i in np.flatnonzero(linked)[::-1].tolist():
            chain[i], reach[i] = chain[after[i]] + 1, reach[after[i]]
        for i in np.flatnonzero(linked | whole).tolist():
            best.append((int(chain[i]), int(reach[i] - at[i]), -int(at[i]), int(reach[i]), order))
    out: list[dict] = []
    for n, _, start, end, order in sorted(best, reverse=True):
        if n >= 2 and not any(r["offset"] < end and -start < r["end"] for r in out):
            out.append({"offset": -start, "end": end, "chunks": n, "order": "little" if order == "<" else "big"})
    return sorted(out, key=lambda r: r["offset"])


def recovered(files: DataFrame) -> DataFrame:
    """file, offset, end, chunks, order of the chunk chains in files."""

    def found(data: np.ndarray) -> dict:
        rows = resync(data.tobytes())
        return {c: [r[c] for r in rows] for c in ("offset", "end", "chunks", "order")}

    return bs.per_file(files, "offset long, end long, chunks long, order string", found)


def stitched(regions: DataFrame, segment: int, slack: int = 64 << 10) -> DataFrame:
    """file, kind, format, offset, end: regions of one kind that an edge of a segment has cut are one again.

    Regions of files that were read in segments of `segment` bytes; two are joined if the first ends and the second begins
    within slack of the same edge. One window order a file.
    """
    w = Window.partitionBy("file", "kind", "format").orderBy("offset", "end")
    before = F.lag("end").over(w)
    edge = F.round(F.col("offset") / segment) * segment
    cut = (edge > 0) & (F.abs(F.col("offset") - edge) <= slack) & (F.abs(before - edge) <= slack) & (F.col("offset") - before <= slack)
    marked = isl.islands(regions.withColumn("_cut", cut), ["file", "kind", "format"], ["offset", "end"], ~F.coalesce("_cut", F.lit(False)))
    return marked.groupBy("file", "kind", "format", "island").agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("island")


def mpeg_chains(files: DataFrame) -> DataFrame:
    """file, start, end, frames of the chains of MPEG frames."""

    def found(data: np.ndarray) -> dict:
        rows = frames.mpeg_streams(data.tobytes())
        return {c: [r[i] for r in rows] for i, c in enumerate(("start", "end", "frames"))}

    return bs.per_file(files, "start long, end long, frames long", found)


def mpeg_checks(files: DataFrame) -> DataFrame:
    """file, frames, stray, cut: how much of each file is frames that follow one upon the other."""

    def found(data: np.ndarray) -> dict:
        return {k: [v] for k, v in frames.mpeg_validity(data.tobytes()).items()}

    return bs.per_file(files, "frames long, stray long, cut long", found)


def flac_checks(files: DataFrame) -> DataFrame:
    """file, ok, bad, unverified: frames by their checksums, of files with a FLAC header."""

    def found(data: np.ndarray) -> dict:
        raw = data.tobytes()
        start = next((c["offset"] for c in walkers.walk(raw, "flac") if c["id"] == "frames"), None) if raw[:4] == b"fLaC" else None
        states = [s for *_, s in frames.flac_frames(raw, start)] if start is not None else []
        return {k: [states.count(k)] if start is not None else [] for k in ("ok", "bad", "unverified")}

    return bs.per_file(files, "ok long, bad long, unverified long", found)
