"""Samples out of modules, banks and streams, each as a WAVE file.

An extractor yields `Sample`s of a file's bytes; `register` adds one. `extracted` runs them over a table of files, one row a
sample. What a file claims beyond its end is cut, and said so in `note`; an extractor that fails leaves what it has found.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.functions import codecs
from oreweave.sources import walkers

EXTRACTORS: dict[str, Callable[[bytes], Iterator[Sample]]] = {}
#: Frames a second of a module's middle note (fixed by the hardware: its clock over two periods).
MIDDLE = 8363


@dataclass
class Sample:
    name: str
    rate: int
    pcm: np.ndarray
    channels: int = 1
    bits: int = 16
    note: str = ""
    key: int | None = None

    def wav(self) -> bytes:
        return wave_file(self.pcm, self.rate, self.channels, self.bits)


def wave_file(pcm: np.ndarray, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """A WAVE file of whole numbers, channels interleaved; 8 bits are stored unsigned."""
    if bits == 24:
        data = np.ascontiguousarray(pcm.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        data = (pcm + 128).astype(np.uint8).tobytes() if bits == 8 else pcm.astype("<i2" if bits == 16 else "<i4").tobytes()
    size = bits // 8
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, channels, rate, rate * channels * size, channels * size, bits, b"data", len(data))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(data) + len(data) % 2) + b"WAVE" + head + data + b"\0" * (len(data) % 2)


def register(*kinds: str):
    def add(f):
        EXTRACTORS.update(dict.fromkeys(kinds, f))
        return f

    return add


def signed(data: bytes, wide: bool = False, big: bool = False) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 2 * 2], dtype=">i2" if big else "<i2").astype(np.int64) if wide else np.frombuffer(data, dtype=np.int8).astype(np.int64)


def whole(x: np.ndarray, bits: int = 16) -> np.ndarray:
    """Numbers of [-1, 1) as whole ones."""
    top = 1 << bits - 1
    return np.clip(np.round(np.asarray(x) * top), -top, top - 1).astype(np.int64)


def _named(data: bytes, kind: str, prefix: str = "sample") -> Iterator[tuple[dict, dict, bytes, str]]:
    """The sample chunks that the walker has found: chunk, fields, bytes, what is odd."""
    for c in walkers.walk(data, kind):
        if c["id"].startswith(prefix):
            yield c, walkers.values(c["fields"]), data[c["offset"] : c["offset"] + c["size"]], "; ".join(c["warnings"])


@register("mod")
def mod_samples(data: bytes) -> Iterator[Sample]:
    for c, known, raw, note in _named(data, "mod"):
        yield Sample(known["name"] or c["id"], MIDDLE, signed(raw), bits=8, note=note)


@register("xm")
def xm_samples(data: bytes) -> Iterator[Sample]:
    """Differences; a note above or below the middle one changes the rate."""
    for c, known, raw, note in _named(data, "xm"):
        bits = int(known["bits_per_sample"])
        yield Sample(known["name"] or c["id"], round(MIDDLE * 2 ** (int(known["note"]) / 12)), whole(codecs.delta(raw, bits), bits), bits=bits, note=note)


@register("s3m")
def s3m_samples(data: bytes) -> Iterator[Sample]:
    """Unsigned, as the second kind of file has them; the first kind's are signed."""
    first = data[42:44] == b"\1\0"
    for c, known, raw, note in _named(data, "s3m"):
        wide = known["bits_per_sample"] == "16"
        x = signed(raw, wide)
        x = x if first else (x + (1 << 16 if wide else 256)) % (1 << 16 if wide else 256) - (1 << 15 if wide else 128)
        yield Sample(known["name"] or c["id"], int(known["sample_rate"]), x, bits=16 if wide else 8, note=note)


@register("it")
def it_samples(data: bytes) -> Iterator[Sample]:
    """Plain and packed ones; of packed stereo the first channel."""
    for c, known, raw, note in _named(data, "it"):
        wide, count = known["bits_per_sample"] == "16", int(known["samples"])
        if known["packed"] == "True":
            x, _ = codecs.packed_deltas(data[c["offset"] :], count, wide, bool(int(known["coding"]) & 4))
            note = note if len(x) == count else "cut off"
        else:
            x = signed(raw, wide)
        yield Sample(known["name"] or c["id"], int(known["sample_rate"]), x, bits=16 if wide else 8, note=note)


@register("gf1pat")
def gf1_samples(data: bytes) -> Iterator[Sample]:
    # One instrument of 63 bytes, one layer of 47, then the waves.
    at = 129 + 63
    count, at = data[at + 6], at + 47
    for i in range(count):
        name, _, size, _, _, rate = struct.unpack_from("<7sBIIIH", data, at)
        modes, start = data[at + 55], at + 96
        raw = data[start : start + size]
        wide = bool(modes & 1)
        x = signed(raw, wide)
        if modes & 2:
            x = (x + (1 << 16 if wide else 256)) % (1 << 16 if wide else 256) - (1 << 15 if wide else 128)
        yield Sample(name.split(b"\0")[0].decode("latin-1") or f"wave{i + 1}", rate, x, bits=16 if wide else 8, note="" if len(raw) == size else "cut off")
        at = start + size


@register("8svx")
def svx_sample(data: bytes) -> Iterator[Sample]:
    known, body, name = {}, b"", ""
    for c in walkers.walk(data, "8svx"):
        raw = data[c["offset"] + 8 : c["offset"] + 8 + c["size"]]
        known |= walkers.values(c["fields"]) if c["id"] == "VHDR" else {}
        body, name = (raw, name) if c["id"] == "BODY" else (body, raw.split(b"\0")[0].decode("latin-1")) if c["id"] == "NAME" else (body, name)
    packed = known.get("compression") == "1"
    yield Sample(name or "sample", int(known.get("rate", MIDDLE)), whole(codecs.fibonacci_delta(body), 8) if packed else signed(body), bits=8)


@register("sf2")
def sf2_samples(data: bytes) -> Iterator[Sample]:
    """By the bank's sample headers; the last one is a terminator, links to ROM are left out."""
    pool, heads = b"", b""
    for c in walkers.walk(data, "sf2"):
        if c["id"] == "LIST":
            for x in walkers.sized(data, c["offset"] + 12, "<", {}, c["offset"] + 8 + c["size"]):
                raw = data[x["offset"] + 8 : x["offset"] + 8 + x["size"]]
                pool, heads = (raw, heads) if x["id"] == "smpl" else (pool, raw) if x["id"] == "shdr" else (pool, heads)
    for at in range(0, len(heads) - 46 - 45, 46):
        name, start, end, _, _, rate, key, _, _, kind = struct.unpack_from("<20s5IBbHH", heads, at)
        if not kind & 0x8000:
            yield Sample(name.split(b"\0")[0].decode("latin-1"), rate, signed(pool[2 * start : 2 * end], True), note="" if 2 * end <= len(pool) else "cut off", key=key if key < 128 else None)


@register("vag")
def vag_sample(data: bytes) -> Iterator[Sample]:
    head, *rest = walkers.walk(data, "vag")
    known = walkers.values(head["fields"])
    yield Sample(known["name"] or "sample", int(known["sample_rate"]), whole(codecs.spu_adpcm(data[48 : 48 + int(known["bytes"])])), note="; ".join(w for c in rest for w in c["warnings"]))


@register("adx")
def adx_sample(data: bytes) -> Iterator[Sample]:
    head, *_ = walkers.walk(data, "adx")
    k = {n: int(v) for n, v in walkers.values(head["fields"]).items()}
    start, channels, size = k["data_offset"] + 4, k["channels"], k["block_bytes"]
    body = data[start:]
    # Frames of the channels take turns.
    parts = [codecs.adx(b"".join(body[at : at + size] for at in range(c * size, len(body) - size + 1, channels * size)), k["sample_rate"], k["highpass"]) for c in range(channels)]
    n = min(k["samples"], *map(len, parts))
    yield Sample("stream", k["sample_rate"], whole(np.column_stack([p[:n] for p in parts]).ravel()), channels, note="" if n == k["samples"] else "cut off")


@register("dmx")
def dmx_sample(data: bytes) -> Iterator[Sample]:
    """Sixteen bytes of padding stand at each end of the samples."""
    _, rate, count = struct.unpack_from("<HHI", data, 0)
    raw = data[8 : 8 + count]
    yield Sample("sound", rate, np.frombuffer(raw[16:-16] if len(raw) > 32 else raw, dtype=np.uint8).astype(np.int64) - 128, bits=8, note="" if len(raw) == count else "cut off")


@register("snd")
def snd_sample(data: bytes) -> Iterator[Sample]:
    head, *_ = walkers.walk(data, "snd")
    known = walkers.values(head["fields"])
    x, two = signed(data[42:], True), known["stereo"] == "1"
    half = len(x) // 2
    yield Sample(known["name"].strip(), int(known["sample_rate"]), np.column_stack([x[:half], x[half : 2 * half]]).ravel() if two else x, 2 if two else 1)


@register("au")
def au_sample(data: bytes) -> Iterator[Sample]:
    start, size, coding, rate, channels = struct.unpack_from(">5I", data, 4)
    raw = data[start : start + size] if size != 0xFFFFFFFF else data[start:]
    bits = {2: 8, 3: 16, 4: 24, 5: 32}.get(coding, 16)
    if coding == 2:
        x = signed(raw)
    elif coding in (1, 27):
        x = whole(codecs.mu_law(raw) if coding == 1 else codecs.a_law(raw))
    elif coding in (6, 7):
        x = whole(codecs.pcm(raw, 32 if coding == 6 else 64, big=True, floating=True))
    else:
        x = whole(codecs.pcm(raw, bits, big=True), bits)
    yield Sample("sound", rate, x, channels, bits, "" if size in (0xFFFFFFFF, len(raw)) else "cut off")


@register("aiff", "aifc")
def aiff_sample(data: bytes) -> Iterator[Sample]:
    known, body, little = {}, b"", False
    for c in walkers.walk(data, "aiff"):
        if c["id"] == "COMM":
            known = walkers.values(c["fields"])
            little = data[8:12] == b"AIFC" and data[c["offset"] + 26 : c["offset"] + 30] == b"sowt"
        elif c["id"] == "SSND":
            (skip,) = struct.unpack_from(">I", data, c["offset"] + 8)
            body = data[c["offset"] + 16 + skip : c["offset"] + 8 + c["size"]]
    bits = (int(known["bits_per_sample"]) + 7) // 8 * 8
    x = signed(body) if bits == 8 else whole(codecs.pcm(body, bits, big=not little), bits)
    yield Sample("sound", round(float(known["sample_rate"])), x, int(known["channels"]), bits)


@register("voc")
def voc_samples(data: bytes) -> Iterator[Sample]:
    for c in walkers.walk(data, "voc"):
        known = walkers.values(c["fields"])
        if c["id"] == "sound" and known.get("codec") == "0":
            yield Sample("sound", int(known["sample_rate"]), np.frombuffer(data[c["offset"] + 6 : c["offset"] + 4 + c["size"]], dtype=np.uint8).astype(np.int64) - 128, bits=8, note="; ".join(c["warnings"]))
        elif c["id"] == "sound9" and known.get("codec") in ("0", "4"):
            raw, bits = data[c["offset"] + 16 : c["offset"] + 4 + c["size"]], int(known["bits_per_sample"])
            x = signed(raw, True) if bits == 16 else np.frombuffer(raw, dtype=np.uint8).astype(np.int64) - 128
            yield Sample("sound", int(known["sample_rate"]), x, int(known["channels"]), bits, "; ".join(c["warnings"]))


@register("wav")
def wav_sample(data: bytes) -> Iterator[Sample]:
    """Linear, floating, mu-law, A-law, IMA mono and MS ADPCM."""
    known, body = {}, b""
    for c in walkers.walk(data, "wav"):
        known |= walkers.values(c["fields"]) if c["id"] == "fmt " else {}
        body = data[c["offset"] + 8 : c["offset"] + 8 + c["size"]] if c["id"] == "data" else body
    tag, channels, rate, bits, block = (int(known[k]) for k in ("format_tag", "channels", "sample_rate", "bits_per_sample", "block_align"))
    pieces = [body[i : i + block] for i in range(0, len(body), max(1, block))] if tag in (2, 17) else []
    if tag == 2:
        x, bits = whole(np.concatenate([codecs.ms_adpcm_block(p, channels) for p in pieces] or [np.empty(0)])), 16
    elif tag == 17 and channels == 1:
        x, bits = whole(np.concatenate([codecs.ima_block(p) for p in pieces] or [np.empty(0)])), 16
    elif tag in (6, 7):
        x, bits = whole(codecs.mu_law(body) if tag == 7 else codecs.a_law(body)), 16
    elif tag == 3:
        x, bits = whole(codecs.pcm(body, bits, floating=True)), 16
    elif tag in (1, 65534):
        x = whole(codecs.pcm(body, bits), bits)
    else:
        raise ValueError(f"coding {tag} is not known")
    yield Sample("sound", rate, x, channels, bits)


@register("multisample", "zip")
def packed_samples(data: bytes) -> Iterator[Sample]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.filename.lower().endswith(".wav"):
                for s in wav_sample(z.read(info)):
                    yield Sample(info.filename, s.rate, s.pcm, s.channels, s.bits, s.note)


@register("gcm", "iso")
def disc_samples(data: bytes) -> Iterator[Sample]:
    """Files of a disc that are sound of a known kind."""
    for c in walkers.walk(data, "iso" if data[32_769:32_774] == b"CD001" else "gcm"):
        name = c["summary"].rpartition("/")[2]
        kind = name.rpartition(".")[2].lower()
        if c["id"] == "file" and kind in ("wav", "aiff", "adx", "vag", "au"):
            for s in EXTRACTORS[kind](data[c["offset"] : c["offset"] + c["size"]]):
                yield Sample(c["summary"], s.rate, s.pcm, s.channels, s.bits, s.note)


def samples(data: bytes, kind: str | None) -> Iterator[Sample]:
    """Of kinds without an extractor, none."""
    try:
        yield from EXTRACTORS.get(kind, lambda _: ())(data)
    except (struct.error, IndexError, ValueError, KeyError, TypeError, OverflowError, zipfile.BadZipFile, zlib.error) as e:
        yield Sample("", 0, np.empty(0, np.int64), note=f"extractor stopped: {e}")


SCHEMA = "path string, seq int, name string, rate int, channels int, bits int, frames long, key int, note string, wav binary"


def extracted(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, format, content)."""
    kinds = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("key", pa.int32()), ("note", pa.string()), ("wav", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                for i, s in enumerate(samples(data.as_py() or b"", kind.as_py())):
                    row = {"path": path.as_py(), "seq": i, "name": s.name, "rate": s.rate, "channels": s.channels, "bits": s.bits, "frames": len(s.pcm) // max(1, s.channels), "key": s.key, "note": s.note, "wav": s.wav() if s.rate else None}
                    yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return files.select("path", "format", "content").mapInArrow(run, SCHEMA)


def converted(files: DataFrame) -> DataFrame:
    """path, wav of files that are one sound: the path has the new extension."""
    found = extracted(files).where("wav is not null")
    single = found.groupBy("path").agg(F.count("*").alias("n"), F.first("wav").alias("wav")).where("n = 1")
    return single.select(F.concat(F.regexp_replace("path", "\\.[^./]*$", ""), F.lit(".wav")).alias("path"), "wav")
