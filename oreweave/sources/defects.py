"""What is odd about a file: rules over its walked chunks and its bytes, each a function that yields findings.

A finding is (severity, offset, rule, message). A rule names the formats it looks at (None: all). A rule that fails is itself a
finding without an offset, so one odd file stops neither the other rules nor the job.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave.functions import frames
from oreweave.operators import regions
from oreweave.sources import walkers

SEVERITIES = ["info", "notice", "warn", "alert"]
Finding = tuple[str, int | None, str, str]
RIFF, IFF, ID3 = ("wav", "rf64", "rifx", "riff", "sf2", "rmid", "avi"), ("aiff", "aifc", "8svx", "iff", "smus"), ("mp3", "id3-wrapped")
#: Chunks that a file may hold once, frames that a tag may hold more than once, keys of a preset: fixed by the formats.
UNIQUE = {"fmt ", "data", "fact", "bext", "smpl", "inst", "acid", "ds64", "COMM", "SSND", "VHDR", "INST"}
REPEATABLE = {"TXXX", "WXXX", "WCOM", "WOAR", "COMM", "USLT", "SYLT", "APIC", "GEOB", "PRIV", "UFID", "POPM", "AENC", "ENCR", "GRID", "LINK", "CHAP", "CTOC", "RVA2", "EQU2", "SIGN", "COMR", "USER"}
PRESET_KEYS = {"author", "comments", "macro1", "macro2", "macro3", "macro4", "preset_name", "preset_style", "settings", "synth_version"}
CAVITY, FAR_END, UNLISTED, MDAT_REST = 1024, 66_000, 4, 1024


@dataclass
class File:
    data: bytes
    kind: str | None
    chunks: list[dict] = field(default_factory=list)

    @property
    def end(self) -> int | None:
        """Where a reader that goes by the header stops."""
        if self.kind in RIFF + IFF and self.chunks:
            size = struct.unpack_from(">I" if self.data[:4] in (b"RIFX", b"FORM") else "<I", self.data, 4)[0]
            return None if size == 0xFFFFFFFF else min(8 + size + size % 2, max(len(self.data), 8 + size))
        if self.kind == "midi":
            return max((c["offset"] + 8 + c["size"] for c in self.chunks if c["id"] in ("MThd", "MTrk")), default=None)
        if self.kind == "au" and len(self.data) >= 24:
            start, size = struct.unpack_from(">II", self.data, 4)
            return None if size == 0xFFFFFFFF else start + size
        return None

    def payload(self, c: dict) -> tuple[int, int]:
        """Start and end of a chunk's payload, by how the format sizes its chunks."""
        if self.kind == "mp4":
            return c["offset"] + 8, c["offset"] + c["size"]
        head = {"flac": 4, "caf": 12}.get(self.kind, 8)
        return c["offset"] + head, c["offset"] + head + c["size"]


RULES: list[tuple[str, tuple | None, Callable[[File], Iterator[Finding]]]] = []


def rule(name: str, *kinds: str):
    def add(f):
        RULES.append((name, kinds or None, f))
        return f

    return add


@rule("structure")
def structure(f: File) -> Iterator[Finding]:
    """What the walker has complained about; that it stopped early says nothing about the file."""
    for c in f.chunks:
        for w in c["warnings"]:
            early = w.startswith("more than")
            yield ("info" if early else "warn", c["offset"], "coverage" if early else "structure", f"{c['id']}: {w}")


@rule("trailing_data")
def trailing_data(f: File) -> Iterator[Finding]:
    if f.end is not None and f.end < len(f.data):
        yield "notice", f.end, "trailing_data", f"{len(f.data) - f.end} bytes after the declared end"


@rule("polyglot")
def polyglot(f: File) -> Iterator[Finding]:
    """Another format's magic number where this one ends, or a zip directory near the end of what is no zip file."""
    end = f.end
    tail = f.data[end:] if end is not None else b""
    if tail[:4] in (b"PK\3\4", b"RIFF", b"fLaC", b"OggS", b"MThd", b"\x89PNG", b"%PDF", b"\x7fELF", b"Rar!", b"7z\xbc\xaf"):
        yield "alert", end, "polyglot", "another file begins at the declared end"
        return
    at = f.data.rfind(b"PK\5\6", max(0, len(f.data) - FAR_END))
    if at >= 0 and len(f.data) - at >= 22 and f.kind not in ("zip", "multisample", "labx", "xpn"):
        yield "alert", at, "polyglot", "a zip directory near the end"


@rule("nonprintable_text")
def nonprintable_text(f: File) -> Iterator[Finding]:
    for c in f.chunks:
        for x in c["fields"]:
            n = sum(ord(ch) < 32 and ch not in "\t\n\r\v\f" for ch in x["value"])
            if n >= 2:
                yield "notice", c["offset"], "nonprintable_text", f"{c['id']} {x['name']}: {n} control characters"


@rule("duplicate_frame", *ID3)
def duplicate_frame(f: File) -> Iterator[Finding]:
    counts = Counter(c["id"][4:] for c in f.chunks if c["id"].startswith("ID3/"))
    for name, n in counts.items():
        if n > 1 and name not in REPEATABLE:
            yield "notice", 0, "duplicate_frame", f"{name} is there {n} times"


@rule("cavity_content", *RIFF, *IFF, "mp4", "flac")
def cavity_content(f: File) -> Iterator[Finding]:
    for c in f.chunks:
        name = c["id"].rpartition("/")[2].strip().upper()
        start, end = f.payload(c)
        if name in ("JUNK", "PAD") and end - start < CAVITY or name not in ("JUNK", "PAD", "FREE", "SKIP", "PADDING"):
            continue
        if any(f.data[start:end]):
            yield "notice", start, "cavity_content", f"{name} of {end - start} bytes is not empty"


@rule("application_block", "flac")
def application_block(f: File) -> Iterator[Finding]:
    for c in f.chunks:
        if c["id"] == "APPLICATION":
            yield "notice", c["offset"], "application_block", f"{c['size']} bytes of an application's own"


@rule("ogg_multistream", "ogg")
def ogg_multistream(f: File) -> Iterator[Finding]:
    first = {x["value"] for c in f.chunks if c["id"] == "page" for x in c["fields"] if x["name"] == "serial" and int(walkers.values(c["fields"])["flags"]) & 2}
    if len(first) > 1:
        yield "notice", 0, "ogg_multistream", f"{len(first)} streams in one file"


@rule("mp4_mdat_coverage", "mp4")
def mp4_mdat_coverage(f: File) -> Iterator[Finding]:
    held = sum(max(0, c["size"] - 8) for c in f.chunks if c["id"] == "mdat")
    told = count = 0
    for c in f.chunks:
        if c["id"].endswith("stsz"):
            each, n = struct.unpack_from(">II", f.data, c["offset"] + 12)
            count += n
            told += each * n if each else sum(x for (x,) in struct.iter_unpack(">I", f.data[c["offset"] + 20 : c["offset"] + 20 + 4 * n]))
    if count and held - told > MDAT_REST:
        yield "notice", next(c["offset"] for c in f.chunks if c["id"] == "mdat"), "mp4_mdat_coverage", f"{held - told} bytes of media belong to no sample"


@rule("id3_padding_nonzero", *ID3)
def id3_padding(f: File) -> Iterator[Finding]:
    tag = next((c for c in f.chunks if c["id"] == "ID3"), None)
    if tag is not None:
        at = max((c["offset"] + 10 + c["size"] for c in f.chunks if c["id"].startswith("ID3/")), default=10)
        if any(f.data[at : tag["size"]]):
            yield "notice", at, "id3_padding_nonzero", f"{tag['size'] - at} bytes behind the last frame are not all zero"


@rule("dual_endianness", "wav", "rf64", "aiff", "aifc", "au")
def dual_endianness(f: File) -> Iterator[Finding]:
    """Samples of 16 bits that run smoothly read either way."""
    c = next((c for c in f.chunks if c["id"] in ("data", "SSND")), None)
    if c is None:
        return
    start, end = (c["offset"], c["offset"] + c["size"]) if f.kind == "au" else f.payload(c)
    raw = f.data[start : end - (end - start) % 2]
    smooth = []
    for order in "<>":
        x = np.frombuffer(raw, dtype=f"{order}i2").astype(float)
        x = x - x.mean() if len(x) else x
        square = float(x @ x)
        smooth.append(float(x[1:] @ x[:-1]) / square if square else 0.0)
    if len(raw) >= 64 and min(smooth) > 0.9:
        yield "notice", start, "dual_endianness", f"correlations {smooth[0]:.2f} and {smooth[1]:.2f} in the two byte orders"


@rule("nonzero_pad", *RIFF, *IFF)
def nonzero_pad(f: File) -> Iterator[Finding]:
    for c in f.chunks[1:]:
        at = c["offset"] + 8 + c["size"]
        if "/" not in c["id"] and c["id"] != "tail" and c["size"] % 2 and at < min(len(f.data), f.end or len(f.data)) and f.data[at]:
            yield "warn", at, "nonzero_pad", f"the byte after {c['id']} is {f.data[at]}"


@rule("duplicate_chunk", *RIFF, *IFF)
def duplicate_chunk(f: File) -> Iterator[Finding]:
    seen: Counter = Counter()
    for c in f.chunks:
        seen[c["id"]] += 1
        if c["id"] in UNIQUE and seen[c["id"]] == 2:
            yield "warn", c["offset"], "duplicate_chunk", f"{c['id']} is there again"


@rule("wrong_format_tag")
def wrong_format_tag(f: File) -> Iterator[Finding]:
    if f.kind not in (*ID3, "ape", "wavpack") and f.data[-32:-24] == b"APETAGEX":
        yield "notice", len(f.data) - 32, "wrong_format_tag", "a tag of another format at the end"


@rule("embedded_standalone_media")
def embedded(f: File) -> Iterator[Finding]:
    """Whole containers behind the first header; those that hold their own sound are other rules' matter."""
    for r in regions.sweep(f.data):
        if r["offset"] and r["end"] is not None and r["end"] - r["offset"] >= 44 and f.kind not in ("rmid", "zip", "multisample", "gcm", "cdxa"):
            yield "notice", r["offset"], "embedded_standalone_media", f"a whole {r['format']} file of {r['end'] - r['offset']} bytes"


@rule("json_trailing_data", "vital")
def json_trailing(f: File) -> Iterator[Finding]:
    for c in f.chunks:
        if c["id"] == "tail":
            yield "alert", c["offset"], "json_trailing_data", f"{c['size']} bytes after the object"


@rule("json_unknown_key", "vital")
def json_unknown(f: File) -> Iterator[Finding]:
    for c in f.chunks:
        if c["id"] == "object":
            for name in sorted({x["name"] for x in c["fields"]} - PRESET_KEYS):
                yield "notice", 0, "json_unknown_key", f"{name} is no key of a preset"


@rule("unaccounted_bytes", "flac", "ogg", "brstm", "it", "s3m", "gcm")
def unaccounted(f: File) -> Iterator[Finding]:
    """Bytes that no chunk covers and that are not all the same."""
    extra = {"flac": 4}.get(f.kind, 0)
    reach = 0
    for start, end in sorted((c["offset"], c["offset"] + c["size"] + (extra if c["id"] not in ("fLaC", "frames") else 0)) for c in f.chunks) + [(len(f.data), len(f.data))]:
        gap = f.data[reach:start]
        if len(gap) >= UNLISTED and len(set(gap)) > 1:
            yield "notice", reach, "unaccounted_bytes", f"{len(gap)} bytes belong to no chunk"
        reach = max(reach, end)


@rule("bad_frame_checksum", "flac")
def bad_frames(f: File) -> Iterator[Finding]:
    start = next((c["offset"] for c in f.chunks if c["id"] == "frames"), None)
    if start is not None:
        for a, b, state in frames.flac_frames(f.data, start):
            if state == "bad":
                yield "warn", a, "bad_frame_checksum", f"the checksum of {b - a} bytes is wrong"


def findings(data: bytes, kind: str | None) -> list[Finding]:
    """All findings of a file, worst first, then by place (none first)."""
    f = File(data, kind, walkers.walk(data, kind) if kind else [])
    out: list[Finding] = []
    for name, kinds, check in RULES:
        if kinds is None or kind in kinds:
            try:
                out += check(f)
            except (struct.error, IndexError, ValueError, KeyError, OverflowError) as e:
                out.append(("warn", None, "check_failed", f"{name}: {e}"))
    return sorted(out, key=lambda x: (-SEVERITIES.index(x[0]), -1 if x[1] is None else x[1], x[2]))


SCHEMA = "path string, severity string, offset long, rule string, message string"


def defects(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, format, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows = [(path.as_py(), *x) for x in findings(data.as_py() or b"", kind.as_py())]
                for at in range(0, len(rows), walkers.BATCH):
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows[at : at + walkers.BATCH], strict=True), kinds, strict=True)], ["path", "severity", "offset", "rule", "message"])

    return files.select("path", "format", "content").mapInArrow(run, SCHEMA)


def verdicts(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, findings, worst, code of every file: 0 clean (or info alone), 1 something to look at, 2 an alert."""
    level = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1
    per = found.groupBy("path").agg(F.count("*").alias("findings"), F.max(level(F.col("severity"))).alias("level"))
    worst: Column = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("level").cast("int") + 1)
    out = files.select("path").join(per, "path", "left")
    return out.select("path", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.when(F.col("level").isNotNull(), worst).alias("worst"), F.when(F.col("level") >= 3, 2).when(F.col("level") >= 1, 1).otherwise(0).alias("code"))
