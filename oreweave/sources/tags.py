"""What files say about themselves: tags of sound files and of presets as one record each."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from oreweave.functions import fields
from oreweave.sources import walkers

NAMES = ("title", "artist", "album", "genre", "year", "track", "comment", "bpm", "key", "device", "category", "tags")
#: Which field of a record a tag is: fixed by the formats.
ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TYER": "year", "TDRC": "year", "TRCK": "track", "TBPM": "bpm", "TKEY": "key", "COMM": "comment"}
INFO = {"INAM": "title", "IART": "artist", "IPRD": "album", "IGNR": "genre", "ICRD": "year", "ITRK": "track", "ICMT": "comment", "IKEY": "tags"}
VORBIS = {"title": "title", "artist": "artist", "album": "album", "genre": "genre", "date": "year", "tracknumber": "track", "comment": "comment", "description": "comment", "bpm": "bpm", "tempo": "bpm", "key": "key", "initialkey": "key"}
ATOMS = {b"\xa9nam": "title", b"\xa9ART": "artist", b"\xa9alb": "album", b"\xa9gen": "genre", b"\xa9day": "year", b"trkn": "track", b"\xa9cmt": "comment", b"tmpo": "bpm"}
TEXTS = {"NAME": "title", "AUTH": "artist", "ANNO": "comment", "(c) ": "comment"}

Record = dict[str, str]
READERS: dict[str, Callable[[bytes], Record]] = {}


def register(*kinds: str):
    def add(f):
        READERS.update(dict.fromkeys(kinds, f))
        return f

    return add


def _take(out: Record, name: str | None, value: str) -> None:
    """The first text of each field counts."""
    value = value.strip("\0 \t\r\n")
    if name and value and name not in out:
        out[name] = value


def id3(data: bytes) -> Record:
    out: Record = {}
    for c in walkers.walk(data, "mp3"):
        frame = c["id"][4:]
        if frame in ID3:
            raw = data[c["offset"] + 10 : c["offset"] + 10 + c["size"]]
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(raw[:1][0] if raw else 0, "utf-8")
            text = raw[1:].decode(coding, "replace")
            if frame == "COMM":
                text = raw[4:].decode(coding, "replace").partition("\0")[2]
            _take(out, ID3[frame], text.split("\0")[0] if frame != "COMM" else text)
    return out


READERS["mp3"] = READERS["id3-wrapped"] = id3


@register("wav", "rf64", "rifx")
def riff(data: bytes) -> Record:
    out: Record = {}
    for c in walkers.walk(data, "wav"):
        if c["id"].startswith("INFO/"):
            _take(out, INFO.get(c["id"][5:]), c["summary"])
        elif c["id"].lower() in ("id3 ", "id3"):
            out = id3(data[c["offset"] + 8 : c["offset"] + 8 + c["size"]]) | out
        elif c["id"] == "acid":
            known = walkers.values(c["fields"])
            if float(known.get("tempo", 0)) > 0:
                _take(out, "bpm", f"{float(known['tempo']):g}")
    return out


@register("aiff", "aifc", "8svx", "smus")
def iff(data: bytes) -> Record:
    out: Record = {}
    for c in walkers.walk(data, "aiff"):
        raw = data[c["offset"] + 8 : c["offset"] + 8 + c["size"]]
        if c["id"] in TEXTS:
            _take(out, TEXTS[c["id"]], raw.decode("latin-1"))
        elif c["id"].strip().upper() == "ID3":
            out = id3(raw) | out
    return out


def comments(block: bytes) -> Record:
    out: Record = {}
    for f in walkers._comments(block):
        _take(out, VORBIS.get(f["name"]), f["value"])
    return out


@register("flac")
def flac(data: bytes) -> Record:
    block = next((c for c in walkers.walk(data, "flac") if c["id"] == "VORBIS_COMMENT"), None)
    return comments(data[block["offset"] + 4 : block["offset"] + 4 + block["size"]]) if block else {}


@register("ogg")
def ogg(data: bytes) -> Record:
    """The packet of comments, put together from the pages it runs over."""
    whole = b""
    for c in walkers.walk(data, "ogg"):
        if c["id"] == "page":
            head = 27 + data[c["offset"] + 26]
            whole += data[c["offset"] + head : c["offset"] + c["size"]]
        if len(whole) > 1 << 20:
            break
    for mark in (b"\3vorbis", b"OpusTags"):
        if (at := whole.find(mark)) >= 0:
            return comments(whole[at + len(mark) :])
    return {}


@register("mp4")
def mp4(data: bytes) -> Record:
    out: Record = {}
    at = data.find(b"ilst")
    if at < 4:
        return out
    end, at = at - 4 + struct.unpack_from(">I", data, at - 4)[0], at + 4
    while at + 24 <= min(end, len(data)):
        size, name = struct.unpack_from(">I4s", data, at)
        if size < 24:
            break
        inner, kind = struct.unpack_from(">I4x", data, at + 8)[0], struct.unpack_from(">I", data, at + 16)[0]
        value = data[at + 24 : at + 8 + inner]
        if name == b"trkn" and len(value) >= 4:
            _take(out, "track", str(int.from_bytes(value[2:4], "big")))
        elif name == b"tmpo":
            _take(out, "bpm", str(int.from_bytes(value, "big")))
        elif kind == 1:
            _take(out, ATOMS.get(name), value.decode("utf-8", "replace"))
        at += size
    return out


@register("mod", "s3m", "xm", "it", "sid", "rsid", "nsf", "sap", "vag")
def tune(data: bytes, kind: str | None = None) -> Record:
    """What a tune's header says; for formats whose walkers tell a title and an author."""
    out: Record = {}
    for kind in (kind,) if kind else ("mod", "s3m", "xm", "it", "sid", "nsf", "sap", "vag"):
        for c in walkers.walk(data, kind)[:1]:
            known = walkers.values(c["fields"])
            for name, keys in (("title", ("title", "name")), ("artist", ("author", "artist")), ("year", ("released", "date")), ("comment", ("copyright", "tracker"))):
                for k in keys:
                    _take(out, name, known.get(k, ""))
        if out:
            break
    return out


for _kind in ("mod", "s3m", "xm", "it", "sid", "nsf", "sap", "vag"):
    READERS[_kind] = lambda data, kind=_kind: tune(data, kind)
READERS["rsid"] = READERS["sid"]


@register("vital")
def vital(data: bytes) -> Record:
    value, _ = fields.json_span(data)
    out: Record = {"device": "Vital"} if value is not None else {}
    for name, key in (("title", "preset_name"), ("artist", "author"), ("category", "preset_style"), ("comment", "comments")):
        _take(out, name, str((value or {}).get(key) or ""))
    return out


@register("multisample")
def multisample(data: bytes) -> Record:
    """The sheet inside: attributes of its root, category, creator, key words."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("multisample.xml").decode("utf-8", "replace")
    out: Record = {"device": "Sampler"}
    if m := re.search(r"<multisample[^>]*\bname=\"([^\"]*)\"", sheet):
        _take(out, "title", m[1])
    for name, element in (("category", "category"), ("artist", "creator"), ("comment", "description")):
        if m := re.search(rf"<{element}>([^<]*)</{element}>", sheet):
            _take(out, name, m[1])
    _take(out, "tags", ";".join(re.findall(r"<keyword>([^<]*)</keyword>", sheet)))
    return out


@register("als", "alc", "adg", "adv", "agr")
def live(data: bytes) -> Record:
    head = zlib.decompressobj(31).decompress(data, 1 << 20).decode("utf-8", "replace")
    out: Record = {}
    if m := re.search(r"<Ableton[^>]*\bCreator=\"([^\"]*)\"", head):
        _take(out, "device", m[1])
    if m := re.search(r"<Tempo>.*?<Manual Value=\"([0-9.]+)\"", head, re.S):
        _take(out, "bpm", m[1])
    return out


@register("bitwig")
def bitwig(data: bytes) -> Record:
    """Named texts of the header: a name and a text, each behind its length in four big-endian bytes."""
    out: Record = {}
    known = {"preset_name": "title", "creator": "artist", "preset_category": "category", "device_name": "device", "tags": "tags", "comment": "comment"}
    for m in re.finditer(rb"\0\0\0([\x01-\x40])([a-z_]+)", data[: 1 << 16]):
        size = m[1][0]
        name = data[m.start(2) : m.start(2) + size].decode("latin-1")
        at = m.start(2) + size
        if name in known and data[at : at + 1] == b"\x08" and at + 5 <= len(data):
            (n,) = struct.unpack_from(">I", data, at + 1)
            _take(out, known[name], data[at + 5 : at + 5 + n].decode("utf-8", "replace"))
    return out


def record(data: bytes, kind: str | None) -> Record:
    """Of files that can't be read, an empty one."""
    try:
        return READERS.get(kind, lambda _: {})(data)
    except (struct.error, IndexError, ValueError, KeyError, zlib.error, zipfile.BadZipFile, json.JSONDecodeError, RecursionError):
        return {}


SCHEMA = "path string, " + ", ".join(f"{n} string" for n in NAMES)


def records(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, format, content) that say anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.as_py(), record(d.as_py() or b"", k.as_py())) for p, k, d in zip(*(batch.column(i) for i in range(3)), strict=True)]
            rows = [(p, r) for p, r in rows if r]
            if rows:
                columns = [[p for p, _ in rows], *([r.get(n) for _, r in rows] for n in NAMES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", *NAMES])

    return files.select("path", "format", "content").mapInArrow(run, SCHEMA)
