"""Format walkers: a file's bytes to chunks, each with typed fields and warnings.

A walker is a generator over (data, out): it yields chunk dicts. Walkers never read past the data; what doesn't fit
becomes a warning. `register` adds one; `chunks` runs them over a table of files with Arrow batches, so bytes are
parsed where they are read and only chunk rows go on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, format string, seq int, id string, offset long, size long, summary string, fields array<struct<name: string, value: string, off: int, len: int>>, warnings array<string>"
#: Chunk rows in an Arrow batch.
BATCH = 10_000

WALKERS: dict[str, Callable[[bytes], Iterator[dict]]] = {}


def register(*names: str):
    def add(f):
        WALKERS.update(dict.fromkeys(names, f))
        return f

    return add


def chunk(id_: str, offset: int, size: int, summary: str = "", fields: list | None = None, warnings: list | None = None) -> dict:
    return {"id": id_, "offset": offset, "size": size, "summary": summary, "fields": fields or [], "warnings": warnings or []}


def read_fields(data: bytes, base: int, layout: list[tuple[str, str]], order: str) -> list[dict]:
    """Fields of a struct layout [(name, code)] from base; those past the end are left out."""
    out, at = [], 0
    for name, code in layout:
        size = struct.calcsize(order + code)
        if base + at + size > len(data):
            break
        value = struct.unpack_from(order + code, data, base + at)[0]
        out.append({"name": name, "value": value.decode("latin-1").rstrip("\0 ") if isinstance(value, bytes) else str(value), "off": at, "len": size})
        at += size
    return out


def values(fields: list[dict]) -> dict[str, str]:
    return {f["name"]: f["value"] for f in fields}


def ident(raw: bytes) -> str:
    return raw.decode("ascii") if all(32 <= c < 127 for c in raw) else "hex:" + raw.hex()


#: Layouts of chunks whose fields are plain numbers (fixed values of the published formats).
RIFF_LAYOUTS = {
    "fmt ": [("format_tag", "H"), ("channels", "H"), ("sample_rate", "I"), ("byte_rate", "I"), ("block_align", "H"), ("bits_per_sample", "H")],
    "fact": [("samples", "I")],
    "smpl": [("manufacturer", "I"), ("product", "I"), ("sample_period", "I"), ("unity_note", "I"), ("pitch_fraction", "I"), ("smpte_format", "I"), ("smpte_offset", "I"), ("loops", "I"), ("sampler_data", "I")],
    "inst": [("base_note", "B"), ("fine_tune", "b"), ("gain", "b"), ("low_note", "B"), ("high_note", "B"), ("low_velocity", "B"), ("high_velocity", "B")],
    "acid": [("flags", "I"), ("root_note", "H"), ("unknown1", "H"), ("unknown2", "f"), ("beats", "I"), ("meter_denominator", "H"), ("meter_numerator", "H"), ("tempo", "f")],
    "cue ": [("points", "I")],
    "bext": [("description", "256s"), ("originator", "32s"), ("reference", "32s"), ("date", "10s"), ("time", "8s"), ("time_low", "I"), ("time_high", "I"), ("version", "H")],
}
AIFF_LAYOUTS = {
    "COMM": [("channels", "h"), ("frames", "I"), ("bits_per_sample", "h"), ("rate_exponent", "H"), ("rate_mantissa", "Q")],
    "INST": [("base_note", "b"), ("detune", "b"), ("low_note", "b"), ("high_note", "b"), ("low_velocity", "b"), ("high_velocity", "b"), ("gain", "h")],
    "VHDR": [("one_shot", "I"), ("repeat", "I"), ("samples_per_cycle", "I"), ("rate", "H"), ("octaves", "B"), ("compression", "B"), ("volume", "I")],
    "FVER": [("timestamp", "I")],
}


def sized(data: bytes, start: int, order: str, layouts: dict, end: int | None = None, sizes: dict[str, int] | None = None, pad: bool = True) -> Iterator[dict]:
    """Chunks [id][u32 size][payload] from start, odd ones with a pad byte."""
    at, end = start, len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        name, (size,) = ident(data[at : at + 4]), struct.unpack_from(order + "I", data, at + 4)
        if size == 0xFFFFFFFF and sizes and name in sizes:
            size = sizes[name]
        warnings = []
        if at + 8 + size > end:
            warnings.append(f"{name} claims {size} bytes, {end - at - 8} are there")
        after, odd = at + 8 + size, size % 2 if pad else 0
        if odd and after < end and data[after]:
            warnings.append(f"pad byte after {name} is not zero")
        yield chunk(name, at, size, f"{size} bytes", read_fields(data[: at + 8 + size], at + 8, layouts.get(name, []), order), warnings)
        at = after + odd
    if at < end:
        yield chunk("tail", at, end - at, "bytes after the last chunk", warnings=[f"{end - at} bytes left over"])


@register("wav", "rf64", "rifx", "riff", "avi", "sf2", "rmid")
def walk_riff(data: bytes) -> Iterator[dict]:
    order = ">" if data[:4] == b"RIFX" else "<"
    sizes = {}
    if data[:4] == b"RF64" and data[12:16] == b"ds64" and len(data) >= 36:
        sizes["data"] = struct.unpack_from("<Q", data, 28)[0]
    (declared,) = struct.unpack_from(order + "I", data, 4)
    warnings = [] if declared in (len(data) - 8, 0xFFFFFFFF) else [f"the header declares {declared} bytes, the file has {len(data) - 8}"]
    yield chunk(ident(data[:4]), 0, declared, ident(data[8:12]), [{"name": "form", "value": ident(data[8:12]), "off": 0, "len": 4}], warnings)
    for c in sized(data, 12, order, RIFF_LAYOUTS, sizes=sizes):
        if c["id"] == "LIST" and c["size"] >= 4:
            c["fields"].append({"name": "form", "value": ident(data[c["offset"] + 8 : c["offset"] + 12]), "off": 0, "len": 4})
        yield c
        if c["id"] == "LIST" and c["size"] >= 4 and data[c["offset"] + 8 : c["offset"] + 12] == b"INFO":
            for x in sized(data, c["offset"] + 12, order, {}, c["offset"] + 8 + c["size"]):
                text = data[x["offset"] + 8 : x["offset"] + 8 + x["size"]].split(b"\0")[0].decode("utf-8", "replace")
                yield x | {"id": "INFO/" + x["id"], "summary": text, "fields": [{"name": "text", "value": text, "off": 0, "len": x["size"]}]}


@register("aiff", "aifc", "8svx", "iff")
def walk_iff(data: bytes) -> Iterator[dict]:
    (declared,) = struct.unpack_from(">I", data, 4)
    yield chunk("FORM", 0, declared, ident(data[8:12]), [{"name": "form", "value": ident(data[8:12]), "off": 0, "len": 4}], [] if declared == len(data) - 8 else [f"the header declares {declared} bytes, the file has {len(data) - 8}"])
    for c in sized(data, 12, ">", AIFF_LAYOUTS):
        known = values(c["fields"])
        if c["id"] == "COMM" and "rate_mantissa" in known:
            # 80-bit extended number: sign and exponent, then a 64-bit mantissa.
            power = int(known["rate_exponent"]) - 16383
            rate = int(known["rate_mantissa"]) * 2.0 ** (power - 63) if 0 <= power < 64 else 0.0
            c["fields"].append({"name": "sample_rate", "value": f"{rate:g}", "off": 8, "len": 10})
        yield c


def varlen(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place after it."""
    value = 0
    for i in range(4):
        if at + i >= len(data):
            return value, at + i
        value = value << 7 | data[at + i] & 0x7F
        if data[at + i] < 0x80:
            return value, at + i + 1
    return value, at + 4


@register("midi")
def walk_midi(data: bytes) -> Iterator[dict]:
    for c in _plain(data, 0, ">"):
        if c["id"] == "MThd":
            c["fields"] = read_fields(data, c["offset"] + 8, [("format", "H"), ("tracks", "H"), ("division", "H")], ">")
        elif c["id"] == "MTrk":
            c |= _track(data, c["offset"] + 8, min(len(data), c["offset"] + 8 + c["size"]))
        yield c


def _plain(data: bytes, at: int, order: str) -> Iterator[dict]:
    """Chunks without pad bytes."""
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(order + "I", data, at + 4)
        short = at + 8 + size > len(data)
        yield chunk(ident(data[at : at + 4]), at, size, f"{size} bytes", warnings=["runs past the end"] if short else [])
        at += 8 + size


def _track(data: bytes, at: int, end: int) -> dict:
    ticks = notes = events = status = 0
    tempo, name = None, ""
    while at < end:
        delta, at = varlen(data, at)
        ticks += delta
        if at >= end:
            break
        if data[at] >= 0x80:
            status, at = data[at], at + 1
        events += 1
        if status == 0xFF and at < end:
            kind = data[at]
            size, at = varlen(data, at + 1)
            if kind == 0x51 and size == 3 and tempo is None:
                tempo = 60_000_000 / max(1, int.from_bytes(data[at : at + 3], "big"))
            elif kind == 0x03:
                name = data[at : at + size].decode("latin-1")
            at += size
        elif status in (0xF0, 0xF7):
            size, at = varlen(data, at)
            at += size
        elif status:
            notes += status & 0xF0 == 0x90 and at + 1 < end and data[at + 1] > 0
            at += 1 if status & 0xE0 == 0xC0 else 2
        else:
            at += 1
    fields = [("events", events), ("notes", notes), ("ticks", ticks)] + ([("tempo", f"{tempo:.3f}")] if tempo else []) + ([("name", name)] if name else [])
    return {"summary": f"{notes} notes", "fields": [{"name": k, "value": str(v), "off": 0, "len": 0} for k, v in fields]}


FLAC_BLOCKS = ["STREAMINFO", "PADDING", "APPLICATION", "SEEKTABLE", "VORBIS_COMMENT", "CUESHEET", "PICTURE"]


@register("flac")
def walk_flac(data: bytes) -> Iterator[dict]:
    yield chunk("fLaC", 0, 4, "marker")
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = data[at] >= 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        name = FLAC_BLOCKS[kind] if kind < len(FLAC_BLOCKS) else f"block{kind}"
        fields = []
        if name == "STREAMINFO" and at + 22 <= len(data):
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            facts = [("sample_rate", packed >> 44), ("channels", (packed >> 41 & 7) + 1), ("bits_per_sample", (packed >> 36 & 31) + 1), ("samples", packed & (1 << 36) - 1)]
            fields = [{"name": k, "value": str(v), "off": 10, "len": 8} for k, v in facts]
        elif name == "VORBIS_COMMENT":
            fields = _comments(data[at + 4 : at + 4 + size])
        yield chunk(name, at, size, f"{size} bytes", fields, ["runs past the end"] if at + 4 + size > len(data) else [])
        at += 4 + size
    if at < len(data):
        yield chunk("frames", at, len(data) - at, "audio frames")


def _comments(block: bytes) -> list[dict]:
    out: list[dict] = []
    try:
        (n,) = struct.unpack_from("<I", block, 0)
        at = 4 + n
        (count,) = struct.unpack_from("<I", block, at)
        at += 4
        for _ in range(count):
            (n,) = struct.unpack_from("<I", block, at)
            key, _, value = block[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
            out.append({"name": key.lower(), "value": value, "off": at, "len": n})
            at += 4 + n
    except struct.error:
        pass
    return out


@register("ogg")
def walk_ogg(data: bytes) -> Iterator[dict]:
    at = 0
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        segments = data[at + 26]
        size = 27 + segments + sum(data[at + 27 : at + 27 + segments])
        yield chunk("page", at, size, f"{segments} segments", read_fields(data, at + 5, [("flags", "B"), ("granule", "q"), ("serial", "I"), ("sequence", "I"), ("crc", "I")], "<"), ["runs past the end"] if at + size > len(data) else [])
        at += size
    if at < len(data):
        yield chunk("tail", at, len(data) - at, "no page", warnings=["bytes that are no page"])


@register("au")
def walk_au(data: bytes) -> Iterator[dict]:
    fields = read_fields(data, 4, [("data_offset", "I"), ("data_size", "I"), ("encoding", "I"), ("sample_rate", "I"), ("channels", "I")], ">")
    start = int(fields[0]["value"]) if fields else 24
    yield chunk(".snd", 0, start, "header", fields)
    yield chunk("data", start, max(0, len(data) - start), "samples", warnings=["starts past the end"] if start > len(data) else [])


@register("mp4")
def walk_mp4(data: bytes) -> Iterator[dict]:
    yield from _boxes(data, 0, len(data), "")


def _boxes(data: bytes, at: int, end: int, above: str) -> Iterator[dict]:
    while at + 8 <= end:
        (size,) = struct.unpack_from(">I", data, at)
        name, head = ident(data[at + 4 : at + 8]), 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        size = size or end - at
        warnings = [f"{name} runs past its parent"] if at + size > end else []
        yield chunk(above + name, at, size, f"{size} bytes", warnings=warnings)
        if size < head:
            return
        if name in ("moov", "trak", "mdia", "minf", "stbl", "udta", "edts", "moof", "traf"):
            yield from _boxes(data, at + head, min(end, at + size), f"{above}{name}/")
        at += size


@register("mp3")
def walk_mp3(data: bytes) -> Iterator[dict]:
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(data[6:10]))
        yield chunk("ID3", 0, 10 + size, f"version 2.{data[3]}")
        at = 10
        while at + 10 <= min(len(data), 10 + size) and data[at]:
            raw = data[at + 4 : at + 8]
            n = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(raw)) if data[3] >= 4 else int.from_bytes(raw, "big")
            body = data[at + 10 : at + 10 + n]
            text = body[1:].decode("utf-16" if body[:1] in (b"\1", b"\2") else "utf-8", "replace").rstrip("\0") if data[at : at + 1] == b"T" else ""
            yield chunk("ID3/" + ident(data[at : at + 4]), at, n, text, [{"name": "text", "value": text, "off": 1, "len": n}] if text else [])
            at += 10 + n
        at = 10 + size
    if at < len(data):
        yield chunk("audio", at, len(data) - at, "frames")


#: Chunks that make a grid, and bytes by which its end may miss that of the file.
LEAST_CHUNKS, SLACK = 2, 3


def _steps(data: bytes, at: int, order: str) -> tuple[list[tuple[int, int]], int]:
    """(place, size) of chunks with printable ids, one after another without pad bytes, and where they end."""
    out = []
    while at + 8 <= len(data) and all(32 <= c < 127 for c in data[at : at + 4]):
        (size,) = struct.unpack_from(order + "I", data, at + 4)
        if not size or at + 8 + size > len(data):
            break
        out.append((at, size))
        at += 8 + size
    return out, at


def generic(data: bytes) -> Iterator[dict]:
    """Of unknown containers, the chunk grid that follows best: of either byte order, from byte 8 or 12.

    A grid counts if it ends with the file, or if the size behind the magic is the file's. Each chunk is a point, an end
    with the file five and a right size three; of equals the earlier start and the big-endian one wins.
    """
    if len(data) < 12 or not all(32 <= c < 127 for c in data[:4]):
        return
    wrapped = min(abs(struct.unpack_from(order + "I", data, 4)[0] + 8 - len(data)) for order in "<>") <= SLACK
    grids = []
    for n, (start, order) in enumerate(((8, ">"), (8, "<"), (12, ">"), (12, "<"))):
        steps, end = _steps(data, start, order)
        tiled = len(data) - end <= SLACK
        if len(steps) >= LEAST_CHUNKS and (tiled or wrapped):
            grids.append((len(steps) + 5 * tiled + 3 * wrapped, -n, steps))
    for at, size in max(grids, default=(0, 0, []))[2]:
        yield chunk(data[at : at + 4].decode(), at, size, "by its grid")


def forced(data: bytes) -> list[tuple[str, list[dict]]]:
    """Every walker's chunks, whatever the magic number says; walkers that find nothing are left out.

    Walkers whose magic numbers are there come first, the longest before others; then chunks without complaint and their fields count, less complaints.
    """
    from oreweave.sources import sniff

    out = []
    for kind in sorted(WALKERS):
        found = walk(data, kind)
        good = [c for c in found if c["id"] not in ("error", "tail") and not c["warnings"] and c["offset"] + c["size"] <= len(data)]
        if good:
            marked = max((sum(map(len, tests[1::2])) for name, *tests in sniff.MAGICS if name == kind and all(data[at : at + len(raw)] == raw for at, raw in zip(tests[::2], tests[1::2], strict=True))), default=0)
            points = sum(1 + len(c["fields"]) for c in good) - 4 * sum(len(c["warnings"]) for c in found)
            out.append((marked, points, kind, found))
    out.sort(key=lambda x: (-x[0], -x[1], x[2]))
    return [(kind, found) for _, _, kind, found in out]


def forced_walks(files: DataFrame, most: int = 3) -> DataFrame:
    """path, place, format, chunks, complaints: the best walkers of each file (path, content)."""
    names = ["path", "place", "format", "chunks", "complaints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for place, (kind, found) in enumerate(forced(data.as_py() or b"")[:most]):
                    rows.append((path, place, kind, len(found), sum(len(c["warnings"]) for c in found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, place int, format string, chunks long, complaints long")


def walked(data: bytes, kind: str | None) -> Iterator[dict]:
    """All chunks, numbered, one at a time; a walker that fails leaves what it found and a warning."""
    seq = 0
    try:
        for c in WALKERS.get(kind, generic)(data):
            yield c | {"seq": seq}
            seq += 1
    except (struct.error, IndexError, ValueError, RecursionError, zlib.error, OverflowError) as e:
        yield chunk("error", 0, 0, "", warnings=[f"walker stopped: {e}"]) | {"seq": seq}


def walk(data: bytes, kind: str | None) -> list[dict]:
    return list(walked(data, kind))


def chunks(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, format, content)."""
    kinds = pa.schema([("path", pa.string()), ("format", pa.string()), ("seq", pa.int32()), ("id", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("summary", pa.string()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("off", pa.int32()), ("len", pa.int32())]))), ("warnings", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows = ({"path": path.as_py(), "format": kind.as_py(), **c} for c in walked(data.as_py() or b"", kind.as_py()))
                while part := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_pylist(part, schema=kinds)

    return files.select("path", "format", "content").mapInArrow(run, SCHEMA)


def flat_fields(found: DataFrame) -> DataFrame:
    """path, seq, id, name, value of every field."""
    return found.select("path", "seq", "id", F.explode("fields").alias("f")).select("path", "seq", "id", "f.name", "f.value")


# At the end, as it takes names from here and registers its walkers.
from oreweave.sources import layouts  # noqa: E402, F401
