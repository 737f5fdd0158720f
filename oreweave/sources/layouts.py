"""Walkers of formats that are a header of fixed places with samples behind it, or blocks with a plain header each.

A layout names the fields of a header, one after another (fixed values of the published formats); `Header` walks it. Formats
with tables of their own (trackers, banks, sheets) have a function each. Importing this module registers them all.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from oreweave.sources.walkers import chunk, ident, read_fields, register, sized, values


@dataclass
class Header:
    """A header and what follows it: layout by byte order, where the rest starts (a field, or the header's own size), its size."""

    order: str
    layout: list[tuple[str, str]]
    id: str = "header"
    size: int = 0
    start: str = ""
    length: str = ""
    rest: str = "data"

    def walk(self, data: bytes) -> Iterator[dict]:
        fields = read_fields(data, 0, self.layout, self.order)
        known = values(fields)
        size = self.size or struct.calcsize(self.order + "".join(code for _, code in self.layout))
        start = int(known.get(self.start, size)) if self.start else size
        yield chunk(self.id, 0, min(start, len(data)), f"{len(fields)} fields", fields, [] if len(data) >= size else [f"the header has {size} bytes, the file {len(data)}"])
        left = max(0, len(data) - start)
        length = int(known[self.length]) if self.length in known else left
        warnings = [f"{self.rest} claims {length} bytes, {left} are there"] if length > left else []
        if length or left:
            yield chunk(self.rest, start, length, f"{length} bytes", warnings=warnings)
        if left > length:
            yield chunk("tail", start + length, left - length, "bytes after the end", warnings=[f"{left - length} bytes left over"])


TEXT = "32s"
HEADERS: dict[str, Header] = {
    "vag": Header(">", [("magic", "4s"), ("version", "I"), ("reserved", "I"), ("bytes", "I"), ("sample_rate", "I"), ("reserved2", "10s"), ("reserved3", "2s"), ("name", "16s")], "VAGp", 48, length="bytes"),
    "sid": Header(">", [("magic", "4s"), ("version", "H"), ("data_offset", "H"), ("load", "H"), ("init", "H"), ("play", "H"), ("songs", "H"), ("start_song", "H"), ("speed", "I"), ("name", TEXT), ("author", TEXT), ("released", TEXT)], "PSID", 118, "data_offset"),
    "nsf": Header("<", [("magic", "5s"), ("version", "B"), ("songs", "B"), ("start_song", "B"), ("load", "H"), ("init", "H"), ("play", "H"), ("name", TEXT), ("artist", TEXT), ("copyright", TEXT), ("ntsc_speed", "H"), ("banks", "8s"), ("pal_speed", "H"), ("region", "B"), ("chips", "B"), ("reserved", "4s")], "NESM", 128),
    "fxp": Header(">", [("magic", "4s"), ("bytes", "I"), ("kind", "4s"), ("version", "I"), ("plugin", "4s"), ("plugin_version", "I"), ("parameters", "I"), ("name", "28s")], "CcnK", 56),
    "wt": Header("<", [("magic", "4s"), ("wave_size", "I"), ("waves", "H"), ("flags", "H")], "vawt", 12),
    "dmx": Header("<", [("format", "H"), ("sample_rate", "H"), ("samples", "I")], "header", 8, length="samples"),
    "gf1pat": Header("<", [("magic", "12s"), ("id", "10s"), ("description", "60s"), ("instruments", "B"), ("voices", "B"), ("channels", "B"), ("waveforms", "H"), ("volume", "H"), ("bytes", "I"), ("reserved", "36s")], "GF1PATCH", 129),
    "ncw": Header("<", [("magic", "8s"), ("channels", "H"), ("bits_per_sample", "H"), ("sample_rate", "I"), ("samples", "I"), ("block_table", "I"), ("data_offset", "I"), ("bytes", "I")], "NCW", 120),
    "hps": Header(">", [("magic", "8s"), ("sample_rate", "I"), ("channels", "I")], "HALPST", 128),
    "med": Header(">", [("magic", "4s"), ("bytes", "I"), ("song", "I")], "MMD", 12),
    "fc": Header(">", [("magic", "4s"), ("sequence_bytes", "I"), ("patterns", "I"), ("pattern_bytes", "I"), ("frequencies", "I"), ("frequency_bytes", "I"), ("volumes", "I"), ("volume_bytes", "I"), ("samples", "I"), ("waves", "I")], "FC", 180),
    "snd": Header("<", [("magic", "2s"), ("name", "16s"), ("pad", "B"), ("level", "B"), ("tune", "b"), ("stereo", "B"), ("start", "I"), ("loop_end", "I"), ("end", "I"), ("loop", "I"), ("loop_mode", "B"), ("beats", "B"), ("sample_rate", "H")], "SND", 42),
}
for _name, _header in HEADERS.items():
    register(_name)(_header.walk)
register("rsid")(HEADERS["sid"].walk)


@register("adx")
def walk_adx(data: bytes) -> Iterator[dict]:
    fields = read_fields(data, 0, [("magic", "H"), ("data_offset", "H"), ("encoding", "B"), ("block_bytes", "B"), ("bits_per_sample", "B"), ("channels", "B"), ("sample_rate", "I"), ("samples", "I"), ("highpass", "H"), ("version", "B"), ("flags", "B")], ">")
    start = int(values(fields).get("data_offset", 16)) + 4
    signed = data[start - 6 : start] == b"(c)CRI"
    yield chunk("ADX", 0, min(start, len(data)), "header", fields, [] if signed else ["the header does not end with its mark"])
    if len(data) > start:
        yield chunk("data", start, len(data) - start, f"{len(data) - start} bytes")


@register("voc")
def walk_voc(data: bytes) -> Iterator[dict]:
    fields = read_fields(data, 20, [("header_bytes", "H"), ("version", "H"), ("check", "H")], "<")
    known = values(fields)
    right = "check" in known and (int(known["version"]) ^ 0xFFFF) + 0x1234 & 0xFFFF == int(known["check"])
    at = int(known.get("header_bytes", 26))
    yield chunk("VOC", 0, at, "header", fields, [] if right else ["the version check is wrong"])
    names = ["end", "sound", "more", "silence", "marker", "text", "repeat", "endrepeat", "extended", "sound9"]
    while at < len(data):
        kind = data[at]
        if not kind:
            yield chunk("end", at, 0, "terminator")
            at += 1
            break
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        inner = []
        if kind == 1 and at + 6 <= len(data):
            inner = [{"name": "sample_rate", "value": str(1_000_000 // (256 - data[at + 4])), "off": 0, "len": 1}, {"name": "codec", "value": str(data[at + 5]), "off": 1, "len": 1}]
        elif kind == 9:
            inner = read_fields(data, at + 4, [("sample_rate", "I"), ("bits_per_sample", "B"), ("channels", "B"), ("codec", "H")], "<")
        yield chunk(names[kind] if kind < len(names) else f"block{kind}", at, size, f"{size} bytes", inner, ["runs past the end"] if at + 4 + size > len(data) else [])
        at += 4 + size
    if at < len(data):
        yield chunk("tail", at, len(data) - at, "after the terminator", warnings=[f"{len(data) - at} bytes left over"])


@register("caf")
def walk_caf(data: bytes) -> Iterator[dict]:
    yield chunk("caff", 0, 8, "header", read_fields(data, 4, [("version", "H"), ("flags", "H")], ">"))
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">q", data, at + 4)
        name = ident(data[at : at + 4])
        real = len(data) - at - 12 if size < 0 else size
        inner = read_fields(data, at + 12, [("sample_rate", "d"), ("codec", "4s"), ("flags", "I"), ("packet_bytes", "I"), ("packet_frames", "I"), ("channels", "I"), ("bits_per_sample", "I")], ">") if name == "desc" else []
        yield chunk(name, at, real, f"{real} bytes", inner, ["runs past the end"] if at + 12 + real > len(data) else [])
        at += 12 + real


register("nsfe")(lambda data: _marked(data, 4, lambda at: (ident(data[at + 4 : at + 8]), *struct.unpack_from("<I", data, at)), 8))
register("okt")(lambda data: _marked(data, 8, lambda at: (ident(data[at : at + 4]), *struct.unpack_from(">I", data, at + 4)), 8))


def _marked(data: bytes, at: int, head, size: int) -> Iterator[dict]:
    """A magic, then blocks whose name and length head tells."""
    yield chunk(ident(data[:4]), 0, at, "header")
    while at + size <= len(data):
        name, length = head(at)
        yield chunk(name, at, length, f"{length} bytes", warnings=["runs past the end"] if at + size + length > len(data) else [])
        at += size + length


register("smus", "rx2", "akp", "e4b", "e5b", "cat")(lambda data: _iff(data))


def _iff(data: bytes) -> Iterator[dict]:
    order = "<" if data[:4] == b"RIFF" else ">"
    (size,) = struct.unpack_from(order + "I", data, 4)
    yield chunk(ident(data[:4]), 0, size, ident(data[8:12]), [{"name": "form", "value": ident(data[8:12]), "off": 0, "len": 4}], [] if size == len(data) - 8 else [f"the header declares {size} bytes, the file has {len(data) - 8}"])
    yield from sized(data, 12, order, {})


@register("brstm")
def walk_brstm(data: bytes) -> Iterator[dict]:
    order = "<" if data[4:6] == b"\xff\xfe" else ">"
    fields = read_fields(data, 0, [("magic", "4s"), ("mark", "H"), ("version", "H"), ("bytes", "I"), ("header_bytes", "H"), ("sections", "H"), ("head", "I"), ("head_bytes", "I"), ("adpcm", "I"), ("adpcm_bytes", "I"), ("data", "I"), ("data_bytes", "I")], order)
    known = values(fields)
    declared = int(known.get("bytes", 0))
    yield chunk("RSTM", 0, int(known.get("header_bytes", 64)), "header", fields, [] if declared == len(data) else [f"the header declares {declared} bytes, the file has {len(data)}"])
    for name in ("head", "adpcm", "data"):
        at, n = int(known.get(name, 0)), int(known.get(f"{name}_bytes", 0))
        if n:
            yield chunk(ident(data[at : at + 4]) if at + 4 <= len(data) else name, at, n, f"{n} bytes", warnings=["runs past the end"] if at + n > len(data) else [])


@register("midi2")
def walk_midi2(data: bytes) -> Iterator[dict]:
    """Universal packets of one to four words, by the kind in the upper half of the first byte."""
    yield chunk("SMF2CLIP", 0, 8, "marker")
    words = [1, 1, 1, 2, 2, 4, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4]
    at, n, ticks, ended = 8, 0, 0, False
    while at + 4 <= len(data):
        (word,) = struct.unpack_from(">I", data, at)
        if word >> 28 == 0 and word >> 20 & 15 == 4:
            ticks += word & 0xFFFFF
        ended |= word >> 28 == 15 and word >> 16 & 0x3FF == 0x21
        at, n = at + 4 * words[word >> 28], n + 1
    yield chunk("packets", 8, len(data) - 8, f"{n} packets", [{"name": "packets", "value": str(n), "off": 0, "len": 0}, {"name": "ticks", "value": str(ticks), "off": 0, "len": 0}], ([] if ended else ["the clip has no end"]) + ([] if at == len(data) else ["the last packet is cut off"]))


def _field(name: str, value, off: int = 0, size: int = 0) -> dict:
    return {"name": name, "value": str(value), "off": off, "len": size}


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


@register("mod")
def walk_mod(data: bytes) -> Iterator[dict]:
    tag = data[1080:1084]
    digits = re.match(rb"(\d\d?)CH", tag)
    channels = int(digits[1]) if digits else {b"FLT8": 8, b"OCTA": 8, b"CD81": 8}.get(tag, 4)
    orders = data[952 : 952 + 128]
    patterns = max(orders, default=0) + 1
    yield chunk("header", 0, 1084, _text(data[:20]), [_field("title", _text(data[:20]), 0, 20), _field("length", data[950], 950, 1), _field("channels", channels, 1080, 4), _field("patterns", patterns, 952, 128)])
    at = 1084 + patterns * channels * 256
    yield chunk("patterns", 1084, patterns * channels * 256, f"{patterns} patterns", warnings=["runs past the end"] if at > len(data) else [])
    for i in range(31):
        head = data[20 + 30 * i : 50 + 30 * i]
        size, tune, volume, loop, length = struct.unpack(">HBBHH", head[22:30])
        if size:
            yield chunk(f"sample{i + 1}", at, 2 * size, _text(head[:22]), [_field("name", _text(head[:22])), _field("volume", volume), _field("finetune", tune), _field("loop_start", 2 * loop), _field("loop_bytes", 2 * length)], ["runs past the end"] if at + 2 * size > len(data) else [])
            at += 2 * size
    if at < len(data):
        yield chunk("tail", at, len(data) - at, "after the last sample", warnings=[f"{len(data) - at} bytes left over"])


@register("s3m")
def walk_s3m(data: bytes) -> Iterator[dict]:
    orders, instruments, patterns = struct.unpack_from("<3H", data, 32)
    fields = [_field("title", _text(data[:28]), 0, 28), _field("orders", orders, 32, 2), _field("instruments", instruments, 34, 2), _field("patterns", patterns, 36, 2), _field("speed", data[49], 49, 1), _field("tempo", data[50], 50, 1), _field("channels", sum(c < 32 for c in data[64:96]), 64, 32)]
    yield chunk("header", 0, 96 + orders + 2 * (instruments + patterns), _text(data[:28]), fields)
    for i, (para,) in enumerate(struct.iter_unpack("<H", data[96 + orders : 96 + orders + 2 * instruments])):
        at = 16 * para
        if data[at + 76 : at + 80] != b"SCRS" or data[at] != 1:
            continue
        size, rate = struct.unpack_from("<I", data, at + 16)[0], struct.unpack_from("<I", data, at + 32)[0]
        start = 16 * (data[at + 13] << 16 | data[at + 14] | data[at + 15] << 8)
        wide = data[at + 31] & 4
        size = size * (2 if wide else 1) * (2 if data[at + 31] & 2 else 1)
        yield chunk(f"sample{i + 1}", start, size, _text(data[at + 48 : at + 76]), [_field("name", _text(data[at + 48 : at + 76])), _field("sample_rate", rate), _field("bits_per_sample", 16 if wide else 8)], ["runs past the end"] if start + size > len(data) else [])


@register("xm")
def walk_xm(data: bytes) -> Iterator[dict]:
    size, length, _, channels, patterns, instruments, _, speed, tempo = struct.unpack_from("<I8H", data, 60)
    yield chunk("header", 0, 60 + size, _text(data[17:37]), [_field("title", _text(data[17:37]), 17, 20), _field("tracker", _text(data[38:58]), 38, 20), _field("length", length), _field("channels", channels), _field("patterns", patterns), _field("instruments", instruments), _field("speed", speed), _field("tempo", tempo)])
    at = 60 + size
    for i in range(patterns):
        head, _, rows, packed = struct.unpack_from("<IBHH", data, at)
        yield chunk(f"pattern{i}", at, head + packed, f"{rows} rows", warnings=["runs past the end"] if at + head + packed > len(data) else [])
        at += head + packed
    for i in range(instruments):
        (head,) = struct.unpack_from("<I", data, at)
        name, count = _text(data[at + 4 : at + 26]), struct.unpack_from("<H", data, at + 27)[0]
        yield chunk(f"instrument{i + 1}", at, head, name, [_field("name", name), _field("samples", count)])
        at += head
        heads = [data[at + 40 * k : at + 40 * k + 40] for k in range(count)]
        at += 40 * count
        for k, raw in enumerate(heads):
            (n,), wide = struct.unpack_from("<I", raw, 0), raw[14] & 16
            yield chunk(f"sample{i + 1}.{k + 1}", at, n, _text(raw[18:40]), [_field("name", _text(raw[18:40])), _field("bits_per_sample", 16 if wide else 8), _field("note", struct.unpack("b", raw[16:17])[0])], ["runs past the end"] if at + n > len(data) else [])
            at += n
    if at < len(data):
        yield chunk("tail", at, len(data) - at, "after the last sample", warnings=[f"{len(data) - at} bytes left over"])


@register("it")
def walk_it(data: bytes) -> Iterator[dict]:
    orders, instruments, samples, patterns = struct.unpack_from("<4H", data, 32)
    yield chunk("header", 0, 192 + orders + 4 * (instruments + samples + patterns), _text(data[4:30]), [_field("title", _text(data[4:30]), 4, 26), _field("orders", orders), _field("instruments", instruments), _field("samples", samples), _field("patterns", patterns), _field("speed", data[50]), _field("tempo", data[51])])
    table = 192 + orders
    for kind, count, skip in (("instrument", instruments, 0), ("sample", samples, instruments), ("pattern", patterns, instruments + samples)):
        for i, (at,) in enumerate(struct.iter_unpack("<I", data[table + 4 * skip : table + 4 * (skip + count)])):
            if not at:
                continue
            if at + 8 > len(data):
                yield chunk(f"{kind}{i + 1}", at, 0, "", warnings=["starts past the end"])
            elif kind == "sample":
                flags, name = data[at + 18], _text(data[at + 20 : at + 46])
                (n,), (rate,), (start,) = (struct.unpack_from("<I", data, at + k) for k in (48, 60, 72))
                size = n * (2 if flags & 2 else 1) * (2 if flags & 4 else 1)
                packed = bool(flags & 8)
                yield chunk(f"sample{i + 1}", start, 0 if packed else size, name, [_field("name", name), _field("samples", n), _field("sample_rate", rate), _field("bits_per_sample", 16 if flags & 2 else 8), _field("packed", packed), _field("coding", data[at + 46])], ["runs past the end"] if not packed and start + size > len(data) else [])
            elif kind == "pattern":
                n, rows = struct.unpack_from("<HH", data, at)
                yield chunk(f"pattern{i}", at, 8 + n, f"{rows} rows")
            else:
                yield chunk(f"instrument{i + 1}", at, 554, _text(data[at + 32 : at + 58]))


@register("mdx")
def walk_mdx(data: bytes) -> Iterator[dict]:
    end = data.find(b"\r\n\x1a")
    name = data.find(b"\0", end + 3)
    if end < 0 or name < 0:
        raise ValueError("no title")
    title, bank = data[:end].decode("shift_jis", "replace"), data[end + 3 : name].decode("latin-1")
    yield chunk("header", 0, name + 1, title, [_field("title", title, 0, end), _field("bank", bank, end + 3, name - end - 3)])
    base = name + 1
    voices, first = struct.unpack_from(">HH", data, base)
    count = 16 if first >= 2 + 2 * 16 else 9
    for i, (at,) in enumerate(struct.iter_unpack(">H", data[base + 2 : base + 2 + 2 * count])):
        yield chunk(f"channel{i + 1}", base + at, 0, "", warnings=["starts past the end"] if base + at > len(data) else [])
    yield chunk("voices", base + voices, max(0, len(data) - base - voices), "voice data")


@register("sap")
def walk_sap(data: bytes) -> Iterator[dict]:
    end = data.find(b"\xff\xff")
    head = data[: end if end >= 0 else len(data)].decode("latin-1")
    pairs = [line.partition(" ") for line in head.splitlines()[1:] if line.strip()]
    yield chunk("SAP", 0, len(head), "header", [_field(k.lower(), v.strip().strip('"')) for k, _, v in pairs], [] if end >= 0 else ["no binary part"])
    at, n = end + 2 if end >= 0 else len(data), 0
    while at + 4 <= len(data):
        if data[at : at + 2] == b"\xff\xff":
            at += 2
            continue
        start, stop = struct.unpack_from("<HH", data, at)
        size = stop - start + 1
        n += 1
        yield chunk(f"block{n}", at, max(0, size), f"{start:04X}-{stop:04X}", warnings=["runs past the end"] if size < 0 or at + 4 + size > len(data) else [])
        if size <= 0:
            return
        at += 4 + size


@register("cue")
def walk_cue(data: bytes) -> Iterator[dict]:
    """A sheet's files and tracks; an index is minutes, seconds and 75ths."""
    text, at, track, file = data.decode("utf-8-sig", "replace"), 0, None, ""
    for line in text.splitlines(keepends=True):
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if word.upper() == "FILE":
            file = rest.rsplit(" ", 1)[0].strip('"')
            yield chunk("FILE", at, len(line), file, [_field("file", file)])
        elif word.upper() == "TRACK":
            if track:
                yield track
            track = chunk("TRACK", at, len(line), rest, [_field("number", rest.split(" ")[0]), _field("mode", rest.split(" ")[-1]), _field("file", file)])
        elif word.upper() == "INDEX" and track and (m := re.match(r"(\d+)\s+(\d+):(\d+):(\d+)", rest)):
            track["fields"].append(_field(f"index{int(m[1])}", (int(m[2]) * 60 + int(m[3])) * 75 + int(m[4])))
        elif word.upper() in ("TITLE", "PERFORMER") and track:
            track["fields"].append(_field(word.lower(), rest.strip('"')))
        at += len(line.encode())
    if track:
        yield track


@register("gcm")
def walk_gcm(data: bytes) -> Iterator[dict]:
    """A disc's files, by its table of entries and names."""
    table, size = struct.unpack_from(">II", data, 0x424)
    (count,) = struct.unpack_from(">I", data, table + 8)
    yield chunk("disc", 0, 0x440, _text(data[0x20:0x400]), [_field("id", _text(data[:6])), _field("entries", count)])
    names, folders = table + 12 * count, [(count, "")]
    for i in range(1, count):
        word, at, n = struct.unpack_from(">3I", data, table + 12 * i)
        while i >= folders[-1][0]:
            folders.pop()
        start = names + (word & 0xFFFFFF)
        path = folders[-1][1] + data[start : data.index(b"\0", start)].decode("latin-1")
        if word >> 24:
            folders.append((n, path + "/"))
        else:
            yield chunk("file", at, n, path, [_field("path", path)], ["runs past the end"] if at + n > len(data) else [])


SYNC = b"\0" + b"\xff" * 10 + b"\0"


@register("cdxa")
def walk_cdxa(data: bytes) -> Iterator[dict]:
    """Streams of a raw disc image: sectors of one file and channel."""
    base = 44 if data[:4] == b"RIFF" else 0
    found: dict[tuple[int, int], list[int]] = {}
    for at in range(base, len(data) - 2351, 2352):
        if data[at : at + 12] == SYNC and data[at + 18] & 4:
            found.setdefault((data[at + 16], data[at + 17]), []).append(at)
    yield chunk("image", 0, len(data), f"{(len(data) - base) // 2352} sectors")
    for (file, channel), sectors in sorted(found.items(), key=lambda x: x[1][0]):
        coding = data[sectors[0] + 19]
        yield chunk("stream", sectors[0], 2352 * len(sectors), f"file {file} channel {channel}", [_field("file", file), _field("channel", channel), _field("sectors", len(sectors)), _field("channels", 2 if coding & 1 else 1), _field("sample_rate", 18900 if coding & 4 else 37800)])


@register("sigmf", "vital", "json")
def walk_json(data: bytes) -> Iterator[dict]:
    """The first object of a text, its top-level keys, and what follows it."""
    text = data.decode("utf-8", "replace")
    value, end = json.JSONDecoder().raw_decode(text.lstrip("﻿ \t\r\n"))
    lead = len(text) - len(text.lstrip("﻿ \t\r\n"))
    stop = len(text[: lead + end].encode())
    plain = value if isinstance(value, dict) else {}
    yield chunk("object", 0, stop, f"{len(plain)} keys", [_field(k, v if isinstance(v, (str, int, float, bool)) else type(v).__name__) for k, v in plain.items()])
    if data[stop:].strip(b" \t\r\n\0"):
        yield chunk("tail", stop, len(data) - stop, "after the object", warnings=[f"{len(data) - stop} bytes left over"])


@register("als", "alc", "adg", "adv", "agr", "gzip")
def walk_gzip(data: bytes, most: int = 64 << 20) -> Iterator[dict]:
    """Compressed XML: its root, and how often each element occurs; `most` bytes are unpacked."""
    unpacker = zlib.decompressobj(31)
    raw = unpacker.decompress(data, most)
    fields = [_field("unpacked", len(raw))]
    if m := re.search(rb"<([A-Za-z][\w.]*)([^<>]*)>", raw):
        fields += [_field("root", m[1].decode())] + [_field(k.decode(), v.decode("utf-8", "replace")) for k, v in re.findall(rb'([\w.]+)="([^"]*)"', m[2])]
    yield chunk("gzip", 0, len(data) - len(unpacker.unused_data), f"{len(raw)} bytes unpacked", fields, ["more than is unpacked"] if unpacker.unconsumed_tail else [] if unpacker.eof else ["cut off"])
    counts: dict[str, int] = {}
    for name in re.findall(rb"<([A-Za-z][\w.]*)", raw):
        counts[name.decode()] = counts.get(name.decode(), 0) + 1
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        yield chunk(name, 0, 0, f"{n} elements", [_field("elements", n)])
    if unpacker.unused_data:
        yield chunk("tail", len(data) - len(unpacker.unused_data), len(unpacker.unused_data), "after the stream", warnings=[f"{len(unpacker.unused_data)} bytes left over"])


@register("zip", "multisample", "labx", "xpn")
def walk_zip(data: bytes) -> Iterator[dict]:
    """Members by the central directory; local headers are checked against it."""
    end = data.rfind(b"PK\5\6")
    if end < 0 or end + 22 > len(data):
        raise ValueError("no central directory")
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            break
        method, crc, packed, size, n, extra, note, local = (struct.unpack_from(code, data, at + k)[0] for code, k in (("<H", 10), ("<I", 16), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        yield chunk("member", local, packed, name, [_field("name", name), _field("size", size), _field("method", method), _field("crc", f"{crc:08x}")], [] if data[local : local + 4] == b"PK\3\4" else ["no local header"])
        at += 46 + n + extra + note
    yield chunk("directory", end, len(data) - end, f"{count} members")


@register("krz")
def walk_krz(data: bytes) -> Iterator[dict]:
    """Objects of a bank: negative block sizes, then a type, a size and a name each."""
    (start,) = struct.unpack_from(">I", data, 4)
    yield chunk("PRAM", 0, 32, "header", [_field("samples_at", start, 4, 4)])
    at = 32
    while at + 4 <= min(len(data), start):
        (size,) = struct.unpack_from(">i", data, at)
        if size >= 0:
            break
        kind, body, gap = struct.unpack_from(">HHH", data, at + 4)
        name = _text(data[at + 10 : at + 10 + max(0, gap - 2)])
        yield chunk("object", at, -size, name, [_field("name", name), _field("type", kind >> 10), _field("number", kind & 0x3FF), _field("bytes", body)])
        at -= size
    if start < len(data):
        yield chunk("samples", start, len(data) - start, "sample data")


@register("amxd")
def walk_amxd(data: bytes) -> Iterator[dict]:
    yield from sized(data, 0, "<", {}, pad=False)


@register("iq")
def walk_iq(data: bytes) -> Iterator[dict]:
    yield chunk("samples", 0, len(data), f"{len(data) // 8} complex floats", warnings=[] if len(data) % 8 == 0 else ["the last sample is cut off"])


@register("iso")
def walk_iso(data: bytes) -> Iterator[dict]:
    """Files of a disc image, folder by folder; a folder that is listed twice is entered once."""
    sector = 2048
    head = 16 * sector
    if data[head + 1 : head + 6] != b"CD001":
        raise ValueError("no volume descriptor")
    name = data[head + 40 : head + 72].decode("latin-1").strip()
    yield chunk("volume", head, sector, name, [_field("name", name, 40, 32), _field("sectors", struct.unpack_from("<I", data, head + 80)[0], 80, 8)])
    todo, seen = [(*struct.unpack_from("<I4xI", data, head + 158), "")], set()
    while todo:
        start, size, path = todo.pop(0)
        if start in seen:
            continue
        seen.add(start)
        at, end = start * sector, min(len(data), start * sector + size)
        while at + 33 <= end:
            length = data[at]
            if not length:
                # Records do not cross sectors.
                at = (at // sector + 1) * sector
                continue
            where, n = struct.unpack_from("<I4xI", data, at + 2)
            label = data[at + 33 : at + 33 + data[at + 32]]
            if label not in (b"\0", b"\1"):
                full = path + label.decode("latin-1").split(";")[0]
                if data[at + 25] & 2:
                    todo.append((where, n, full + "/"))
                else:
                    yield chunk("file", where * sector, n, full, [_field("path", full)], ["runs past the end"] if where * sector + n > len(data) else [])
            at += length
