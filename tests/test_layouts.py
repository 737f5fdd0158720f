"""Walkers of plain layouts, trackers and containers, on files made here; sniffing beyond the magic number."""

from __future__ import annotations

import gzip
import io
import json
import random
import struct
import zipfile

import pytest

from oreweave.sources import layouts, sniff, walkers  # noqa: F401


def fields(c):
    return {f["name"]: f["value"] for f in c["fields"]}


def rows(data, kind):
    return [(c["id"], c["offset"], c["size"], len(c["warnings"])) for c in walkers.walk(data, kind)]


def mod(patterns=2, sizes=(10, 0, 7)):
    heads = b"".join(struct.pack(">22sHBBHH", f"smp {i}".encode(), n, 0, 64, 0, 1) for i, n in enumerate([*sizes, *[0] * (31 - len(sizes))]))
    orders = bytes([*range(patterns)]).ljust(128, b"\0")
    return b"title".ljust(20, b"\0") + heads + bytes([patterns, 127]) + orders + b"M.K." + bytes(1024 * patterns) + b"".join(bytes([i + 1]) * 2 * n for i, n in enumerate(sizes))


def xm():
    head = struct.pack("<I8H", 20 + 256, 1, 0, 4, 1, 1, 1, 6, 125) + bytes(256)
    pattern = struct.pack("<IBHH", 9, 0, 64, 5) + bytes(5)
    sample = struct.pack("<IIIBbBBbB22s", 6, 0, 0, 64, 0, 16, 128, -3, 0, b"kick")
    instrument = struct.pack("<I22sBHI", 33, b"drum", 0, 1, 40) + sample + b"\1\2\3\4\5\6"
    return b"Extended Module: " + b"song".ljust(20) + b"\x1a" + b"tracker".ljust(20) + struct.pack("<H", 0x104) + head[:60 + 0] + head[60:] + pattern + instrument


def it():
    head = b"IMPM" + b"song".ljust(26, b"\0") + struct.pack("<H4H", 0, 2, 0, 1, 1) + bytes(10) + bytes([6, 125]) + bytes(140)
    head = head[:192].ljust(192, b"\0")
    sample_at = 192 + 2 + 8
    pattern_at = sample_at + 80
    data_at = pattern_at + 8 + 3
    sample = (b"IMPS" + bytes(13) + bytes([64, 3, 64]) + b"snare".ljust(26, b"\0") + bytes(2)).ljust(48, b"\0") + struct.pack("<4I", 4, 0, 0, 22050)[:16] + bytes(8) + struct.pack("<I", data_at) + bytes(4)
    return head + b"\0\xff" + struct.pack("<2I", sample_at, pattern_at) + sample + struct.pack("<HH4x", 3, 64) + b"abc" + bytes(8)


def voc():
    block = bytes([1]) + (12).to_bytes(3, "little") + bytes([166, 0]) + bytes(10)
    return b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x010A, (~0x010A + 0x1234) & 0xFFFF) + block + b"\0"


def caf():
    desc = struct.pack(">d4s5I", 44100.0, b"lpcm", 0, 4, 1, 2, 16)
    return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">q", -1) + bytes(40)


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, "x" * 100)
    return out.getvalue()


def test_trackers():
    got = walkers.walk(mod(), "mod")
    assert [(c["id"], c["offset"], c["size"]) for c in got] == [("header", 0, 1084), ("patterns", 1084, 2048), ("sample1", 3132, 20), ("sample3", 3152, 14)]
    assert fields(got[0])["channels"] == "4" and fields(got[2])["name"] == "smp 0" and not any(c["warnings"] for c in got)
    assert walkers.walk(mod()[:-3], "mod")[-1]["warnings"]
    got = walkers.walk(xm(), "xm")
    assert [c["id"] for c in got] == ["header", "pattern0", "instrument1", "sample1.1"] and fields(got[3]) == {"name": "kick", "bits_per_sample": "16", "note": "-3"}
    assert got[-1]["offset"] + got[-1]["size"] == len(xm()) and not got[-1]["warnings"]
    got = walkers.walk(it(), "it")
    assert [c["id"] for c in got] == ["header", "sample1", "pattern0"] and fields(got[1])["sample_rate"] == "22050" and (got[1]["offset"], got[1]["size"]) == (len(it()) - 8, 8)


def test_blocks():
    assert rows(voc(), "voc") == [("VOC", 0, 26, 0), ("sound", 26, 12, 0), ("end", 42, 0, 0)]
    assert fields(walkers.walk(voc(), "voc")[1])["sample_rate"] == "11111"
    got = walkers.walk(caf(), "caf")
    assert [(c["id"], c["size"]) for c in got] == [("caff", 8), ("desc", 32), ("data", 40)] and fields(got[1])["sample_rate"] == "44100.0"
    nsfe = b"NSFE" + struct.pack("<I4s", 3, b"INFO") + b"abc" + struct.pack("<I4s", 0, b"NEND")
    assert rows(nsfe, "nsfe") == [("NSFE", 0, 4, 0), ("INFO", 4, 3, 0), ("NEND", 15, 0, 0)]
    okt = b"OKTASONG" + b"CMOD" + struct.pack(">I", 8) + bytes(8)
    assert rows(okt, "okt") == [("OKTA", 0, 8, 0), ("CMOD", 8, 8, 0)]
    clip = b"SMF2CLIP" + struct.pack(">4I", 0x00400060, 0x20903C40, 0x40903C00, 0x80000000) + struct.pack(">4I", 0xF0210000, 0, 0, 0)
    assert fields(walkers.walk(clip, "midi2")[1]) == {"packets": "4", "ticks": "96"} and not walkers.walk(clip, "midi2")[1]["warnings"]


def test_headers():
    vag = b"VAGp" + struct.pack(">III", 0x20, 0, 32) + struct.pack(">I", 22050) + bytes(12) + b"loop".ljust(16, b"\0") + bytes(32)
    got = walkers.walk(vag, "vag")
    assert [(c["id"], c["offset"], c["size"]) for c in got] == [("VAGp", 0, 48), ("data", 48, 32)] and fields(got[0])["name"] == "loop" and fields(got[0])["sample_rate"] == "22050"
    assert walkers.walk(vag[:-5], "vag")[1]["warnings"] and walkers.walk(vag + b"zz", "vag")[2]["id"] == "tail"
    sid = b"PSID" + struct.pack(">7HI", 2, 0x7C, 0x1000, 0x1000, 0x1003, 3, 1, 0) + b"tune".ljust(32, b"\0") + b"who".ljust(32, b"\0") + b"1987".ljust(32, b"\0") + bytes(6) + bytes(50)
    got = walkers.walk(sid, "sid")
    assert fields(got[0])["author"] == "who" and (got[1]["offset"], got[1]["size"]) == (0x7C, 50)
    adx = struct.pack(">HHBBBBIIHBB", 0x8000, 26, 3, 18, 4, 1, 44100, 64, 500, 4, 0) + bytes(4) + b"(c)CRI" + bytes(36)
    got = walkers.walk(adx, "adx")
    assert not got[0]["warnings"] and (got[1]["offset"], got[1]["size"]) == (30, 36)
    dmx = struct.pack("<HHI", 3, 11025, 20) + bytes(20)
    assert rows(dmx, "dmx") == [("header", 0, 8, 0), ("data", 8, 20, 0)]


def test_sheets_and_packed_files():
    sheet = b'FILE "a b.bin" BINARY\r\n  TRACK 01 AUDIO\r\n    TITLE "one"\r\n    INDEX 01 00:02:10\r\n  TRACK 02 AUDIO\r\n    INDEX 01 03:00:00\r\n'
    got = walkers.walk(sheet, "cue")
    assert [c["id"] for c in got] == ["FILE", "TRACK", "TRACK"] and fields(got[1])["index1"] == "160" and fields(got[2])["index1"] == "13500" and fields(got[1])["file"] == "a b.bin"
    live = gzip.compress(b'<?xml version="1.0"?><Ableton MajorVersion="5" Creator="x"><Track/><Track/></Ableton>')
    got = walkers.walk(live, "als")
    assert fields(got[0])["root"] == "Ableton" and fields(got[0])["MajorVersion"] == "5" and got[1]["id"] == "Track"
    assert walkers.walk(live[:-8] + b"", "als")[0]["warnings"] and walkers.walk(live + b"more", "als")[-1]["id"] == "tail"
    got = walkers.walk(zipped("a.wav", "multisample.xml"), "zip")
    assert [c["summary"] for c in got] == ["a.wav", "multisample.xml", "2 members"] and not any(c["warnings"] for c in got)
    preset = json.dumps({"author": "é", "settings": {"a": 1}}).encode() + b"\nextra"
    got = walkers.walk(preset, "vital")
    assert fields(got[0]) == {"author": "é", "settings": "dict"} and got[1]["warnings"]


def iso():
    """A volume with a file, a folder with a file, and a folder that lists the first one again."""
    def entry(name, where, size, folder=False):
        n = 33 + len(name) + (len(name) + 1) % 2
        return (bytes([n, 0]) + struct.pack("<I", where) + struct.pack(">I", where) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([2 * folder]) + bytes(6) + bytes([len(name)]) + name).ljust(n, b"\0")

    root = entry(b"\0", 18, 2048, True) + entry(b"\1", 18, 2048, True) + entry(b"A.WAV;1", 20, 100) + entry(b"SUB", 19, 2048, True)
    sub = entry(b"\0", 19, 2048, True) + entry(b"B.TXT;1", 21, 5) + entry(b"LOOP", 18, 2048, True)
    head = (b"\1CD001\1".ljust(40, b"\0") + b"DISC".ljust(32) + bytes(8) + struct.pack("<I", 22)).ljust(156, b"\0") + entry(b"\0", 18, 2048, True)
    return b"".join([bytes(16 * 2048), head.ljust(2048, b"\0"), bytes(2048), root.ljust(2048, b"\0"), sub.ljust(2048, b"\0"), b"RIFF".ljust(2048, b"\0"), b"hello"])


def test_disc_images():
    got = walkers.walk(iso(), "iso")
    assert [(c["id"], c["summary"], c["offset"], c["size"]) for c in got[1:]] == [("file", "A.WAV", 20 * 2048, 100), ("file", "SUB/B.TXT", 21 * 2048, 5)]
    assert got[0]["summary"] == "DISC" and fields(got[0])["sectors"] == "22" and not any(c["warnings"] for c in got)
    assert walkers.walk(iso()[:-3], "iso")[-1]["warnings"] and walkers.walk(b"no", "iso")[0]["id"] == "error"
    assert sniff.deep(iso(), "x.bin", None) == "iso"


def test_capabilities(spark):
    from oreweave.sources import capabilities

    rows = {r["format"]: r for r in capabilities.capabilities(spark).collect()}
    assert rows["wav"].sniffed and rows["wav"].walked and rows["wav"].extracted and rows["wav"].tagged and rows["wav"].described and rows["wav"].checked
    assert rows["png"].sniffed and not rows["png"].walked and sum(r.walked for r in rows.values()) == len(walkers.WALKERS) >= 68


def test_walkers_survive_anything():
    """Cut off, shuffled and random bytes give chunks or a warning, never an error."""
    r = random.Random(1)
    seeds = [mod(), xm(), it(), voc(), caf(), zipped("a", "b")]
    for kind in walkers.WALKERS:
        for data in (b"", b"\0", b"RIFF", *seeds, *(s[: r.randrange(len(s))] for s in seeds), *(r.randbytes(r.randrange(400)) for _ in range(20)), *(bytes(b ^ (r.random() < 0.02) * 255 for b in s) for s in seeds)):
            assert all(set(c) == {"id", "offset", "size", "summary", "fields", "warnings", "seq"} for c in walkers.walk(data, kind)), kind
    assert walkers.walk(b"moov" * 20_000, "mp4")


def test_forced_walk_prefers_the_walker_that_fits():
    for kind, data in (("mod", mod()), ("voc", voc()), ("caf", caf())):
        assert walkers.forced(data)[0][0] == kind


@pytest.mark.parametrize("spread", [1, 3])
def test_sniffing_again(spark, spread):
    frame = lambda n: (b"\xff\xfb\x90\x00" + bytes(413)) * n
    files = {
        "a.mp3": (frame(2), "mp3"), "utf16.txt": (b"\xff\xfe" + "text".encode("utf-16-le"), None), "one.mp3": (frame(1)[:300], None), "tag.mp3": (b"ID3\4\0\0\0\0\0\4abcdfLaC", "id3-wrapped"), "b.mp3": (b"ID3\4\0\0\0\0\0\4abcd\xff\xfb", "mp3"),
        "x.zip": (zipped("multisample.xml"), "multisample"), "y.zip": (zipped("other"), "zip"), "s.alc": (gzip.compress(b"<Ableton/>"), "alc"), "t.gz": (gzip.compress(b"text"), "gzip"),
        "m": (mod()[:1080] + b"8CHN" + bytes(99), "mod"), "d": (struct.pack("<HHI", 3, 11025, 4) + bytes(4), "dmx"), "c.cue": (b'REM x\r\nFILE "a" WAVE\r\n', "cue"), "p.vital": (b' {"a": 1}', "vital"), "w.wav": (b"RIFF\0\0\0\0WAVE", "wav"), "none": (b"", None), "null": (None, None),
        "s.adx": (struct.pack(">HH", 0x8000, 26) + bytes(20) + b"(c)CRI" + bytes(9), "adx"),
    }
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, (c, _) in files.items()], "path string, content binary").repartition(spread)
    assert {r.path: r.format for r in sniff.sniffed(df).collect()} == {p: k for p, (_, k) in files.items()}
