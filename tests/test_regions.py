"""Sound in blobs of bytes: containers, frame chains, sample-like windows, chunk chains; and frames and their checksums."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from oreweave.functions import codecs, frames
from oreweave.operators import regions


def wav(samples=2000, size=None, seed=1):
    t = np.arange(samples)
    pcm = (8000 * np.sin(t / 9.0 + seed) + 3000 * np.sin(t / 31.0)).astype("<i2").tobytes()
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    return b"RIFF" + struct.pack("<I", len(body) if size is None else size) + body


def mp3(n, index=9, pad=0):
    head = bytes([0xFF, 0xFB, index << 4 | pad << 1, 0])
    length = frames.mpeg_header(head + bytes(4), 0)["length"]
    r = random.Random(7)
    return b"".join(head + bytes(r.randrange(255) for _ in range(length - 4)) for _ in range(n))


def ogg(serials, last=True):
    page = lambda flags, serial, body: b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<I", serial) + bytes(8) + bytes([1, len(body)]) + body
    out = b"".join(page(2, s, b"begin") for s in serials) + b"".join(page(0, s, b"x" * 60) for s in serials)
    return out + (b"".join(page(4, s, b"end") for s in serials) if last else b"")


def crc(data, polynomial, bits):
    value = 0
    for byte in data:
        value ^= byte << bits - 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value >> bits - 1 & 1 else value << 1) & (1 << bits) - 1
    return value


def flac_frame(number, body):
    head = bytes([0xFF, 0xF8, 0x69, 0x08, number, 63])  # 8-bit block size follows the number
    head += bytes([crc(head, 0x07, 8)])
    return head + body + struct.pack(">H", crc(head + body, 0x8005, 16))


def midi():
    return b"MThd" + struct.pack(">IHHH", 6, 1, 2, 96) + (b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0") * 2


def test_checksums_by_table_are_those_by_bits():
    r = random.Random(2)
    for n in (0, 1, 7, 300):
        data = r.randbytes(n)
        assert codecs.crc8(data) == crc(data, 0x07, 8) and codecs.crc16(data) == crc(data, 0x8005, 16)
        assert codecs.crc16(data[5:], crc=codecs.crc16(data[:5])) == codecs.crc16(data)


def test_mpeg_frames():
    assert frames.mpeg_header(b"\xff\xfb\x90\x00", 0) == {"version": "1", "layer": 3, "rate": 44100, "kbps": 128, "length": 417}
    assert frames.mpeg_header(b"\xff\xfb\xf0\x00", 0) is None and frames.mpeg_header(b"\xff\xe9\x90\x00", 0) is None
    one = mp3(20)
    blob = b"\0" * 333 + one + b"junk" * 50 + mp3(11) + b"\0" * 100 + b"\xff" * 5000
    assert frames.mpeg_streams(blob) == [(333, 333 + len(one), 20)]
    assert frames.mpeg_streams(mp3(12)[:-10]) == [(0, len(mp3(12)) - 10, 12)]
    assert frames.mpeg_streams(b"") == frames.mpeg_streams(b"\xff" * 9000) == []
    assert frames.mpeg_validity(one + b"abc" + one[:100]) == {"frames": 20, "stray": 3, "cut": 1}


def test_flac_frames():
    r = random.Random(6)
    parts = [flac_frame(i, r.randbytes(200)) for i in range(6)]
    data = b"".join(parts)
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    assert frames.flac_frames(data, 0) == [(a, b, "ok") for a, b in zip(ends, ends[1:], strict=False)]
    bad = bytearray(data)
    bad[ends[2] + 50] ^= 1
    assert [s for *_, s in frames.flac_frames(bytes(bad), 0)] == ["ok", "ok", "bad", "ok", "ok", "ok"]
    assert [s for *_, s in frames.flac_frames(data[:-9], 0)][-1] == "unverified"
    assert frames.flac_frames(b"no frames", 0) == []


def test_ogg_streams():
    one, two = ogg([1]), ogg([7, 8])
    blob = b"zz" + one + two + b"tail" + ogg([9], last=False)
    assert frames.ogg_streams(blob) == [(2, 2 + len(one), [1], True), (2 + len(one), 2 + len(one) + len(two), [7, 8], True), (len(blob) - len(ogg([9], False)), len(blob), [9], False)]


def test_locate_containers_and_their_ends():
    parts = [(b"\0" * 5000, None), (wav(), "wav"), (b"\0" * 9000, None), (midi(), "midi"), (b"RIFF1234WAVX", None), (ogg([3]), "ogg"), (mp3(30), "mp3"), (b"\0" * 9000, None)]
    blob, want = b"", []
    for data, kind in parts:
        if kind:
            want.append((kind, len(blob), len(blob) + len(data)))
        blob += data
    got = regions.locate(blob)
    assert [(r["format"], r["offset"], r["end"]) for r in got] == want
    assert [r["kind"] for r in got] == ["container", "container", "container", "stream"]
    # A container in a container is its payload; a size that can't be ends with the sound.
    inner = wav(3000)
    outer = wav(12_000, size=1 << 30) + b"\0" * 40_000 + inner
    got = regions.locate(outer)
    assert [(r["format"], r["declared"]) for r in got] == [("wav", False), ("wav", True)]
    assert abs(got[0]["end"] - len(wav(12_000))) <= regions.WINDOW
    nested = b"RIFF" + struct.pack("<I", 4 + 8 + len(inner)) + b"WAVE" + b"data" + struct.pack("<I", len(inner)) + inner
    assert [(r["offset"], r["end"]) for r in regions.locate(nested)] == [(0, len(nested))]
    for mode in ("strict", "normal", "aggressive"):
        assert regions.locate(b"", mode) == []
    with pytest.raises(ValueError):
        regions.locate(b"", "odd")


def test_locate_bare_samples():
    t = np.arange(40_000)
    pcm = (9000 * np.sin(t / 12.0) + 2000 * np.sin(t / 3.1)).astype("<i2").tobytes()
    noise = np.random.default_rng(2).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    blob = noise + pcm + noise
    found = [r for r in regions.locate(blob) if r["kind"] == "blob"]
    assert len(found) == 1 and abs(found[0]["offset"] - 60_000) <= regions.WINDOW and abs(found[0]["end"] - 60_000 - len(pcm)) <= regions.WINDOW
    assert regions.locate(blob, "strict") == [] and regions.locate(b"plain text, line by line\n" * 9000) == []


def test_resync_finds_chunks_of_both_orders():
    r = random.Random(3)
    grid = lambda order, n: b"".join((f"ck{i:02d}".encode() + struct.pack(order + "I", 30 + i)) + bytes(30 + i + (30 + i) % 2) for i in range(n))
    little, big = grid("<", 5), grid(">", 9)
    blob = r.randbytes(100) + little + r.randbytes(64) + big
    got = regions.resync(blob)
    assert [(x["offset"], x["end"], x["order"]) for x in got if x["chunks"] >= 4] == [(100, 100 + len(little), "little"), (164 + len(little), len(blob), "big")]
    assert regions.resync(b"") == []


def test_regions_of_files_and_stitching(spark):
    files = [("a", b"\0" * 50 + wav()), ("b", b""), ("c", b"text" * 30)]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in files], "file string, data binary")
    got = regions.located(df).collect()
    assert [(r.file, r.format, r.offset, r.declared) for r in got] == [("a", "wav", 50, True)]
    cut = [("x", "blob", None, 900, 1000), ("x", "blob", None, 1000, 1300), ("x", "blob", None, 1310, 1400), ("x", "stream", "mp3", 1990, 2000), ("x", "stream", "mp3", 2004, 2100), ("y", "blob", None, 1, 2)]
    rows = spark.createDataFrame(cut, "file string, kind string, format string, offset long, end long")
    got = sorted((r.file, r.kind, r.offset, r.end, r.parts) for r in regions.stitched(rows, 1000, 8).collect())
    assert got == [("x", "blob", 900, 1300, 2), ("x", "blob", 1310, 1400, 1), ("x", "stream", 1990, 2100, 2), ("y", "blob", 1, 2, 1)]
