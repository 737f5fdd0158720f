"""Walkers, sniffing and file scans on bytes that are built here."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from oreweave.operators import catalogue
from oreweave.sources import sniff, walkers


def riff(*chunks, form=b"WAVE", order="<"):
    body = b"".join(i + struct.pack(order + "I", len(d)) + d + b"\0" * (len(d) % 2) for i, d in chunks)
    return (b"RIFX" if order == ">" else b"RIFF") + struct.pack(order + "I", len(body) + 4) + form + body


FMT = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
WAV = riff((b"fmt ", FMT), (b"odd ", b"abc"), (b"LIST", b"INFO" + b"INAM" + struct.pack("<I", 4) + b"kick"), (b"data", bytes(8)))
MIDI = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 20) + bytes([0, 0xFF, 0x51, 3, 7, 0xA1, 0x20, 0, 0x90, 60, 64, 96, 60, 0, 0, 0xFF, 0x2F, 0, 0, 0])
FLAC = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 1000).to_bytes(8, "big") + bytes(16) + b"frames"
AIFF_BODY = b"COMM" + struct.pack(">IhIhHQ", 18, 1, 10, 16, 16398, 44100 << 48) + b"SSND" + struct.pack(">I", 4) + bytes(4)
AIFF = b"FORM" + struct.pack(">I", len(AIFF_BODY) + 4) + b"AIFF" + AIFF_BODY
MP4 = struct.pack(">I4s", 16, b"ftyp") + b"M4A \0\0\0\0" + struct.pack(">I4sI4s", 16, b"moov", 8, b"trak")
OGG = b"OggS\0\2" + struct.pack("<qIII", 0, 7, 0, 0) + bytes([1, 5]) + b"hello"
AU = b".snd" + struct.pack(">IIIII", 24, 4, 3, 8000, 1) + bytes(4)
ID3 = b"ID3\3\0\0\0\0\0\x0f" + b"TIT2" + struct.pack(">I", 5) + b"\0\0" + b"\0kick" + b"\xff\xfb" + bytes(4)
SAMPLES = {"wav": WAV, "midi": MIDI, "flac": FLAC, "aiff": AIFF, "mp4": MP4, "ogg": OGG, "au": AU, "mp3": ID3}


def ids(kind, data=None):
    return [c["id"] for c in walkers.walk(data or SAMPLES[kind], kind)]


def fields(kind):
    return {f["name"]: f["value"] for c in walkers.walk(SAMPLES[kind], kind) for f in c["fields"]}


def test_walks():
    assert ids("wav") == ["RIFF", "fmt ", "odd ", "LIST", "INFO/INAM", "data"]
    assert fields("wav")["sample_rate"] == "44100" and fields("wav")["text"] == "kick"
    assert ids("midi") == ["MThd", "MTrk"] and fields("midi")["notes"] == "1" and fields("midi")["tempo"] == "120.000"
    assert ids("flac") == ["fLaC", "STREAMINFO", "frames"]
    assert fields("flac") == {"sample_rate": "44100", "channels": "2", "bits_per_sample": "16", "samples": "1000"}
    assert ids("aiff") == ["FORM", "COMM", "SSND"] and fields("aiff")["sample_rate"] == "44100"
    assert ids("mp4") == ["ftyp", "moov", "moov/trak"]
    assert ids("ogg") == ["page"] and fields("ogg")["serial"] == "7"
    assert ids("au") == [".snd", "data"] and fields("au")["sample_rate"] == "8000"
    assert ids("mp3") == ["ID3", "ID3/TIT2", "audio"] and fields("mp3")["text"] == "kick"


def test_warnings():
    warned = lambda data: [w for c in walkers.walk(data, "wav") for w in c["warnings"]]
    assert warned(WAV) == []
    assert any("claims" in w for w in warned(WAV[:-4]))
    assert any("left over" in w for w in warned(WAV + b"xyz"))
    nonzero = WAV.replace(b"abc\0", b"abc\1")
    assert any("pad byte" in w for w in warned(nonzero))


def test_big_endian_and_sixty_four_bit():
    big = riff((b"fmt ", struct.pack(">HHIIHH", 1, 1, 8000, 8000, 1, 8)), order=">")
    assert next(f["value"] for c in walkers.walk(big, "rifx") for f in c["fields"] if f["name"] == "sample_rate") == "8000"
    ds64 = b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, 0, 6, 3, 0) + b"data\xff\xff\xff\xff" + bytes(6)
    assert [(c["id"], c["size"]) for c in walkers.walk(ds64, "rf64")][-1] == ("data", 6)


def test_generic_grid():
    data = b"XYZW" + struct.pack("<I", 24) + b"".join(i + struct.pack("<I", 4) + b"data" for i in (b"aaaa", b"bbbb"))
    assert [c["id"] for c in walkers.walk(data, None)] == ["aaaa", "bbbb"]
    assert walkers.walk(b"no container at all", None) == []


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_mutated_files_never_crash(kind):
    r = random.Random(5)
    for _ in range(150):
        data = bytearray(SAMPLES[kind])
        for _ in range(r.randint(1, 6)):
            data[r.randrange(len(data))] = r.choice((0, 1, 127, 128, 255, r.randrange(256)))
        for part in (bytes(data), bytes(data[: r.randrange(len(data) + 1)])):
            for c in walkers.walk(part, kind):
                assert c["offset"] >= 0 and c["seq"] >= 0


def test_all_chunks_of_a_long_file(spark):
    data = riff((b"fmt ", FMT), *[(b"odd ", b"ab")] * 100_100)
    n = len(walkers.walk(data, "wav"))
    assert n > 100_100
    found = walkers.chunks(spark.createDataFrame([("a.wav", "wav", data)], "path string, format string, content binary"))
    assert [r.seq for r in found.select("seq").orderBy("seq").collect()] == list(range(n))
    assert found.where("size(warnings) > 0").count() == 0


def test_scan_sniff_and_walk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in SAMPLES.items():
        (tmp_path / "sub" / f"f_{name}.bin").write_bytes(data)
    (tmp_path / "._junk").write_bytes(b"x")
    (tmp_path / "desktop.ini").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"plain")
    files = sniff.identified(sniff.scan(spark, str(tmp_path)))
    found = {r.path.rsplit("/", 1)[1]: r.format for r in files.select("path", "format").collect()}
    assert found == {f"f_{n}.bin": n for n in SAMPLES} | {"note.txt": "txt"}
    chunks = walkers.chunks(files)
    counts = {r.format: r["count"] for r in chunks.groupBy("format").count().collect()}
    assert counts["wav"] == 6 and counts["aiff"] == 3
    assert walkers.flat_fields(chunks).where("name = 'sample_rate'").count() == 4
    assert sniff.scan(spark, str(tmp_path), ["TXT"]).count() == 1


def test_range_specs_and_filters(spark):
    assert catalogue.parse_range("120", "bpm") == (120, 120)
    assert catalogue.parse_range(":130", "bpm") == (None, 130)
    for bad in ("", ":", "a:b", "1:2:3"):
        with pytest.raises(ValueError):
            catalogue.parse_range(bad, "bpm")
    df = spark.createDataFrame([("a_b",), ("axb",), (None,), ("100%",)], "path string")
    assert [r.path for r in df.where(catalogue.contains(F.col("path"), "A_B")).collect()] == ["a_b"]
    assert [r.path for r in df.where(catalogue.contains(F.col("path"), "0%")).collect()] == ["100%"]
    with pytest.raises(ValueError):
        catalogue.page(df, -1, F.col("path"))
    assert catalogue.page(df, 0, F.col("path")).count() == 0


def test_sinks(spark, tmp_path):
    from oreweave.sources import sinks

    rows = sinks.union(spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([("b", 2.5)], "y string, z double"))
    assert rows.columns == ["x", "y", "z"]
    for kind in ("csv", "tsv", "json", "parquet"):
        sinks.render(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"x":1,"y":"a"}', '{"y":"b","z":2.5}']
    with pytest.raises(ValueError):
        sinks.render(rows, str(tmp_path / "q"), "nothing")
    files = spark.createDataFrame([("/a/b c.bin", bytearray(b"0123456789"))], "path string, content binary")
    regions = spark.createDataFrame([("/a/b c.bin", 2, 3, "wav"), ("/a/b c.bin", 8, 9, None)], "path string, offset long, length long, kind string")
    assert sorted((r.name, bytes(r.data)) for r in sinks.carve(files, regions).collect()) == [("b_c_00000002.wav", b"234"), ("b_c_00000008.bin", b"89")]
    tags = spark.createDataFrame([("b c.bin", [" x", ""])], "basename string, tags array<string>")
    assert [(r.path, r.tag) for r in sinks.imported_tags(files, tags).collect()] == [("/a/b c.bin", "x")]
