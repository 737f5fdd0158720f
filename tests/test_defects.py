"""Every rule on a file that breaks it, and on one that doesn't."""

from __future__ import annotations

import json
import random
import struct

from oreweave.sources import defects
from tests.test_regions import flac_frame, midi, mp3, ogg, wav


def riff(*chunks, size=None):
    body = b"WAVE" + b"".join(i + struct.pack("<I", len(d)) + d + (pad if len(d) % 2 else b"") for i, d, pad in chunks)
    return b"RIFF" + struct.pack("<I", len(body) if size is None else size) + body


FMT = (b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16), b"\0")
NOISE = random.Random(1).randbytes(400)
DATA = (b"data", NOISE, b"\0")


def rules(data, kind):
    return {(r, o) for _, o, r, _ in defects.findings(data, kind)}


def id3(*frames_, padding=b"", rest=b""):
    body = b"".join(n + struct.pack(">I", len(d)) + b"\0\0" + d for n, d in frames_) + padding
    size = len(body)
    return b"ID3\3\0\0" + bytes(size >> 7 * (3 - i) & 127 for i in range(4)) + body + rest


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def test_clean_files_have_no_findings():
    for data, kind in ((riff(FMT, DATA), "wav"), (wav(), "wav"), (midi(), "midi"), (ogg([1]), "ogg"), (id3((b"TIT2", b"\0a"), padding=bytes(20), rest=mp3(3)), "mp3"), (b"", None), (b"text", None)):
        assert defects.findings(data, kind) == [], kind


def test_riff_rules():
    clean = riff(FMT, DATA)
    n = len(clean)
    assert rules(clean + b"extra!", "wav") >= {("trailing_data", n)}
    assert rules(clean + b"PK\3\4zip", "wav") >= {("polyglot", n), ("trailing_data", n)}
    end = b"PK\5\6" + bytes(18)
    assert rules(clean + end, "wav") >= {("polyglot", n)}
    assert rules(riff(FMT, (b"note", b"hello", b"A"), DATA), "wav") >= {("nonzero_pad", 12 + 24 + 8 + 5)}
    assert rules(riff(FMT, (b"fact", b"1234", b""), (b"fact", b"1234", b""), DATA), "wav") == {("duplicate_chunk", 48)}
    assert rules(riff(FMT, (b"JUNK", b"x" * 1024, b""), DATA), "wav") == {("cavity_content", 44)}
    assert rules(riff(FMT, (b"JUNK", b"x" * 1000, b""), DATA), "wav") == rules(riff(FMT, (b"JUNK", bytes(2000), b""), DATA), "wav") == set()
    text = b"INFOINAM" + struct.pack("<I", 6) + b"a\1b\2c\0"
    assert rules(riff(FMT, (b"LIST", text, b""), DATA), "wav") == {("nonprintable_text", 12 + 24 + 8 + 4)}
    assert rules(clean + b"APETAGEX" + bytes(24), "wav") >= {("wrong_format_tag", n)}
    assert rules(riff(FMT, (b"JUNK", b"\0" * 10 + midi() + bytes(10), b""), DATA), "wav") == set()
    inner = wav(30)
    assert rules(riff(FMT, (b"xtra", inner, b""), DATA), "wav") == {("embedded_standalone_media", 44)}
    assert rules(riff(FMT, DATA, size=1 << 20), "wav") >= {("structure", 0)}
    smooth = struct.pack("<200h", *(257 * (i // 2) for i in range(200)))
    assert rules(riff(FMT, (b"data", smooth, b"")), "wav") == {("dual_endianness", 44)}


def test_rules_of_other_formats():
    assert rules(id3((b"TIT2", b"\0a"), (b"TIT2", b"\0b"), (b"COMM", b"\0c"), (b"COMM", b"\0d")), "mp3") == {("duplicate_frame", 0)}
    assert rules(id3((b"TIT2", b"\0a"), padding=bytes(5) + b"hid"), "mp3") == {("id3_padding_nonzero", 22)}
    assert rules(ogg([1, 2]), "ogg") == {("ogg_multistream", 0)}
    info = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(34)
    frames = [flac_frame(i, NOISE[:100]) for i in range(3)]
    app = bytes([2, 0, 0, 8]) + b"appldata"
    last = bytes([0x81, 0, 0, 4])
    assert rules(info + app + last + bytes(4) + b"".join(frames), "flac") == {("application_block", 42)}
    assert rules(info + last + b"hide" + b"".join(frames), "flac") == {("cavity_content", 46)}
    broken = bytearray(b"".join(frames))
    broken[len(frames[0]) + 40] ^= 1
    assert rules(info + last + bytes(4) + bytes(broken), "flac") == {("bad_frame_checksum", 50 + len(frames[0]))}
    stsz = box(b"stsz", struct.pack(">III", 0, 0, 2) + struct.pack(">2I", 100, 50))
    moov = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stsz)))))
    assert rules(box(b"ftyp", b"M4A \0\0\0\0") + moov + box(b"mdat", bytes(150 + 1025)), "mp4") == {("mp4_mdat_coverage", 16 + len(moov))}
    assert rules(box(b"ftyp", b"M4A \0\0\0\0") + moov + box(b"mdat", bytes(150)), "mp4") == set()
    preset = {"author": "a", "settings": {}, "odd": 1}
    assert rules(json.dumps(preset).encode() + b" tail", "vital") == {("json_unknown_key", 0), ("json_trailing_data", len(json.dumps(preset))), ("structure", len(json.dumps(preset)))}
    assert {r for r, _ in rules(ogg([1]) + b"between" + ogg([2]), "ogg")} >= {"structure"}


def test_a_rule_that_fails_is_a_finding():
    assert ("check_failed", None) in rules(box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsz", b"")))))), "mp4")
    r = random.Random(3)
    for kind in ("wav", "mp3", "ogg", "flac", "mp4", "vital", "midi", "aiff", "it", None):
        for _ in range(20):
            assert all(len(x) == 4 for x in defects.findings(r.randbytes(r.randrange(300)), kind))


def test_defects_and_verdicts_of_files(spark):
    files = [("a", "wav", riff(FMT, DATA)), ("b", "wav", riff(FMT, DATA) + b"PK\3\4"), ("c", "wav", riff(FMT, (b"note", b"odd", b"!"), DATA)), ("d", None, None), ("e", "ogg", ogg([1, 2]))]
    df = spark.createDataFrame([(p, k, None if d is None else bytearray(d)) for p, k, d in files], "path string, format string, content binary").repartition(2)
    found = defects.defects(df)
    assert {r.path: (r.findings > 0, r.worst, r.code) for r in defects.verdicts(df, found).collect()} == {"a": (False, None, 0), "b": (True, "alert", 2), "c": (True, "warn", 1), "d": (False, None, 0), "e": (True, "notice", 1)}
