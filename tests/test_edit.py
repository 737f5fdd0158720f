"""Edits keep the sound and make sizes right; repairs change what is witnessed alone."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from oreweave.sources import defects, edit, extract, walkers
from tests.test_defects import DATA, FMT, box, riff


def clean():
    return extract.wave_file(np.random.default_rng(2).integers(-3000, 3000, 81), 8000)


def texts(data):
    return {c["id"]: c["summary"] for c in walkers.walk(data, "wav") if c["id"].startswith("INFO/")}


def test_chunks_are_set_and_taken_out():
    data = clean()
    more = edit.with_chunk(data, b"note", b"odd")
    assert [c["id"] for c in walkers.walk(more, "wav")] == ["RIFF", "fmt ", "data", "note"] and not defects.findings(more, "wav")
    assert edit.with_chunk(edit.with_chunk(more, b"note", b"other text"), b"note", None) == data == edit.with_chunk(more, b"note", None)
    info = edit.with_info(data, {"INAM": "título", "IART": "x"})
    assert texts(info) == {"INFO/INAM": "título", "INFO/IART": "x"} and not defects.findings(info, "wav")
    assert texts(edit.with_info(info, {"INAM": None, "IART": "yy"})) == {"INFO/IART": "yy"} and edit.with_info(info, {"INAM": None, "IART": None}) == data
    assert edit.stripped(edit.with_chunk(info, b"junk", b"1")) == data
    for new in (more, info):
        assert edit.sound_digest(new, "wav") == edit.sound_digest(data, "wav")


def test_sizes_from_the_bottom_up():
    info = bytearray(edit.with_info(clean(), {"INAM": "abc"}))
    at = info.index(b"LIST")
    struct.pack_into("<I", info, at + 4, 4 + 8 + 4)
    struct.pack_into("<I", info, 4, len(info) - 8)
    assert edit.resized(bytes(info)) == bytes(info)
    struct.pack_into("<I", info, 4, 99_999)
    fixed = edit.resized(bytes(info))
    assert struct.unpack_from("<I", fixed, 4)[0] == len(fixed) - 8
    nested = edit.Node(b"FORM", form=b"AIFF", inside=[edit.Node(b"LIST", form=b"ABCD", inside=[edit.Node(b"x   ", b"odd")])])
    raw = nested.write(">")
    assert edit.tree(raw)[0] == nested and struct.unpack_from(">II", raw, 4)[0] == len(raw) - 8
    with pytest.raises(ValueError):
        edit.tree(b"none")


def test_a_change_of_the_sound_is_refused():
    data = clean()
    assert edit.guarded(data, "wav", lambda d: edit.with_chunk(d, b"data", b"other")) == (data, "refused: the sound would change")
    assert edit.guarded(data, "wav", lambda d: d) == (data, "same")
    assert edit.guarded(b"junk", "wav", lambda d: edit.with_info(d, {}))[1].startswith("refused")
    assert edit.guarded(data, "wav", lambda d: edit.with_info(d, {"INAM": "n"}))[1] == "changed"


def test_derived_fields():
    assert list(edit.violations(clean(), "wav")) == []
    bad = (b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 5, 9, 16), b"\0")
    data = riff(bad, (b"fact", struct.pack("<I", 7), b""), DATA, size=44)
    found = {v[0]: v[2:] for v in edit.violations(data, "wav")}
    assert found == {"form size": (44, len(data) - 8, True), "block align": (9, 4, True), "byte rate": (5, 32000, True), "fact frames": (7, 100, True)}
    fixed, done = edit.repaired(data, "wav")
    assert sorted(done) == sorted(found) and list(edit.violations(fixed, "wav")) == [] and edit.sound_digest(fixed, "wav") == edit.sound_digest(data, "wav")
    cut = riff(FMT, DATA)[:-50]
    assert edit.repaired(cut, "wav") == (cut, [])


def mp4(offsets, runs=((1, 2),), sizes=(10, 20, 30, 40), each=0, stated=8, room=None):
    table = box(b"stsc", struct.pack(">II", 0, len(runs)) + b"".join(struct.pack(">III", *r, 1) for r in runs))
    table += box(b"stsz", struct.pack(">III", 0, each, len(sizes)) + (b"" if each else struct.pack(f">{len(sizes)}I", *sizes)))
    table += box(b"stco", struct.pack(">II", 0, len(offsets)) + struct.pack(f">{len(offsets)}I", *offsets))
    table += box(b"stts", struct.pack(">IIII", 0, 1, len(sizes), 2))
    head = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1, stated))
    moov = box(b"moov", box(b"trak", box(b"mdia", head + box(b"minf", box(b"stbl", table)))))
    return box(b"ftyp", b"M4A \0\0\0\0") + moov + box(b"mdat", bytes(sum(sizes) if room is None else room))


def test_chunk_offsets_are_rebuilt():
    data = mp4([0, 0])
    start = data.index(b"mdat") + 4
    assert edit.run_chunks([(1, 2), (3, 1)], 4) == [2, 2, 1, 1] and edit.run_chunks([(1, 5)], 2) == [5, 5]
    assert [(v[0], v[2], v[3], v[4]) for v in edit.violations(data, "mp4")] == [("chunk offset", 0, start, True), ("chunk offset", 0, start + 30, True)]
    fixed, _ = edit.repaired(data, "mp4")
    assert fixed == mp4([start, start + 30]) and list(edit.violations(fixed, "mp4")) == []
    assert [v[4] for v in edit.violations(mp4([0, 0], room=50), "mp4")] == [False, False]
    with pytest.raises(ValueError):
        list(edit.violations(mp4([0, 0, 0]), "mp4"))
    assert edit.media_seconds(data) == (8.0, 8.0) and edit.media_seconds(mp4([0, 0], stated=3)) == (3.0, 8.0) and edit.media_seconds(b"") is None


def test_files_are_checked_and_mended(spark):
    rows = [("a", "wav", clean()), ("b", "wav", riff(FMT, DATA, size=44)), ("c", None, None), ("d", "mp4", mp4([0, 0])), ("e", "mp4", mp4([0, 0, 0]))]
    df = spark.createDataFrame([(p, k, None if d is None else bytearray(d)) for p, k, d in rows], "path string, format string, content binary").repartition(2)
    assert {(r.path, r.field) for r in edit.checked(df).collect()} == {("b", "form size"), ("d", "chunk offset")}
    got = {r.path: (bytes(r.content), r.state) for r in edit.mended(df).collect()}
    assert {p: s.partition(":")[0] for p, (_, s) in got.items()} == {"a": "same", "b": "changed", "c": "same", "d": "changed", "e": "refused"}
    again = spark.createDataFrame([("b", "wav", bytearray(got["b"][0])), ("d", "mp4", bytearray(got["d"][0]))], "path string, format string, content binary")
    assert edit.checked(again).count() == 0
    tagged = edit.changed(df.where("format = 'wav'"), lambda d, kind: edit.with_info(d, {"INAM": "n"}))
    assert {r.path: r.state for r in tagged.collect()} == {"a": "changed", "b": "changed"}


def test_a_file_is_replaced_whole(spark, tmp_path):
    path = tmp_path / "a.bin"
    edit.replace_file(spark, str(path), b"one")
    assert path.read_bytes() == b"one" and not (tmp_path / "a.bin.bak").exists()
    edit.replace_file(spark, str(path), b"two\0\xff")
    assert path.read_bytes() == b"two\0\xff" and (tmp_path / "a.bin.bak").read_bytes() == b"one" and not (tmp_path / "a.bin.new").exists()
    edit.replace_file(spark, str(path), b"three", backup=False)
    assert path.read_bytes() == b"three"
