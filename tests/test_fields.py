"""Typed fields, texts, vectors, MessagePack, JSON spans, index refresh and targets on awkward values."""

from __future__ import annotations

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreweave.functions import fields, text
from oreweave.operators import fulltext
from oreweave.sources import sniff


def test_fields_of_all_kinds(spark):
    raw = random.Random(3).randbytes(64)
    df = spark.createDataFrame([(bytearray(raw),)], "d binary")
    codes = {"u8": "<B", "i8": "<b", "u16le": "<H", "u16be": ">H", "i16be": ">h", "u32le": "<I", "i32be": ">i", "f32le": "<f", "f32be": ">f", "f64le": "<d", "i64le": "<q", "i64be": ">q"}
    got = df.select(*(fields.read(F.col("d"), F.lit(5), s).alias(s) for s in codes)).first()
    for s, c in codes.items():
        want = struct.unpack_from(c, raw, 5)[0]
        assert got[s] == want or (want != want and got[s] != got[s]), s
    past = df.select(fields.read(F.col("d"), F.lit(61), "u32").alias("a"), fields.read(F.col("d"), F.lit(60), "u32").isNotNull().alias("b"), fields.read(F.col("d"), F.lit(62), "x2").alias("c")).first()
    assert past.a is None and past.b and bytes(past.c) == raw[62:]
    assert df.select(fields.read(F.col("d"), F.lit(0), "u24be").alias("x")).first().x == int.from_bytes(raw[:3], "big")
    for bad in ("u9", "f16", "", "s", "u16xe"):
        with pytest.raises(ValueError):
            fields.parse(bad)


def test_numbers_are_written_as_they_are_read(spark):
    values = [0, 1, 127, 128, 255, 256, 65535, 65536, -1, -128, -129, 2**31 - 1, -(2**31), 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for s in fields.ENCODINGS + ("i64be", "u48le"):
        rows = df.select("v", fields.write(F.col("v"), s).alias("raw")).withColumn("back", fields.read(F.col("raw"), F.lit(0), s)).collect()
        kind, size, little = fields.parse(s)
        for r in rows:
            try:
                want = r.v.to_bytes(size, "little" if little else "big", signed=kind == "i")
            except OverflowError:
                want = None
            assert (None if r.raw is None else bytes(r.raw)) == want and (want is None or r.back == r.v), (s, r.v)
    got = df.select(fields.with_bits(F.lit(0b1010_0101), 2, 4, F.lit(0b1111)).alias("a"), fields.with_bits(F.lit(1), 0, 2, F.lit(4)).alias("b"), fields.bits(F.lit(-1), 60, 4).alias("c")).first()
    assert (got.a, got.b, got.c) == (0b1011_1101, None, 15)


def test_texts(spark):
    rows = {b"plain": ("plain", "plain"), b" a\0b": (" a\0b", "a"), b"\xe9t\xe9": ("été", "été"), "été".encode(): ("été", "été"), b"": ("", ""), b"\0x": ("\0x", ""), b"a\x00\x10": ("a\0\x10", "a"), b"p\x0fq\xf0\x0f": ("p\x0fqð\x0f", "p\x0fqð")}
    df = spark.createDataFrame([(bytearray(k),) for k in rows], "d binary")
    got = {bytes(r.d): (r.a, r.b) for r in df.select("d", text.decoded(F.col("d")).alias("a"), text.c_string(F.col("d")).alias("b")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in rows.items()}
    assert {k: v[1].rstrip("\x0f") for k, v in got.items()} == {k: v[1].rstrip("\x0f") for k, v in rows.items()}
    df = spark.createDataFrame([(bytearray(b"ok/\xc3\xa9"),), (bytearray(b"bad/\xff\xfe.wav"),), (None,)], "d binary")
    assert [r.p for r in df.select(text.safe_path(F.col("d")).alias("p")).collect()] == ["ok/é", "bad/\\xff\\xfe.wav", None]


def test_vectors(spark):
    v = np.random.default_rng(1).normal(size=45).astype(np.float32)
    df = spark.createDataFrame([(v.tolist(),), (None,), ([],)], "v array<float>").select("v", fields.pack_vector("v").alias("p"))
    got = df.select(fields.unpack_vector(F.col("p"), 45).alias("u"), "p").collect()
    assert bytes(got[0].p) == v.astype("<f4").tobytes() and np.array_equal(np.array(got[0].u, dtype=np.float32), v)
    assert got[1].u is None and got[2].u is None


def test_message_pack():
    cases = {b"\xc0": None, b"\xc3": True, b"\x7f": 127, b"\xff": -1, b"\xcd\x01\x00": 256, b"\xd1\xff\x00": -256, b"\xcb" + struct.pack(">d", 1.5): 1.5, b"\xa3abc": "abc", b"\xd9\x02hi": "hi", b"\xc4\x02\x00\x01": b"\0\1", b"\x93\x01\x02\xa1x": [1, 2, "x"], b"\x82\xa1a\x01\xa1b\x90": {"a": 1, "b": []}, b"\xdc\x00\x02\x01\x02": [1, 2]}
    for raw, want in cases.items():
        assert fields.read_msgpack(raw) == (want, len(raw))
    for bad in (b"\xc1", b"\xa5ab", b"\xdd\x00\x00\xff\xff\x01", b"\x91" * 400):
        with pytest.raises((ValueError, IndexError, struct.error)):
            fields.read_msgpack(bad)
    assert fields.read_pascal(b"\x03abcd", 0) == ("abc", 4) and fields.read_pascal(struct.pack("<I", 2) + "é!".encode("utf-16-le"), 0, wide=True) == ("é!", 8)


def test_json_spans():
    value = {"a": "é}{", "b": [1, {}]}
    raw = json.dumps(value, ensure_ascii=False).encode()
    assert fields.json_span(raw + b"\xff\xfetrailing}") == (value, len(raw))
    assert fields.json_span(b"\n " + raw) == (value, len(raw) + 2)
    assert fields.json_span(b"[1]") == fields.json_span(b"") == fields.json_span(b'{"a": ') == (None, 0)


def test_refreshed_index_is_a_rebuilt_one(spark):
    docs = spark.createDataFrame([(1, "old words here"), (2, "kept words"), (3, "gone")], "id long, text string")
    new = spark.createDataFrame([(1, "new words"), (3, ""), (4, "added words")], "id long, text string")
    got = fulltext.refreshed(fulltext.index(docs, "id", ["text"]), new, "id", ["text"])
    whole = fulltext.index(docs.where("id = 2").unionByName(new), "id", ["text"])
    plain = lambda d: sorted(map(tuple, d.select("term", "id", "column", "pos").collect()))
    assert plain(got) == plain(whole)
    assert {r.id for r in fulltext.match(got, "words").collect()} == {1, 2, 4} and not fulltext.match(got, "gone").count()


def test_addresses():
    from oreweave.operators import addresses
    from oreweave.sources import extract

    wav = extract.wave_file(np.arange(10), 8000)
    place = lambda spec, data=wav, kind="wav": addresses.resolve(data, kind, addresses.parse(spec))
    assert place("28") == place("0x1c") == place("0x1C ") == (28, None) and place("010") == (10, None) and place("4+0x10") == (20, None)
    assert place("end") == (len(wav), None) and place("end-4") == place("end[-4]") == (len(wav) - 4, None) and place("end[-9999]") is None
    assert place("find:data") == place("find:0x64617461") == (36, None) and place("find:data + 8") == (44, None) and place("find:nothing") is None
    assert place("chunk:data") == (36, 20) and place("chunk:fmt+8") == (20, 16) and place("fmt.sample_rate") == (24, 4) and place("fmt.none") is None and place("chunk:none") is None
    for bad in ("", "find:", "somewhere", "0x", "end[]", "chunk:"):
        with pytest.raises(ValueError):
            addresses.parse(bad)


def test_targets(spark):
    listing = spark.createDataFrame([(p,) for p in ("/a/x.wav", "/a/b/y.WAV", "/a/n.txt", "/c/z.txt", "/c/q.wav", "/ab/k.wav")], "path string")
    rows = lambda *a, **k: {r.path: (r.named, r.kept) for r in sniff.expanded(listing, *a, **k).collect()}
    assert rows(["/a", "/c/z.txt", "/a/"], ["wav"]) == {"/a/x.wav": (False, True), "/a/b/y.WAV": (False, True), "/a/n.txt": (False, False), "/c/z.txt": (True, True)}
    assert rows(["/a"], recurse=False) == {"/a/x.wav": (False, True), "/a/n.txt": (False, True)}
    assert rows(["/none"]) == {}
