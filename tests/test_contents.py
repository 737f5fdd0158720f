"""Tables of contents of archives that are made here."""

from __future__ import annotations

import random
import struct
import time

import pytest

from oreweave.operators import contents


def archive(names, order="<", width=32, lead=0, base=0, gap=16):
    r = random.Random(1)
    head = b"ARCHIVE!" + bytes(gap - 8)
    payloads = [(b"RIFF" if n.endswith("wav") else b"MThd") + r.randbytes(20 + 7 * i) for i, n in enumerate(names)]
    at = len(head) + width * len(names)
    table, offset = b"", 0 if base else at
    for n, p in zip(names, payloads, strict=True):
        numbers = struct.pack(order + "II", offset, len(p))
        row = (numbers + n.encode().ljust(width - 8, b"\0")) if lead else n.encode().ljust(width - 12, b"\0") + numbers + bytes(4)
        table += row
        offset += len(p)
    return head + table + b"".join(payloads), [(n, at + sum(map(len, payloads[:i])), len(p)) for i, (n, p) in enumerate(zip(names, payloads, strict=True))]


NAMES = [f"snd_{i:02d}.wav" for i in range(7)] + ["song.mid"]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", [{}, {"lead": 8}, {"base": 1}, {"width": 64}, {"width": 24}])
def test_tables_are_found(order, kind):
    data, want = archive(NAMES, order, **kind)
    got = contents.discover(data)
    assert [(r["name"], r["offset"], r["size"]) for r in got] == want
    assert all(r["known"] for r in got) and 0.5 < got[0]["confidence"] <= 0.85


def test_no_tables():
    assert contents.discover(b"") == contents.discover(b"a.wav\0b.wav\0") == []
    names_only = b"".join(n.encode().ljust(32, b"\0") for n in NAMES)
    assert contents.discover(names_only) == []
    r = random.Random(2)
    assert contents.discover(r.randbytes(50_000)) == []
    assert contents.strides([0, 32, 64]) == [] and contents.strides([0, 32, 64, 96, 500]) == [(32, [0, 32, 64, 96])]


def test_tables_of_files(spark):
    data, want = archive(NAMES)
    df = spark.createDataFrame([("a", bytearray(b"lead in " + data[8:])), ("b", bytearray(b"none")), ("c", None)], "file string, data binary")
    assert [(r.name, r.offset, r.size) for r in contents.discovered(df).orderBy("offset").collect()] == want


def test_many_archives_take_seconds():
    data = [archive(NAMES[k % 4 :], "<>"[k % 2], lead=8 * (k % 3 == 0))[0] + bytes(k) for k in range(600)]
    contents.discover(data[0])
    began = time.process_time()
    assert all(len(contents.discover(d)) == len(NAMES) - k % 4 for k, d in enumerate(data))
    assert time.process_time() - began < 4
