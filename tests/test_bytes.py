"""Byte operators on odd files, and in time linear in a file's size."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np
import pytest

from oreweave.operators import bytestrings as bs


@pytest.fixture(scope="module")
def files(spark):
    rows = [("empty", b""), ("none", None), ("one", b"\x07"), ("same", b"z" * 5000), ("all", bytes(range(256)) * 3), ("text", "línea uno\nand two".encode() * 40), ("one", b"AB")]
    return spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in rows], "file string, data binary").repartition(3), [(n, d) for n, d in rows if d is not None]


def plain_entropy(data):
    n = Counter(data)
    return sum(-c / len(data) * math.log2(c / len(data)) for c in n.values())


def test_counts(files):
    df, rows = files
    assert sorted(map(tuple, bs.histogram(df).collect())) == sorted((n, b, c) for n, d in rows for b, c in Counter(d).items())
    got = sorted((r.file, r.total, round(r.entropy, 9)) for r in bs.entropies(df).collect())
    assert got == sorted((n, len(d), round(plain_entropy(d), 9)) for n, d in rows if d)
    got = sorted((r.file, r.slice, round(r.entropy, 9)) for r in bs.slice_entropies(df, 8).collect())
    cut = [(n, i, d[i * len(d) // 8 : (i + 1) * len(d) // 8]) for n, d in rows for i in range(8)]
    assert got == sorted((n, i, round(plain_entropy(x), 9)) for n, i, x in cut if x)
    assert {r.file: r.n for r in bs.byte_classes(df).where("class = 'ascii'").collect()} == {"same": 5000, "all": 3 * 98, "text": 16 * 40, "one": 2}


def test_windows_and_searches(files):
    df, rows = files
    got = sorted((r.file, r.window, bytes(r.data)) for r in bs.windows(df, 64, 32).collect())
    assert got == sorted((n, i, d[32 * i : 32 * i + 64]) for n, d in rows for i in range(max(0, (len(d) - 64) // 32 + 1)))
    assert sorted(map(tuple, bs.find(df, b"zz").collect())) == [("same", i) for i in range(4999)]
    found = bs.counted(df, b"zz", 10).collect()
    assert len(found) == 10 and {r.total for r in found} == {4999}
    assert {(r.file, r.pos, r.length) for r in bs.strings(df, 90).collect()} == {("same", 0, 5000), ("all", 32, 95), ("all", 288, 95), ("all", 544, 95)}
    flat = bs.autocorrelations(df.where("file = 'same'"), 256, 128).collect()
    assert len(flat) == 38 and all(r.r1 == r.r8 == 0 for r in flat)
    lines = {(r.file, r.line): r.text for r in bs.hexdump(df).collect()}
    assert lines["one", 0] in ("00000000  07  .", "00000000  41 42  AB") and lines["all", 1].startswith("00000010  10 11 12")


def test_transforms_and_differences(spark, files):
    df, rows = files
    for kind in ({"key": 90}, {"rotate": 3}, {"swap": True}, {"key": 7, "rotate": 1, "swap": True}):
        one = lambda b, key=0, rotate=0, swap=False: (lambda x: (x >> 4 | x << 4) & 255 if swap else x)((((b ^ key) >> rotate) | ((b ^ key) << (8 - rotate))) & 255)
        got = sorted((r.file, bytes(r.data)) for r in bs.transformed(df, **kind).collect())
        assert got == sorted((n, bytes(one(b, **kind) for b in d)) for n, d in rows)
    old = spark.createDataFrame([(1, bytearray(b"abcdef")), (2, bytearray(b"xyz")), (3, bytearray(b"q"))], "file int, data binary")
    new = spark.createDataFrame([(1, bytearray(b"abXYef!")), (2, bytearray(b"xyz"))], "file int, data binary")
    assert sorted(map(tuple, bs.changed(old, new).collect())) == [(1, 2), (1, 3)]
    assert list(map(tuple, bs.changed_ranges(old, new).collect())) == [(1, 2, 3, 2)]


def test_hilbert_cells():
    x, y = bs.hilbert(np.arange(256), 4)
    assert len(set(zip(x.tolist(), y.tolist(), strict=True))) == 256
    assert (np.abs(np.diff(x)) + np.abs(np.diff(y)) == 1).all()
    assert (x[0], y[0], x[-1], y[-1]) == (0, 0, 15, 0)


def test_large_file_in_linear_time(spark):
    """32 MB: searches, counts, runs and windows take seconds."""
    data = np.random.default_rng(3).integers(0, 256, 32 << 20, dtype=np.uint8)
    data[1000:1004] = np.frombuffer(b"RIFF", np.uint8)
    df = spark.createDataFrame([(1, bytearray(data.tobytes()))], "file int, data binary").cache()
    df.count()
    began = time.time()
    assert 1000 in {r.pos for r in bs.find(df, b"RIFF").collect()}
    assert bs.histogram(df).count() == 256
    assert bs.entropies(df).first().entropy > 7.99
    assert bs.strings(df, 12).count() > 0
    assert time.time() - began < 60
    df.unpersist()
