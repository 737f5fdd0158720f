"""A census counts what walkers find, and parts of it add up."""

from __future__ import annotations

import struct
from collections import Counter

from pyspark.sql import functions as F

from oreweave.functions import grammar
from oreweave.operators import census
from oreweave.sources import walkers
from tests.test_defects import DATA, FMT, riff
from tests.test_extract import sf2
from tests.test_regions import midi


def test_census_and_its_parts(spark):
    two = riff(FMT, (b"fact", b"1234", b""), (b"LIST", b"INFOINAM" + struct.pack("<I", 2) + b"a\0", b""), DATA)
    files = [("a", "wav", riff(FMT, DATA)), ("b", "wav", two), ("c", "wav", riff(FMT, DATA) + b"tail"), ("d", "midi", midi()), ("e", "sf2", sf2()), ("f", None, b"")]
    df = spark.createDataFrame([(p, k, bytearray(d)) for p, k, d in files], "path string, format string, content binary").repartition(3)
    found = census.facts(walkers.chunks(df))
    rows = {(r["kind"], r["value"]): (r["n"], r["files"], r["first"]) for r in census.census(found).collect()}
    want = Counter(("chunk", c["id"]) for _, k, d in files if k for c in walkers.walk(d, k)[1:])
    assert {k: v[0] for k, v in rows.items() if k[0] == "chunk"} == want
    assert rows["container", "RIFF/WAVE"] == (3, 3, "a") and rows["container", "RIFF/sfbk"] == (1, 1, "e") and rows["container", "MThd"] == (1, 1, "d")
    assert rows["fmt.format_tag", "1"] == (3, 3, "a") and rows["LIST.form", "INFO"] == (1, 1, "b") and rows["fact size", "4"] == (1, 1, "b") and rows["flag", "left over"] == (1, 1, "c")
    parts = [census.census(census.facts(walkers.chunks(df.where(F.col("path").isin(*names))))) for names in ("abc", "def")]
    assert {(r["kind"], r["value"]): (r["n"], r["files"], r["first"]) for r in census.merged(*parts).collect()} == rows
    shown = census.examples(found, 2).where("value = 'data'").orderBy("place").collect()
    assert [(r.path, r.place) for r in shown] == [("a", 1), ("b", 2)]


def test_grammars(spark):
    md5 = bytes(range(16))
    packed = (48000 << 44 | 1 << 41 | 15 << 36 | 12345).to_bytes(8, "big")
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + struct.pack(">HH", 4096, 4608) + (7).to_bytes(3, "big") + (9).to_bytes(3, "big") + packed + md5
    rows = [("wav", riff(FMT, DATA)), ("flac", flac), ("flac", flac[:30]), ("flac", b"RIFF"), ("midi", midi()), ("wav", b"RIFF" + bytes(40))]
    for kind, data in rows:
        got = spark.createDataFrame([(bytearray(data),)], "c binary").select(grammar.interpret(F.col("c"), grammar.GRAMMARS[kind]).alias("g")).first().g
        if kind == "flac" and len(data) > 40:
            assert (got.least_block, got.most_block, got.least_frame, got.most_frame, got.sample_rate, got.channels, got.bits_per_sample, got.samples, bytes(got.md5)) == (4096, 4608, 7, 9, 48000, 2, 16, 12345, md5)
        elif kind == "wav" and data[8:12] == b"WAVE":
            assert (got.format_tag, got.sample_rate, got.bits_per_sample) == (1, 8000, 16)
        elif kind == "midi":
            assert (got.format, got.tracks, got.division) == (1, 2, 96)
        else:
            assert got is None
