"""Samples out of files that are made here, and decoders against plain versions."""

from __future__ import annotations

import io
import math
import random
import struct
import zipfile

import numpy as np
import pytest

from oreweave.functions import codecs
from oreweave.sources import extract, walkers
from tests.test_layouts import mod, voc, xm


def one(data, kind):
    found = list(extract.samples(data, kind))
    assert len(found) == 1, [s.note for s in found]
    return found[0]


def sf2():
    pool = np.arange(-50, 50, dtype="<i2").tobytes()
    head = lambda name, a, b, kind=1: struct.pack("<20s5IBbHH", name, a, b, 0, 0, 22050, 60, 0, 0, kind)
    heads = head(b"low", 0, 40) + head(b"rom", 0, 9, 0x8001) + head(b"high", 40, 100) + head(b"EOS", 0, 0)
    part = lambda kind, *chunks: b"LIST" + struct.pack("<I", 4 + sum(map(len, chunks))) + kind + b"".join(chunks)
    chunk = lambda i, d: i + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    body = b"sfbk" + part(b"sdta", chunk(b"smpl", pool)) + part(b"pdta", chunk(b"shdr", heads))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wave_files_round_trip():
    for bits, channels in ((8, 1), (16, 2), (24, 1), (32, 2)):
        top = 1 << bits - 1
        x = np.random.default_rng(bits).integers(-top, top, 200)
        data = extract.wave_file(x, 8000, channels, bits)
        s = one(data, "wav")
        assert (s.rate, s.channels, s.bits) == (8000, channels, bits) and (s.pcm == x).all()
        assert not any(c["warnings"] for c in walkers.walk(data, "wav"))


def test_modules_and_banks():
    found = list(extract.samples(mod(), "mod"))
    assert [(s.name, len(s.pcm), s.bits) for s in found] == [("smp 0", 20, 8), ("smp 2", 14, 8)] and (found[0].pcm == 1).all()
    s = one(xm(), "xm")
    assert s.pcm.tolist() == [0x0201, 0x0201 + 0x0403, 0x0201 + 0x0403 + 0x0605] and s.rate == round(8363 * 2 ** (-3 / 12))
    found = list(extract.samples(sf2(), "sf2"))
    assert [(s.name, len(s.pcm), s.key) for s in found] == [("low", 40, 60), ("high", 60, 60)] and found[1].pcm[0] == -10
    assert one(voc(), "voc").rate == 11111
    with io.BytesIO() as out:
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.wav", extract.wave_file(np.arange(5), 44100))
            z.writestr("readme", "x")
        assert one(out.getvalue(), "multisample").pcm.tolist() == [0, 1, 2, 3, 4]
    wave = struct.pack("<7sBIIIH", b"w", 0, 4, 0, 0, 11025) + bytes(29) + bytes([3]) + bytes(40)
    wave = wave[:26].ljust(55, b"\0") + bytes([3]) + bytes(40)
    patch = (b"GF1PATCH110\0ID#000002\0".ljust(129, b"\0") + bytes(63) + bytes(6) + bytes([1]) + bytes(40)) + wave + struct.pack("<2H", 0x8000, 0xFFFF)
    assert one(patch, "gf1pat").pcm.tolist() == [0, 32767]


def test_plain_sounds():
    au = b".snd" + struct.pack(">5I", 24, 6, 3, 8000, 1) + struct.pack(">3h", 1, -2, 3)
    assert one(au, "au").pcm.tolist() == [1, -2, 3] and one(au[:-2], "au").note == "cut off"
    dmx = struct.pack("<HHI", 3, 11025, 35) + bytes(16) + bytes([128, 129, 127]) + bytes(16)
    assert one(dmx, "dmx").pcm.tolist() == [0, 1, -1]
    rate = struct.pack(">HQ", 16383 + 14, 22050 << 49)
    comm, ssnd = struct.pack(">hIh", 1, 3, 16) + rate, struct.pack(">II", 0, 0) + struct.pack(">3h", 5, -6, 7)
    aiff = b"FORM" + struct.pack(">I", 4 + 8 + len(comm) + 8 + len(ssnd)) + b"AIFFCOMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(ssnd)) + ssnd
    assert (one(aiff, "aiff").pcm.tolist(), one(aiff, "aiff").rate) == ([5, -6, 7], 22050)
    assert list(extract.samples(b"", None)) == [] and one(b"junk", "aiff").note.startswith("extractor stopped")


def encoded_spu(x):
    """Blocks without a filter, of the smallest shift that holds them."""
    out, got = b"", []
    for i in range(0, len(x), 28):
        part = [*x[i : i + 28], *[0] * (28 - len(x[i : i + 28]))]
        shift = next(s for s in range(12, -1, -1) if all(-8 <= round(v / (1 << 12 - s)) <= 7 for v in part))
        codes = [round(v / (1 << 12 - shift)) for v in part]
        got += [c << 12 - shift for c in codes]
        out += bytes([shift, i + 28 >= len(x)]) + bytes((a & 15) | (b & 15) << 4 for a, b in zip(codes[::2], codes[1::2], strict=True))
    return out, got


def test_console_codecs():
    t = np.arange(120)
    raw, want = encoded_spu((9000 * np.sin(t / 5)).astype(int).tolist())
    assert extract.whole(codecs.spu_adpcm(raw)).tolist() == want
    vag = b"VAGp" + struct.pack(">IIII", 4, 0, len(raw), 22050) + bytes(12) + b"x".ljust(16, b"\0") + raw
    s = one(vag, "vag")
    assert s.rate == 22050 and s.pcm.tolist() == want
    # A filter's output is the sum that it is defined by.
    block = bytes([4 | 1 << 4, 1]) + bytes(random.Random(2).randrange(256) for _ in range(14))
    codes = [c for b in block[2:] for c in (b & 15, b >> 4)]
    last, out = 0, []
    for c in codes:
        last = max(-32768, min(32767, ((c - 16 if c & 8 else c) << 8) + (last * 60 + 32 >> 6)))
        out.append(last)
    assert extract.whole(codecs.spu_adpcm(block)).tolist() == out
    nine = bytes([12 << 4 | 1]) + bytes([0x17] * 8)
    assert (codecs.brr(nine) * 16384).tolist() == [float(v) for v in [2048, 14336] * 8]
    assert (codecs.dsp_adpcm(bytes([0x02, *[0x1F] * 7]), [(0, 0)], 14) * 32768).tolist() == [4.0, -4.0] * 7
    assert (codecs.dsp_adpcm(bytes([0x00, *[0x10] * 7]), [(2048, 0)], 3) * 32768).tolist() == [1.0, 1.0, 2.0]
    assert codecs.adx(struct.pack(">H", 15) + bytes([0x1F] * 16), 44100)[0] == 16 / 32768


def test_ms_adpcm_follows_its_definition():
    r = random.Random(9)
    pair, step, one_, two = 2, 40, 100, -50
    body = bytes(r.randrange(256) for _ in range(30))
    out, a, b, d = [two, one_], one_, two, step
    c1, c2 = codecs.MS_PAIRS[pair]
    for code in (x for byte in body for x in (byte >> 4, byte & 15)):
        value = max(-32768, min(32767, (a * c1 + b * c2 >> 8) + (code - 16 if code > 7 else code) * d))
        out.append(value)
        a, b, d = value, a, max(16, codecs.MS_FACTORS[code] * d >> 8)
    block = bytes([pair]) + struct.pack("<3h", step, one_, two) + body
    assert (codecs.ms_adpcm_block(block) * 32768).tolist() == out
    assert len(codecs.ms_adpcm_block(b"\0")) == 0 and codecs.delta(b"\x7f\x01\x01")[-1] == -127 / 128


def packed(samples, wide, twice, r):
    """An encoder that changes its width at random, wherever the next difference fits."""
    bits, low = (17, 4) if wide else (9, 3)
    full, out = 1 << bits - 1, b""
    wrap = lambda x: (x + full // 2) % full - full // 2
    size = 0x4000 if wide else 0x8000
    for start in range(0, len(samples), size):
        one = two = 0
        width, stream, place = bits, 0, 0

        def put(value, n):
            nonlocal stream, place
            stream, place = stream | value << place, place + n

        for x in samples[start : start + size]:
            step = wrap(x - (two if twice else one))
            if twice:
                step, two = wrap(step - one), x
                one = wrap(one + step)
            else:
                one = x
            while True:
                fits = width == bits
                if width < 7:
                    fits = -(1 << width - 1) < step < 1 << width - 1
                elif width < bits:
                    border = (full - 1 >> bits - width) - (1 << low - 1)
                    fits = -(1 << width - 1) <= step < 1 << width - 1 and not border < step % (1 << width) <= border + (1 << low)
                if fits and r.random() < 0.9:
                    break
                new = bits if not fits else r.randrange(1, bits + 1)
                if new == width:
                    continue
                if width == bits:
                    put(full | new - 1, width)
                else:
                    code = new if new < width else new - 1
                    if width < 7:
                        put(1 << width - 1, width)
                        put(code - 1, low)
                    else:
                        put(border + code, width)
                width = new
            put(step % full if width == bits else step % (1 << width), width)
        raw = stream.to_bytes((place + 7) // 8, "little")
        out += len(raw).to_bytes(2, "little") + raw
    return out


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("twice", [False, True])
def test_packed_tracker_samples(wide, twice):
    r = random.Random(5)
    top = 30_000 if wide else 120
    samples = [int(top * math.sin(i / 9) * math.sin(i / 500)) + r.randrange(-3, 4) for i in range(3000)]
    data = packed(samples, wide, twice, r)
    got, end = codecs.packed_deltas(data, len(samples), wide, twice)
    assert got.tolist() == samples and end == len(data)
    assert len(codecs.packed_deltas(data[: len(data) // 2], len(samples), wide, twice)[0]) < len(samples)
    assert len(codecs.packed_deltas(b"", 5)[0]) == 0


def test_extracted_rows(spark):
    files = [("m.mod", "mod", mod()), ("b.sf2", "sf2", sf2()), ("x.bin", None, b"no"), ("bad.aiff", "aiff", b"FORM"), ("s.au", "au", b".snd" + struct.pack(">5I", 24, 2, 2, 8000, 1) + b"\1\2")]
    df = spark.createDataFrame([(p, k, bytearray(d)) for p, k, d in files], "path string, format string, content binary").repartition(2)
    got = {(r.path, r.seq): r for r in extract.extracted(df).collect()}
    assert set(got) == {("m.mod", 0), ("m.mod", 1), ("b.sf2", 0), ("b.sf2", 1), ("bad.aiff", 0), ("s.au", 0)}
    assert got["bad.aiff", 0].wav is None and got["b.sf2", 1].frames == 60 and one(bytes(got["s.au", 0].wav), "wav").pcm.tolist() == [1, 2]
    assert [r.path for r in extract.converted(df).collect()] == ["s.wav"]


@pytest.mark.parametrize("seed", range(3))
def test_extractors_survive_anything(seed):
    r = random.Random(seed)
    for kind in extract.EXTRACTORS:
        for data in (b"", *(bytes(b ^ (r.random() < 0.03) * r.randrange(256) for b in s) for s in (mod(), sf2(), xm(), voc())), *(r.randbytes(r.randrange(300)) for _ in range(10))):
            for s in extract.samples(data, kind):
                assert math.isfinite(s.rate)
