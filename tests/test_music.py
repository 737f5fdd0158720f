"""Keys and tempi as people write them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oreweave.functions import music
from oreweave.operators import harmonic


def applied(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


KEYS = {
    "C": (0, 0), "c": (0, 0), "C major": (0, 0), "C maj": (0, 0), "Am": (9, 1), "A minor": (9, 1), "a min": (9, 1), "F#m": (6, 1), "C#": (1, 0), "Db": (1, 0),
    "Eb": (3, 0), "D#": (3, 0), "8A": (9, 1), "8B": (0, 0), "C4": (0, 0), "F#3": (6, 0), "CM": (0, 0), "BbM": (10, 0), "F#M": (6, 0), "Dm7": (2, 1), " 12b ": (4, 0), "1A": (8, 1), "Cb": (11, 0),
    "": None, "ZZZ": None, "Ambient": None, "13A": None, "0B": None, "H": None, "Analog": None, None: None,
}


def test_keys(spark):
    found = zip(applied(spark, music.pitch_class, KEYS), applied(spark, music.is_minor, KEYS), strict=True)
    for (text, want), (pitch, minor) in zip(KEYS.items(), found, strict=True):
        assert (None if pitch is None else (pitch, int(minor))) == want, text
    codes = {"Am": "8A", "C": "8B", "Fm": "4A", "Eb": "5B", "CM": "8B", "DM": "10B", "8A": "8A", "Ambient": None, "12B": "12B", "1A": "1A"}
    assert applied(spark, music.camelot, codes) == list(codes.values())
    wheel = [f"{n}{x}" for n in range(1, 13) for x in "AB"]
    assert applied(spark, music.camelot, wheel) == wheel


def test_keys_of_names(spark):
    names = {
        "pad Eb minor.wav": "D#m", "pad_Bb_maj.wav": "A#", "bass Abmin.wav": "G#m", "lead_Dbm.wav": "C#m", "pad_F#M.wav": "F#", "pad_F#m.wav": "F#m", "loop EbM 124.wav": "D#",
        "PAD_A_MINOR.wav": "Am", "PAD_C_MAJOR.wav": "C", "pad_in_A minor.wav": "Am", "FM bell.wav": None, "lead C M.wav": "C", "Analog.wav": None, "minor_C.wav": None,
    }
    assert applied(spark, music.key_from_name, names) == list(names.values())
    bare = {"A": "A", "C#": "C#", "Db": "C#", "Cb": "B", "Fbm": "Em", "F#m": "F#m", "Ebm": "D#m", "Analog": None, "": None, "127": None, "A#m7": None}
    assert applied(spark, music.bare_key, bare) == list(bare.values())
    paths = {
        "/loops/PL_Hypnotize_03_126_A#.wav": "A#", "/loops/kick_120_Am.wav": "Am", "/x/Pad_Access_min_C.wav": "Cm", "/x/Pad_Reeds_min7_C.wav": "Cm", "/x/Pad_Space_minadd9_C.wav": "Cm",
        "/x/Pad_Zenith_Maj7_C.wav": "C", "/x/Pad_Adjective_Sus4_C.wav": "C", "/x/Minimal_Techno_C.wav": "C", "/x/C_Minimal_Loop.wav": "C", "/x/Magic_Bells_G.wav": "G",
        "/packs/PL_Hypnotize_03_126_A#/Drums/Raw/kick.wav": "A#", "/A#/1/2/3/kick.wav": None, "/loops/Analog_Break_fx.wav": None, "/loops/kick.wav": None,
    }
    assert applied(spark, music.key_from_path, paths) == list(paths.values())


def test_tempi_of_names(spark):
    names = {
        "PL_Hypnotize_03_126_A#.wav": 126, "126_loop.wav": 126, "91V_SBH_126_drum_fill.wav": 126, "V99kick.wav": None, "120bpm_loop.wav": 120, "loop_140_BPM.wav": 140, "_120_drum.wav": 120,
        "kick.wav": None, "x 120.5.wav": None, "Kick_909.wav": None, "groovy_80.wav": 80, "BPM 95 a 120.wav": 95, "a_61_62": 61,
    }
    assert applied(spark, music.bpm_from_name, names) == list(names.values())


@pytest.mark.parametrize("tolerance", [0.0, 0.06, 0.5])
def test_compatible_matches_brute_force(spark, tolerance):
    data = [(f"s{i}", ["Am", "8A", "C", "Em", "F#m", "A minor", "", None, "x?"][i % 9], [None, 128.0, 64.0, 127.9, 256.0, 121.0, 200.0, 0.0][i % 8]) for i in range(72)]
    df = spark.createDataFrame(data, "path string, key string, bpm double")
    code = dict(zip([k for _, k, _ in data], applied(spark, music.camelot, [k for _, k, _ in data]), strict=True))
    got = {(r.ref, r.path) for r in harmonic.compatible(df, df, tolerance).collect()}
    want = set()
    for a, ka, ta in data:
        near = {code[ka]} if code[ka] is None else {code[ka], code[ka][:-1] + ("B" if code[ka][-1] == "A" else "A")} | {f"{(int(code[ka][:-1]) - 1 + d) % 12 + 1}{code[ka][-1]}" for d in (-1, 1)}
        for b, kb, tb in data:
            keyed = code[kb] in near and not (code[kb] is None and kb not in ("", None))
            timed = ta is None or tb is not None and any(c * (1 - tolerance) <= tb <= c * (1 + tolerance) for c in (ta, ta / 2, ta * 2))
            if a != b and keyed and timed:
                want.add((a, b))
    assert got == want
