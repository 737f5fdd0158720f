"""Tags of sound files and presets as records."""

from __future__ import annotations

import gzip
import io
import json
import random
import struct
import zipfile

from oreweave.sources import edit, tags
from tests.test_defects import box, id3
from tests.test_edit import clean
from tests.test_layouts import it, mod, xm


def vorbis(**pairs):
    items = [f"{k}={v}".encode() for k, v in pairs.items()]
    return struct.pack("<I", 3) + b"abc" + struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items)


def test_sound_files():
    frames = ((b"TIT2", b"\3t\xc3\xadtulo"), (b"TPE1", b"\1" + "あ".encode("utf-16")), (b"TBPM", b"\x00128\0"), (b"COMM", b"\0engshort\0the text"), (b"TKEY", b"\0Am"))
    assert tags.record(id3(*frames), "mp3") == {"title": "título", "artist": "あ", "bpm": "128", "comment": "the text", "key": "Am"}
    wav = edit.with_info(clean(), {"INAM": "name", "IART": "who", "XXXX": "?"})
    assert tags.record(wav, "wav") == {"title": "name", "artist": "who"}
    assert tags.record(edit.with_chunk(wav, b"id3 ", id3((b"TIT2", b"\0other"), (b"TALB", b"\0album"))), "wav") == {"title": "name", "artist": "who", "album": "album"}
    block = vorbis(TITLE="t", Date="1999", BPM="90", other="x")
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(34) + bytes([0x84]) + len(block).to_bytes(3, "big") + block
    assert tags.record(flac, "flac") == {"title": "t", "year": "1999", "bpm": "90"}
    page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body
    assert tags.record(page(2, b"\1vorbis") + page(0, b"\3vorbis" + block), "ogg") == {"title": "t", "year": "1999", "bpm": "90"}
    item = lambda name, kind, value: box(name, box(b"data", struct.pack(">II", kind, 0) + value))
    ilst = box(b"ilst", item(b"\xa9nam", 1, "né".encode()) + item(b"trkn", 0, struct.pack(">4H", 0, 7, 9, 0)) + item(b"tmpo", 21, struct.pack(">H", 140)))
    assert tags.record(box(b"moov", box(b"udta", box(b"meta", bytes(4) + ilst))), "mp4") == {"title": "né", "track": "7", "bpm": "140"}
    aiff = edit.Node(b"FORM", form=b"AIFF", inside=[edit.Node(b"NAME", b"n"), edit.Node(b"AUTH", b"a")]).write(">")
    assert tags.record(aiff, "aiff") == {"title": "n", "artist": "a"}
    assert tags.record(mod(), "mod") == {"title": "title"} and tags.record(xm(), "xm")["title"] == "song" == tags.record(it(), "it")["title"]


def test_presets():
    preset = {"preset_name": "p", "author": "a", "preset_style": "Bass", "comments": "", "settings": {}}
    assert tags.record(json.dumps(preset).encode() + b"\0junk", "vital") == {"device": "Vital", "title": "p", "artist": "a", "category": "Bass"}
    with io.BytesIO() as out:
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("multisample.xml", '<multisample name="m"><category>Keys</category><creator>c</creator><keywords><keyword>a</keyword><keyword>b</keyword></keywords></multisample>')
        assert tags.record(out.getvalue(), "multisample") == {"device": "Sampler", "title": "m", "category": "Keys", "artist": "c", "tags": "a;b"}
    live = gzip.compress(b'<Ableton Creator="Live 11"><Tempo><LomId Value="0"/><Manual Value="124.5"/></Tempo></Ableton>')
    assert tags.record(live, "als") == {"device": "Live 11", "bpm": "124.5"}
    name = lambda k, v: struct.pack(">I", len(k)) + k + b"\x08" + struct.pack(">I", len(v)) + v
    assert tags.record(b"BtWg0003" + name(b"preset_name", b"Pad") + name(b"creator", b"me") + name(b"odd", b"x"), "bitwig") == {"title": "Pad", "artist": "me"}


def test_anything(spark):
    r = random.Random(4)
    for kind in tags.READERS:
        for _ in range(20):
            assert isinstance(tags.record(r.randbytes(r.randrange(200)), kind), dict)
    files = [("a", "mp3", id3((b"TIT2", b"\0x"))), ("b", "mp3", b""), ("c", None, b"x"), ("d", "wav", None)]
    df = spark.createDataFrame([(p, k, None if d is None else bytearray(d)) for p, k, d in files], "path string, format string, content binary")
    assert [(r.path, r.title, r.artist) for r in tags.records(df).collect()] == [("a", "x", None)]
