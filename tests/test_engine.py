"""The engine's tools end to end on a small folder of sound files."""

from __future__ import annotations

import struct

import pytest

from oreweave.engine import Engine
from oreweave.functions import stemming
from oreweave.operators import fulltext
from tests.test_sources import riff


def wave(seconds, beats=0, tempo=0.0):
    rate = 100
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    acid = struct.pack("<IHHfIHHf", 0, 60, 0, 0.0, beats, 4, 4, tempo)
    return riff((b"fmt ", fmt), (b"acid", acid), (b"data", bytes(int(seconds * rate))))


def test_catalogue_of_a_folder(spark, tmp_path):
    music = tmp_path / "music"
    (music / "drums").mkdir(parents=True)
    (music / "drums/kick_120bpm.wav").write_bytes(wave(0.5))
    (music / "drums/loop.wav").write_bytes(wave(4, 8, 120.0))
    (music / "pad.wav").write_bytes(wave(8))
    engine = Engine(spark, str(tmp_path / "catalogue"))
    root = str(music)
    assert engine.reindex(root, "A") == {"added": 3}
    assert engine.reindex(root, "A") == {"skipped": 3}
    rows = {r.path.rsplit("/", 1)[1]: r for r in engine.search_samples().collect()}
    assert rows["kick_120bpm.wav"].bpm == 120 and rows["loop.wav"].acid_beats == 8 and rows["pad.wav"].duration == 8
    assert all(r.total == 3 and not r.truncated for r in rows.values())
    kick, loop = rows["kick_120bpm.wav"].path, rows["loop.wav"].path
    engine.tag_sample(kick, add=["drums", " punchy ", ""])
    engine.tag_sample(loop, add=["drums"])
    engine.tag_sample(kick, remove=["punchy"])
    engine.set_sample_description(kick, "a booming drum")
    assert {r.path for r in engine.search_samples(tags=["DRUMS"]).collect()} == {kick, loop}
    assert [r.path for r in engine.search_samples(text="boom* drums").collect()] == [kick]
    assert engine.get_sample(kick).first().tags == ["drums"]
    assert [r.path for r in engine.search_samples(limit=1, bpm_min=100).collect()] == [kick] and engine.search_samples(limit=1, bpm_min=100).first().truncated
    assert engine.locate_sample("KICK_").first().path == kick
    assert [(r.value, r.n) for r in engine.list_tags("dr").collect()] == [("drums", 2)]
    assert [(r.value, r.n) for r in engine.list_formats().collect()] == [("wav", 3)]
    stats = engine.index_stats().first()
    assert (stats.samples, stats.tags, stats.features) == (3, 1, 0)
    assert {r.path for r in engine.find_compatible(kick).collect()} == {loop}
    engine.set_features(spark.createDataFrame([(kick, [1.0, 0.0]), (loop, [1.0, 0.1]), (rows["pad.wav"].path, [-1.0, 5.0])], "path string, vec array<double>"))
    assert engine.find_similar(kick, 1).first().id == loop
    assert engine.stale_features().count() == 0
    with pytest.raises(ValueError):
        engine.register_library(root + "/drums", "B")
    (music / "pad.wav").unlink()
    assert engine.reindex(root, "A") == {"skipped": 2, "pruned": 1}
    assert engine.index_stats().first().features == 2
    engine.forget_library("A")
    assert engine.search_samples().count() == 0 and engine.list_libraries().count() == 0


def test_hearing_files(spark, tmp_path):
    import numpy as np

    from oreweave.sources import extract

    music = tmp_path / "music"
    music.mkdir()
    t = np.arange(44_100) / 22_050
    chord = sum(np.sin(2 * np.pi * f * t) for f in (1046.5, 1318.5, 1568.0)) / 3
    (music / "chord_100bpm.wav").write_bytes(extract.wave_file((chord * 30_000).astype(int), 22_050) + b"more")
    (music / "bass Am.wav").write_bytes(extract.wave_file((np.sin(2 * np.pi * 110 * t) * 30_000).astype(int), 22_050))
    engine = Engine(spark, str(tmp_path / "catalogue"))
    engine.reindex(str(music), "A")
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in engine.search_samples().collect()}
    found = engine.detect_bpm_key(paths["chord_100bpm.wav"]).first()
    assert (found.bpm == 100 or found.heard_bpm) and found.heard_key in (None, "C") and engine.detect_bpm_key(paths["bass Am.wav"]).first().key == "Am"
    assert engine.analyze_sample(paths["bass Am.wav"]).first().duration == 2.0
    assert {r.rule for r in engine.defects(paths["chord_100bpm.wav"]).collect()} >= {"trailing_data"}
    assert [r.id for r in engine.inspect(paths["bass Am.wav"]).orderBy("seq").collect()] == ["RIFF", "fmt ", "data"]
    assert engine.locate_sound(paths["bass Am.wav"]).first().format == "wav"
    assert engine.stale_features().count() == 2 and engine.reindex_features() == 2 and engine.stale_features().count() == 0 and engine.reindex_features() == 0
    assert engine.find_similar(paths["bass Am.wav"], 1).first().id == paths["chord_100bpm.wav"]
    for i in range(5):
        engine.tag_sample(paths["bass Am.wav"], add=[f"t{i}"])
    assert len(list((tmp_path / "catalogue/tags").iterdir())) == 3 and engine.get_sample(paths["bass Am.wav"]).first().tags == [f"t{i}" for i in range(5)]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controlling": "control", "sky": "sky"}
    assert {w: stemming.stem(w) for w in pairs} == pairs


def test_full_text_queries(spark):
    docs = spark.createDataFrame([(1, "kick one", "booming sub"), (2, "closed hats", None), (3, "dusty synth", "warm and lofi"), (4, "synth dusty", "")], "id int, title string, comment string")
    index = fulltext.index(docs, "id", ["title", "comment"]).cache()
    found = lambda q: sorted(r.id for r in fulltext.match(index, q).collect())
    assert found("dusty synth") == [3, 4] and found('"dusty synth"') == [3]
    assert found("boom") == [1] and found("hat OR kick") == [1, 2] and found("synth NOT warm") == [4]
    assert found("du*") == [3, 4] and found("comment:warm") == [3] and found("title:warm") == []
    assert found("(kick OR hat) AND closed") == [2]
    for bad in ("", '"open', "AND x", "(a", "a )", "NOT", "..."):
        with pytest.raises(ValueError):
            fulltext.match(index, bad)
