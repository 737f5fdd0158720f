"""Musical keys and tempi as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch classes of note names (fixed values of music notation).
PITCH = {"C": 0, "C#": 1, "DB": 1, "D": 2, "D#": 3, "EB": 3, "E": 4, "FB": 4, "F": 5, "E#": 5, "F#": 6, "GB": 6, "G": 7, "G#": 8, "AB": 8, "A": 9, "A#": 10, "BB": 10, "B": 11, "CB": 11, "B#": 0}
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


#: A key as people write it: a note, a mode, an octave that says nothing (`Dm7` is D minor); or a place on the Camelot wheel.
_NOTE = "^([A-Ga-g][#b]?)\\s*(m|min|minor|maj|major|M)?\\s*[0-9]*$"
_WHEEL = "^(1[0-2]|0?[1-9])\\s*([ABab])$"


def _written(key: Column) -> tuple[Column, Column, Column, Column]:
    """Note, mode, wheel number and wheel letter of a key; empty where it has none."""
    clean = F.trim(key)
    return tuple(F.regexp_extract(clean, p, i) for p in (_NOTE, _WHEEL) for i in (1, 2))


def pitch_class(key: Column) -> Column:
    """0 to 11 of a key's root; null if the text is no key."""
    note, _, number, letter = _written(key)
    named = F.element_at(F.create_map(*(F.lit(x) for kv in PITCH.items() for x in kv)), F.when(note != "", F.upper(note)))
    # Seven steps a number, as seven is its own inverse modulo 12; a minor root lies three below its relative major's.
    major = (F.when(number != "", number).cast("int") + 4) * 7 % 12
    return F.coalesce(named, F.when(F.upper(letter) == "A", (major + 9) % 12).otherwise(major))


def is_minor(key: Column) -> Column:
    """Whether a key is minor; null if the text is no key. A capital M alone is major."""
    note, mode, number, letter = _written(key)
    return F.when(note != "", mode.isin("m", "min", "minor")).when(number != "", F.upper(letter) == "A")


def camelot_number(pitch: Column, minor: Column) -> Column:
    """1 to 12 around the circle of fifths; a major key and its relative minor share a number."""
    major = F.when(minor, (pitch + 3) % 12).otherwise(pitch)
    return (major * 7 + 7) % 12 + 1


def _code(pitch: int, minor: bool) -> str:
    """As camelot_number has it."""
    major = (pitch + 3) % 12 if minor else pitch
    return f"{(major * 7 + 7) % 12 + 1}{'A' if minor else 'B'}"


def camelot(key: Column) -> Column:
    """`8A` (minor) or `8B` (major), null for what is no key: one lookup of the note and its mode."""
    note, mode, number, letter = _written(key)
    codes = {n + m: _code(p, m == "m") for n, p in PITCH.items() for m in ("", "m")}
    spelt = F.concat(F.upper(note), F.when(mode.isin("m", "min", "minor"), "m").otherwise(""))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.when(note != "", spelt))
    return F.coalesce(named, F.when(number != "", F.concat(number.cast("int").cast("string"), F.upper(letter))))


def neighbours(code: Column) -> Column:
    """[same, relative, one down, one up] of a Camelot code."""
    number, letter = F.regexp_extract(code, "^([0-9]+)", 1).try_cast("int"), F.right(code, F.lit(1))
    other = F.when(letter == "A", "B").otherwise("A")
    step = lambda n: F.concat(((number + n + 11) % 12 + 1).cast("string"), letter)
    return F.when(code.isNotNull(), F.array(code, F.concat(number.cast("string"), other), step(-1), step(1)))


def enharmonic(pitch: Column) -> Column:
    """All spellings of a pitch class, sorted."""
    spelt = [sorted(n[0] + n[1:].replace("B", "b") for n, p in PITCH.items() if p == i) for i in range(12)]
    return F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in spelt)), pitch + 1)


def note_name(midi: Column) -> Column:
    """Middle C (60) is C3."""
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (midi % 12 + 1).cast("int")), (F.floor(midi / 12) - 2).cast("string"))


def vetted_beats(beats: Column, one_shot: Column, bpm: Column, duration: Column) -> Column:
    """Beats of a loop; of what is flagged a one-shot only if they fit its duration within 15 %."""
    fits = F.abs(beats / bpm * 60 - duration) / duration < 0.15
    return F.when(F.coalesce(beats, F.lit(0)) == 0, None).when(~one_shot, beats).when(fits, beats)


def bpm_from_name(name: Column) -> Column:
    """The first tempo from 60 to 300 that a file name tells, its extension cut, patterns by priority.

    A number before `bpm`, then one after it, then a number of two or three digits that no letter, digit or dot touches.
    Borders have no width, so numbers that share a separator are all seen.
    """
    clean = F.regexp_replace(F.lower(name), "(?<=.)\\.[^.]*$", "")
    patterns = ["([0-9]{2,3})\\s*bpm", "bpm\\s*([0-9]{2,3})", "(?<![0-9.a-z])([0-9]{2,3})(?![0-9.a-z])"]
    found = [F.filter(F.transform(F.regexp_extract_all(clean, F.lit(p), F.lit(1)), lambda x: x.cast("double")), lambda x: (x >= 60) & (x <= 300)) for p in patterns]
    return F.coalesce(*(F.get(a, 0) for a in found))


def improved_bpm(detected: Column, named: Column) -> Column:
    """A detected tempo against the one of the file name: doubled, halved or dotted readings within 20 count as agreement."""
    close = [F.when(F.abs(detected * f - named) <= 20, detected * f) for f in (1.0, 2.0, 0.5, 1.5, 1 / 1.5)]
    inside = (detected >= 60) & (detected <= 200)
    return F.when(~inside | detected.isNull(), named).when(named.isNull(), detected).otherwise(F.coalesce(*close, detected))


#: Flats as sharps (fixed values of music notation).
SHARPS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#", "Cb": "B", "Fb": "E"}


def sharp_root(note: Column) -> Column:
    """A note with a capital letter, flats as sharps; null for no text."""
    spelt = F.concat(F.upper(F.left(note, F.lit(1))), F.lower(F.substring(note, 2, 2)))
    return F.when(note != "", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SHARPS.items() for x in kv)), spelt), spelt))


def key_from_name(name: Column) -> Column:
    """The key that a file name spells out with its mode; null if it doesn't.

    Words count in any case, major ones first. A small m may touch the note; a capital M is major, and may touch only a
    note with an accidental, as `FM` and `AM` are words of their own.
    """
    clean = F.translate(name, "_-", "  ")
    root = lambda pattern: sharp_root(F.regexp_extract(clean, pattern, 1))
    minor = lambda pattern: F.concat(root(pattern), F.lit("m"))
    worded = lambda word: f"(?i)\\b([A-G][#b]?)\\s*{word}\\b"
    return F.coalesce(root(worded("major")), root(worded("maj")), minor(worded("minor")), minor(worded("min")), minor("\\b([A-G][#b]?)m\\b"), root("\\b([A-G][#b])M\\b"), root("\\b([A-G])\\s+M\\b"))


def bare_key(token: Column) -> Column:
    """The key that a whole word is (`A#`, `Em`, `Bb`), null if it is none."""
    root = sharp_root(F.regexp_extract(token, "^([A-G][#b]?)m?$", 1))
    return F.concat(root, F.when(F.endswith(token, F.lit("m")), "m").otherwise(""))


def key_from_words(text: Column) -> Column:
    """The first word that is a key; a major one is minor if the word beside it says so (`min_C`, `C_minadd9`)."""
    words = F.filter(F.split(text, "[_\\-.\\s]+"), lambda w: w != "")
    mode = lambda w: F.when(w.rlike("(?i)^min(or)?(add)?[0-9]*$"), "m").when(w.rlike("(?i)^maj(or)?(add)?[0-9]*$"), "")

    def key(word: Column, i: Column) -> Column:
        beside = F.coalesce(mode(F.get(words, i - 1)), mode(F.get(words, i + 1)), F.lit(""))
        found = bare_key(word)
        return F.when(F.endswith(found, F.lit("m")), found).otherwise(F.concat(found, beside))

    return F.get(F.filter(F.transform(words, key), lambda k: k.isNotNull()), 0)


def key_from_path(path: Column, parents: int = 3) -> Column:
    """The key of a file name with its mode, else the first bare one in its stem or the folders above it, inside out."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    part = lambda i: F.try_element_at(parts, F.lit(-1 - i))
    stem = F.regexp_replace(part(0), "(?<=.)\\.[^.]*$", "")
    return F.coalesce(key_from_name(part(0)), key_from_words(stem), *(key_from_words(part(i + 1)) for i in range(parents)))


def fused_key(detected: Column, named: Column) -> Column:
    """A file name's key wins over a detected one."""
    return F.coalesce(named, detected)
