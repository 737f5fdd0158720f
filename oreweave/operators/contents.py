"""Tables of contents in unknown archives: names at a steady stride, columns that place and size payloads, and a check by magic.

A name is a run of printable characters with an extension that ends at a zero. Three more names at the same distance from
one propose a stride; the chain goes on both ways as far as names go. In the records so found, each four-byte column of
either byte order is tried as offsets and as sizes: offsets rise and lie in the file, sizes fit between them. Payloads that
begin with the magic number of their name's extension make a table surer. Of tables that overlap, the surest stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from oreweave.operators import bytestrings as bs

NAME = re.compile(rb"(?<![A-Za-z0-9_])[A-Za-z0-9_][\w !#$%&'()+,./@\[\]^{}~-]{0,60}\.[A-Za-z0-9]{1,4}(?=\0)")
#: Bytes between names, names that one is compared with, records that make a table, tables a file may have.
STRIDES, AHEAD, LEAST, MOST = (8, 512), 6, 4, 6
#: Bytes of a record before its name.
LEADS = (0, 4, 8, 12, 16)
MAGIC = {b"wav": (b"RIFF", b"RIFX", b"RF64"), b"aif": (b"FORM",), b"aiff": (b"FORM",), b"mid": (b"MThd",), b"ogg": (b"OggS",), b"flac": (b"fLaC",), b"mp3": (b"ID3", b"\xff\xfb", b"\xff\xf3"), b"png": (b"\x89PNG",), b"jpg": (b"\xff\xd8\xff",), b"zip": (b"PK",), b"vag": (b"VAGp",), b"au": (b".snd",), b"xm": (b"Extended",), b"it": (b"IMPM",)}


def strides(places: list[int], more: set[int] = frozenset()) -> list[tuple[int, list[int]]]:
    """(stride, places) of the chains of at least LEAST names at one distance, longest first; each is as long as it can be.

    more: places where a name may begin too, as a printable byte of a number stands before it.
    """
    known, out, seen = {*places, *more}, [], set()
    for i, p in enumerate(places):
        for q in places[i + 1 : i + 1 + AHEAD]:
            s = q - p
            if not STRIDES[0] <= s <= STRIDES[1] or (s, p) in seen or not {p + 2 * s, p + 3 * s} <= known:
                continue
            first, last = p, p
            while first - s in known:
                first -= s
            while last + s in known:
                last += s
            chain = list(range(first, last + 1, s))
            seen |= {(s, x) for x in chain}
            if len(chain) >= LEAST:
                out.append((s, chain))
    return sorted(out, key=lambda x: (-len(x[1]), x[0], x[1][0]))


def columns(raw: np.ndarray, starts: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Four-byte numbers at these places from each start by byte order, a row a place. Beyond the file is its last byte."""
    at = places[:, None] + starts
    a, b, c, d = (raw[np.clip(at + k, 0, len(raw) - 1)].astype(np.int64) for k in range(4))
    return {"<": a | b << 8 | c << 16 | d << 24, ">": a << 24 | b << 16 | c << 8 | d}


def rising(found: dict[str, np.ndarray], size: int) -> dict[str, tuple[list[int], list[int]]]:
    """The rows whose numbers rise and lie in the file, and the sum of each row."""
    return {order: (((v[:, -1] < size) & (v[:, 1:] > v[:, :-1]).all(1)).nonzero()[0].tolist(), v.sum(1).tolist()) for order, v in found.items()}


def placed(places: list[int], found: dict[str, np.ndarray], offsets: dict[str, tuple[list[int], list[int]]], window: tuple[int, int], table: tuple[int, int], size: int) -> tuple | None:
    """The score, places and sizes of the columns that fit best as offsets and as sizes; found has a row for each of places.

    Offsets are rows that rise (see rising), and count from the file's start or from the table's end. They reach past the table, and each
    payload ends in the file and not behind the next one's start. Both columns are among the rows of window; each of offsets
    is held against all of sizes at once.
    """
    best = None
    for order, numbers in found.items():
        steady, totals = offsets[order]
        for i in steady:
            if not window[0] <= i < window[1]:
                continue
            for base in (0, table[1]):
                first, last = int(numbers[i, 0]) + base, int(numbers[i, -1]) + base
                if last >= size or (base == 0 and first < table[1] and last > table[0]):
                    continue
                at = numbers[i] + base
                room = np.empty_like(at)
                room[:-1], room[-1] = at[1:] - at[:-1], size - last
                fit = ((numbers[window[0] : window[1]] <= room).all(1).nonzero()[0] + window[0]).tolist()
                for j in fit:
                    d, total = places[j] - places[i], totals[j]
                    if total and abs(d) >= 4:
                        # Columns side by side, that fill what there is, are the likeliest.
                        score = (total / max(1, size - first), d == 4, -places[i], order == "<")
                        if best is None or score > best[0]:
                            best = (score, at, numbers[j])
    return best


def confidence(count: int, fill: float, shared: float) -> float:
    """Of a table: its length, how much of what follows its payloads fill, the share that begins as its name says."""
    return round(min(0.85, (0.25 + 0.35 * min(1.0, count / 12)) * (0.5 + 0.5 * fill) * (0.8 + 0.6 * shared)), 3)


def discover(data: bytes) -> list[dict]:
    """Entries of the tables in data: table, name, offset, size, confidence, known (the magic is that of the name)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    names = {m.start(): m[0] for m in NAME.finditer(data)}
    first = sorted(names)
    for p in first:
        names |= {p + k: names[p][k:] for k in (1, 2, 3) if len(names[p]) > k + 4 and names[p][k : k + 1].isalnum()}
    tables: list[tuple[float, int, int, list[dict]]] = []
    for stride, chain in strides(first, names.keys()):
        # Records begin at their name or up to 16 bytes before it: where payloads fit their names and the space best.
        ways = []
        longest = max(len(names[p]) for p in chain)
        around = np.arange(-LEADS[-1], stride - 3)
        around = around[(around <= -4) | (around >= longest)]
        places, heads = around.tolist(), np.array(chain)
        labels = [(names[p].decode("latin-1"), MAGIC.get(names[p].rpartition(b".")[2].lower())) for p in chain]
        numbers = columns(raw, heads, around)
        seen = {len(chain): (numbers, rising(numbers, len(raw)))}
        for lead in LEADS:
            if chain[0] < lead:
                break
            # The last record may not end in the file.
            count = len(chain) - (chain[-1] - lead + stride > len(raw))
            if count < LEAST:
                continue
            if count not in seen:
                fewer = {order: v[:, :count] for order, v in numbers.items()}
                seen[count] = (fewer, rising(fewer, len(raw)))
            span = (chain[0] - lead, chain[count - 1] - lead + stride)
            window = (bisect_left(places, -lead), bisect_left(places, stride - 3 - lead))
            fit = placed(places, *seen[count], window, span, len(raw))
            if fit is None:
                continue
            (fill, *_), at, sizes = fit
            rows = []
            for (name, magic), a, n in zip(labels, at.tolist(), sizes.tolist(), strict=False):
                rows.append({"name": name, "offset": a, "size": n, "known": bool(magic) and data.startswith(magic, a)})
            shared = sum(r["known"] for r in rows) / len(rows)
            ways.append((shared, round(fill, 6), len(rows), -lead, (confidence(len(rows), min(1.0, fill), shared), *span, rows)))
        if ways:
            tables.append(max(ways, key=lambda w: w[:4])[4])
    out, kept = [], []
    for sure, a, b, rows in sorted(tables, key=lambda t: (-t[0], t[1], t[2])):
        if len(kept) < MOST and not any(a < y and x < b for x, y in kept):
            kept.append((a, b))
            out += [{"table": a, "confidence": sure, **r} for r in rows]
    return sorted(out, key=lambda r: (r["table"], r["offset"]))


def discovered(files: DataFrame) -> DataFrame:
    """file, table, name, offset, size, known, confidence of the entries of tables in files (file, data)."""

    def found(data: np.ndarray) -> dict:
        rows = discover(data.tobytes())
        return {c: [r[c] for r in rows] for c in ("table", "name", "offset", "size", "known", "confidence")}

    return bs.per_file(files, "table long, name string, offset long, size long, known boolean, confidence double", found)
