"""Frames of compressed sound: MPEG audio headers and their chains, FLAC frames and their checksums, Ogg pages."""

from __future__ import annotations

import numpy as np

from oreweave.functions import codecs

#: Bit rates (kbit/s) by table and sample rates by version: fixed values of ISO 11172-3 and 13818-3.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 25: [11025, 12000, 8000]}
#: Fewest frames of a chain, and the largest share of 0xFF in its bytes.
LEAST_FRAMES, MOST_FF = 12, 0.10


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Frame length and family (version, layer, rate; 0: no header) by the 16 bits of a header's second and third byte."""
    length, family = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for x in range(0xE000, 1 << 16):
        version = {0: 25, 2: 2, 3: 1}.get(x >> 11 & 3)
        layer, bits, rate = 4 - (x >> 9 & 3), x >> 4 & 15, x >> 2 & 3
        if version is None or layer == 4 or bits in (0, 15) or rate == 3:
            continue
        hz, speed = RATES[version][rate], 1000 * BITRATES[min(version, 2), layer][bits]
        if layer == 1:
            n = (12 * speed // hz + (x >> 1 & 1)) * 4
        else:
            n = (144 if layer == 2 or version == 1 else 72) * speed // hz + (x >> 1 & 1)
        length[x], family[x] = n, (version * 4 + layer) * 4 + rate + 1
    return length, family


_LENGTH, _FAMILY = _tables()


def mpeg_header(data: bytes, at: int) -> dict | None:
    """Version, layer, rate, bit rate and length of the frame header at a place, None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or not (n := int(_LENGTH[data[at + 1] << 8 | data[at + 2]])):
        return None
    x = data[at + 1] << 8 | data[at + 2]
    version, layer = {0: 25, 2: 2, 3: 1}[x >> 11 & 3], 4 - (x >> 9 & 3)
    return {"version": {25: "2.5", 2: "2", 1: "1"}[version], "layer": layer, "rate": RATES[version][x >> 2 & 3], "kbps": BITRATES[min(version, 2), layer][x >> 4 & 15], "length": n}


def mpeg_streams(data: bytes, least: int = LEAST_FRAMES) -> list[tuple[int, int, int]]:
    """(start, end, frames) of the chains of at least `least` frames of one version, layer and rate, from the left."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < 4:
        return []
    at = np.flatnonzero((raw[:-3] == 0xFF) & (raw[1:-2] >= 0xE0))
    header = raw[at + 1].astype(np.int64) << 8 | raw[at + 2]
    at, header = at[_LENGTH[header] > 0], header[_LENGTH[header] > 0]
    if not len(at):
        return []
    ends, family = at + _LENGTH[header], _FAMILY[header]
    # The next frame of each: a header of its family where it ends. Chains are counted by pointer doubling.
    after = np.minimum(np.searchsorted(at, ends), len(at) - 1)
    linked = (at[after] == ends) & (family[after] == family)
    none = len(at)
    jump, count = np.append(np.where(linked, after, none), none), np.append(np.ones(len(at), dtype=np.int64), 0)
    last = np.append(np.where(linked, after, np.arange(len(at))), none)
    while (jump[:-1] != none).any():
        count += count[jump]
        last = np.where(jump != none, last[jump], last)
        jump = jump[jump]
    out, free = [], 0
    for i in np.flatnonzero(count[:-1] >= least).tolist():
        start, end = int(at[i]), int(min(ends[last[i]], len(raw)))
        if start >= free and float((raw[start:end] == 0xFF).mean()) <= MOST_FF:
            out.append((start, end, int(count[i])))
            free = end
    return out


def mpeg_validity(data: bytes) -> dict[str, int]:
    """Frames that follow one upon the other, bytes between them, and whether the last one is cut off."""
    at, frames, stray, cut = 0, 0, 0, 0
    while 0 <= at < len(data) - 3:
        h = mpeg_header(data, at)
        if h is None:
            to = data.find(b"\xff", at + 1)
            stray += (to if to >= 0 else len(data)) - at
            at = to
        elif at + h["length"] > len(data):
            cut, at = 1, len(data)
        else:
            frames, at = frames + 1, at + h["length"]
    return {"frames": frames, "stray": stray, "cut": cut}


def _coded_number(data: bytes, at: int) -> int:
    """Bytes of the UTF-8 like number at a place; 0 if it is none."""
    lead = 8 - (data[at] ^ 0xFF).bit_length() if at < len(data) else 1
    if lead in (1, 8) or at + max(1, lead) > len(data):
        return 0
    return max(1, lead) if all(b & 0xC0 == 0x80 for b in data[at + 1 : at + lead]) else 0


def flac_header(data: bytes, at: int) -> int:
    """Length of the frame header at a place, its CRC-8 being right; 0 if there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return 0
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    n = _coded_number(data, at + 4)
    if not size or rate == 15 or not n:
        return 0
    end = at + 4 + n + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return end + 1 - at if end < len(data) and codecs.crc8(data[at:end]) == data[end] else 0


def flac_frames(data: bytes, start: int, ahead: int = 64) -> list[tuple[int, int, str]]:
    """(start, end, state) of the frames from a place on: ok, bad, or unverified for a last frame that ends with the file.

    A frame ends where a later header begins (one of the next `ahead` candidates) before which its CRC-16 is right.
    """
    heads, at = [], data.find(b"\xff", start)
    while at >= 0:
        if flac_header(data, at):
            heads.append(at)
        at = data.find(b"\xff", at + 1)
    out, i = [], 0
    while i < len(heads):
        # The checksum runs on from candidate to candidate.
        state, done, end = "bad", heads[i], heads[i + 1] if i + 1 < len(heads) else len(data)
        crc, to = 0, i + 1
        for j in range(i + 1, min(len(heads), i + ahead) + 1):
            stop = heads[j] if j < len(heads) else len(data)
            if stop - heads[i] > 2:
                crc, done = codecs.crc16(data[done : stop - 2], crc=crc), stop - 2
                if crc == int.from_bytes(data[done:stop], "big"):
                    state, end, to = "ok", stop, j
                    break
        else:
            state = "unverified" if i + 1 == len(heads) else "bad"
        out.append((heads[i], end, state))
        i = to
    return out


def ogg_page(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Length, flags and serial of the page at a place; None if there is none or it runs past the end."""
    if data[at : at + 4] != b"OggS" or at + 27 > len(data) or data[at + 4]:
        return None
    n = data[at + 26]
    length = 27 + n + sum(data[at + 27 : at + 27 + n])
    return (length, data[at + 5], int.from_bytes(data[at + 14 : at + 18], "little")) if at + length <= len(data) else None


def ogg_streams(data: bytes) -> list[tuple[int, int, list[int], bool]]:
    """(start, end, serials, whole): runs of pages from a first page to where all streams that have begun are at their end."""
    out, at = [], data.find(b"OggS")
    start, begun, seen = -1, set(), []
    while at >= 0:
        page = ogg_page(data, at)
        if page is None or start < 0 and not page[1] & 2:
            if start >= 0:
                out.append((start, at, sorted(set(seen)), False))
                start = -1
            at = data.find(b"OggS", at + 1)
            continue
        if start < 0:
            start, begun, seen = at, set(), []
        length, flags, serial = page
        seen.append(serial)
        begun = (begun | {serial} if flags & 2 else begun) - ({serial} if flags & 4 else set())
        at += length
        if flags & 4 and not begun:
            out.append((start, at, sorted(set(seen)), True))
            start, at = -1, data.find(b"OggS", at)
        elif data[at : at + 4] != b"OggS":
            out.append((start, at, sorted(set(seen)), False))
            start, at = -1, data.find(b"OggS", at)
    return out
