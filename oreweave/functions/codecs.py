"""Sample decoders as numpy functions and Arrow UDFs: bytes to numbers in [-1, 1)."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Step sizes and index changes of IMA ADPCM, and the Fibonacci steps of 8SVX (fixed values of the published formats).
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]
FIBONACCI = [-34, -21, -13, -8, -5, -3, -2, -1, 0, 1, 2, 3, 5, 8, 13, 21]


def pcm(data: bytes, bits: int = 16, big: bool = False, floating: bool = False) -> np.ndarray:
    """Linear samples; 8 bits are unsigned; a torn last sample is dropped."""
    size = bits // 8
    data = data[: len(data) // size * size]
    order = ">" if big else "<"
    if floating:
        return np.frombuffer(data, dtype=f"{order}f{size}").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)[:, :: -1 if big else 1].astype(np.int64)
        value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        return np.where(value >= 1 << 23, value - (1 << 24), value) / float(1 << 23)
    return np.frombuffer(data, dtype=f"{order}i{size}").astype(np.float64) / float(1 << bits - 1)


def mu_law(data: bytes) -> np.ndarray:
    v = ~np.frombuffer(data, dtype=np.uint8).astype(np.int64) & 0xFF
    size = (((v & 15) << 3) + 132 << (v >> 4 & 7)) - 132
    return np.where(v & 128, -size, size) / 32768.0


def a_law(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, dtype=np.uint8).astype(np.int64) ^ 0x55
    segment, low = v >> 4 & 7, v & 15
    size = np.where(segment == 0, (low << 4) + 8, (low << 4) + 264 << np.maximum(segment - 1, 0))
    return np.where(v & 128, size, -size) / 32768.0


def ima_block(data: bytes) -> np.ndarray:
    """One mono block: first sample, step index, a zero byte, then two samples a byte, low half first."""
    if len(data) < 4:
        return np.empty(0)
    value, index = int.from_bytes(data[:2], "little", signed=True), min(88, data[2])
    out = [value]
    for byte in data[4:]:
        for code in (byte & 15, byte >> 4):
            step = IMA_STEPS[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + IMA_INDEX[code & 7]))
            out.append(value)
    return np.array(out) / 32768.0


def fibonacci_delta(data: bytes) -> np.ndarray:
    """A pad byte, the first sample, then two steps a byte, high half first; eight bits that wrap around."""
    if len(data) < 2:
        return np.empty(0)
    codes = np.frombuffer(data[2:], dtype=np.uint8)
    steps = np.array(FIBONACCI)[np.column_stack([codes >> 4, codes & 15]).ravel()]
    total = int.from_bytes(data[1:2], "little", signed=True) + np.cumsum(steps)
    return ((total + 128) % 256 - 128) / 128.0


#: MS ADPCM: factors of the step, and the seven standard coefficient pairs (fixed values of the published format).
MS_FACTORS = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]
MS_PAIRS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]


def ms_adpcm_block(data: bytes, channels: int = 1) -> np.ndarray:
    """One block, channels interleaved: a pair number, a step and two samples of each, then a nibble a sample, high half first."""
    if len(data) < 7 * channels:
        return np.empty(0)
    word = lambda at: int.from_bytes(data[at : at + 2], "little", signed=True)
    pairs = [MS_PAIRS[min(data[c], len(MS_PAIRS) - 1)] for c in range(channels)]
    steps, one, two = ([word(channels + 2 * (k * channels + c)) for c in range(channels)] for k in range(3))
    out = [*two, *one]
    for i, code in enumerate(x for byte in data[7 * channels :] for x in (byte >> 4, byte & 15)):
        c = i % channels
        value = (one[c] * pairs[c][0] + two[c] * pairs[c][1] >> 8) + (code - 16 if code & 8 else code) * steps[c]
        value = max(-32768, min(32767, value))
        out.append(value)
        one[c], two[c], steps[c] = value, one[c], max(16, MS_FACTORS[code] * steps[c] >> 8)
    return np.array(out) / 32768.0


#: Filters of the four-bit console formats, as 64ths (fixed values of the published formats).
SPU_FILTERS = [(0, 0), (60, 0), (115, -52), (98, -55), (122, -60)]


def spu_adpcm(data: bytes) -> np.ndarray:
    """Blocks of 16 bytes: shift and filter, flags, then 28 samples, low half first; ends after a block whose flag says so."""
    out, one, two = [], 0, 0
    for at in range(0, len(data) - 15, 16):
        shift, kind = data[at] & 15, min(data[at] >> 4, len(SPU_FILTERS) - 1)
        a, b = SPU_FILTERS[kind]
        if data[at + 1] & 7 == 7:
            break
        for byte in data[at + 2 : at + 16]:
            for code in (byte & 15, byte >> 4):
                value = ((code - 16 if code & 8 else code) << 12 >> min(shift, 12)) + (one * a + two * b + 32 >> 6)
                one, two = max(-32768, min(32767, value)), one
                out.append(one)
        if data[at + 1] & 1:
            break
    return np.array(out) / 32768.0


def brr(data: bytes) -> np.ndarray:
    """Blocks of nine bytes: a header of range, filter, loop and end, then sixteen samples, high half first."""
    out, one, two = [], 0, 0
    for at in range(0, len(data) - 8, 9):
        shift, kind = data[at] >> 4, data[at] >> 2 & 3
        for byte in data[at + 1 : at + 9]:
            for code in (byte >> 4, byte & 15):
                code = code - 16 if code & 8 else code
                value = code << shift >> 1 if shift <= 12 else -2048 if code < 0 else 0
                if kind == 1:
                    value += one - (one >> 4)
                elif kind == 2:
                    value += (one << 1) - (one * 3 >> 5) - two + (two >> 4)
                elif kind == 3:
                    value += (one << 1) - (one * 13 >> 6) - two + (two * 3 >> 4)
                value = max(-32768, min(32767, value))
                # Fifteen bits, that wrap around.
                value = (value * 2 + 32768) % 65536 - 32768 >> 1
                one, two = value, one
                out.append(value)
        if data[at] & 1:
            break
    return np.array(out) / 16384.0


def dsp_adpcm(data: bytes, pairs: list[tuple[int, int]], count: int) -> np.ndarray:
    """Frames of eight bytes: pair number and scale, then fourteen samples, high half first; pairs are 2048ths."""
    out, one, two = [], 0, 0
    for at in range(0, len(data), 8):
        if len(out) >= count:
            break
        a, b = pairs[min(data[at] >> 4, len(pairs) - 1)]
        scale = 1 << (data[at] & 15)
        for byte in data[at + 1 : at + 8]:
            for code in (byte >> 4, byte & 15):
                value = ((code - 16 if code & 8 else code) * scale << 11) + 1024 + a * one + b * two >> 11
                one, two = max(-32768, min(32767, value)), one
                out.append(one)
    return np.array(out[:count]) / 32768.0


def adx(data: bytes, rate: int, highpass: int = 500) -> np.ndarray:
    """Mono frames of 18 bytes: a scale, then 32 samples, high half first; the filter follows from the rate."""
    z = math.cos(2 * math.pi * highpass / rate)
    a, b = math.sqrt(2) - z, math.sqrt(2) - 1
    c = (a - math.sqrt((a + b) * (a - b))) / b
    first, second = int(c * 8192), int(c * c * -4096)
    out, one, two = [], 0, 0
    for at in range(0, len(data) - 17, 18):
        scale = int.from_bytes(data[at : at + 2], "big") + 1
        if data[at] & 0x80:
            break
        for byte in data[at + 2 : at + 18]:
            for code in (byte >> 4, byte & 15):
                value = (code - 16 if code & 8 else code) * scale + (first * one + second * two >> 12)
                one, two = max(-32768, min(32767, value)), one
                out.append(one)
    return np.array(out) / 32768.0


def delta(data: bytes, bits: int = 8) -> np.ndarray:
    """Differences of signed samples, that wrap around."""
    steps = np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], dtype=f"<i{bits // 8}").astype(np.int64)
    half = 1 << bits - 1
    return ((np.cumsum(steps) + half) % (2 * half) - half) / float(half)


def packed_deltas(data: bytes, count: int, wide: bool = False, twice: bool = False) -> tuple[np.ndarray, int]:
    """Packed tracker samples: blocks of differences in numbers of changing width, and the place after them.

    A block begins with its length and holds 32 KB of samples. Narrow numbers change the width by their smallest value and
    three (or four) bits more, middle ones by values around the largest, full ones by their top bit. twice: differences of
    differences. A stream that ends early gives what it has.
    """
    bits, low = (17, 4) if wide else (9, 3)
    size, full, at, out = (0x4000 if wide else 0x8000), 1 << bits - 1, 0, []
    wrap = lambda x: (x + full // 2) % full - full // 2
    while len(out) < count and at + 2 <= len(data):
        length = int.from_bytes(data[at : at + 2], "little")
        block, at = data[at + 2 : at + 2 + length], at + 2 + length
        stream, left, width, one, two, made = int.from_bytes(block, "little"), 8 * len(block), bits, 0, 0, 0
        place = 0
        while made < size and len(out) < count and width <= left - place:
            value, place = stream >> place & (1 << width) - 1, place + width
            if width < 7:
                if value == 1 << width - 1:
                    value, place = (stream >> place & (1 << low) - 1) + 1, place + low
                    width = value if value < width else value + 1
                    continue
            elif width < bits:
                border = (full - 1 >> bits - width) - (1 << low - 1)
                if border < value <= border + (1 << low):
                    value -= border
                    width = value if value < width else value + 1
                    continue
            elif value & full:
                width = value + 1 & 0xFF
                if not 0 < width <= bits:
                    return np.array(out, dtype=np.int64), at
                continue
            one = wrap(one + (value - (1 << width) if width < bits and value >= 1 << width - 1 else value))
            two = wrap(two + one)
            out.append(two if twice else one)
            made += 1
    return np.array(out, dtype=np.int64), at


@functools.cache
def crc_table(polynomial: int, bits: int) -> list[int]:
    """What each byte does to a cyclic checksum that is empty."""
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return out


def crc8(data: bytes, polynomial: int = 0x07, crc: int = 0) -> int:
    table = crc_table(polynomial, 8)
    for byte in data:
        crc = table[crc ^ byte]
    return crc


def crc16(data: bytes, polynomial: int = 0x8005, crc: int = 0) -> int:
    """crc: of what comes before."""
    table = crc_table(polynomial, 16)
    for byte in data:
        crc = crc << 8 & 0xFFFF ^ table[crc >> 8 ^ byte]
    return crc


def udf(decode: Callable[[bytes], np.ndarray]) -> Callable[[Column], Column]:
    """A column function array<double> of a decoder; null bytes give null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in batches:
            yield data.map(lambda x: None if x is None else decode(bytes(x)))

    return run
