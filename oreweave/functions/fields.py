"""Typed fields of bytes: specifications such as `u16le`, both byte orders, bit fields, packed vectors."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreweave.operators import bytestrings as bs

_SPEC = re.compile(r"(u|i|f)(8|16|24|32|48|64)(le|be)?|(s|x)(\d+)")


def parse(spec: str) -> tuple[str, int, bool]:
    """Kind (u, i, f, s for text, x for bytes), size in bytes, little-endian. ValueError if it is none."""
    m = _SPEC.fullmatch(spec.strip().lower())
    if not m or m[1] == "f" and m[2] not in ("32", "64"):
        raise ValueError(f"no type: {spec!r}")
    if m[4]:
        return m[4], int(m[5]), True
    return m[1], int(m[2]) // 8, m[3] != "be"


def read(data: Column, at: Column, spec: str) -> Column:
    """The field at a place; null where the bytes end before it does. 64-bit numbers are signed."""
    kind, size, little = parse(spec)
    part, fits = F.substring(data, at + 1, F.lit(size)), at + size <= F.octet_length(data)
    if kind == "x":
        return F.when(fits, part)
    if kind == "s":
        return F.when(fits, F.rtrim(F.regexp_replace(F.decode(part, "ISO-8859-1"), "\\x00.*$", "")))
    if kind == "f":
        return F.when(fits, _floats(part, F.lit(f"{'<' if little else '>'}f{size}")))
    digits = F.hex(part)
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(size)]
    pairs = pairs[::-1] if little else pairs
    if size == 8:
        # Two halves, as `conv` stops at the largest signed number.
        high, low = (F.conv(F.concat(*half), 16, 10).cast("long") for half in (pairs[:4], pairs[4:]))
        return F.when(fits, F.shiftleft(high, 32).bitwiseOR(low))
    value = F.conv(F.concat(*pairs), 16, 10).cast("long")
    return F.when(fits, F.when(value >= 1 << 8 * size - 1, value - (1 << 8 * size)).otherwise(value) if kind == "i" else value)


@F.pandas_udf(T.DoubleType())
def _floats(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else float(np.frombuffer(x, dtype=k)[0]) for x, k in zip(data, kind, strict=True)], dtype="float64")


def both_orders(data: Column, at: Column, spec: str) -> Column:
    """struct<le, be> of a field."""
    plain = re.sub("(le|be)$", "", spec.strip().lower())
    return F.struct(read(data, at, plain + "le").alias("le"), read(data, at, plain + "be").alias("be"))


def write(value: Column, spec: str) -> Column:
    """The bytes of a whole number; null if it doesn't fit."""
    kind, size, little = parse(spec)
    if kind not in "ui":
        raise ValueError(f"no whole number: {spec!r}")
    low, high = (0, (1 << 8 * size) - 1) if kind == "u" else (-(1 << 8 * size - 1), (1 << 8 * size - 1) - 1)
    digits = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1 if size < 8 else -1))), 2 * size, "0")
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(size)]
    fits = F.lit(True) if size == 8 else value.between(low, high)
    return F.when(fits, F.unhex(F.concat(*(pairs[::-1] if little else pairs))))


def bits(value: Column, low: int, count: int) -> Column:
    """`count` bits of a whole number from bit `low` up."""
    return F.shiftrightunsigned(value.cast("long"), low).bitwiseAND(F.lit((1 << count) - 1))


def with_bits(value: Column, low: int, count: int, new: Column) -> Column:
    """value with these bits replaced; null if new has more."""
    mask = (1 << count) - 1
    return F.when(new.between(0, mask), value.cast("long").bitwiseAND(F.lit(~(mask << low))).bitwiseOR(F.shiftleft(new.cast("long"), low)))


#: Encodings that a value may be written in, tried in this order.
ENCODINGS = ("u8", "u16le", "u16be", "u24le", "u24be", "u32le", "u32be", "i8", "i16le", "i16be", "i32le", "i32be")


def encodings_of(raw: Column, value: Column) -> Column:
    """The encodings under which these bytes are this number, and writing it gives the bytes back."""
    tests = [F.when((F.octet_length(raw) == parse(s)[1]) & (read(raw, F.lit(0), s) == value) & (write(value, s) == raw), F.lit(s)) for s in ENCODINGS]
    return F.array_compact(F.array(*tests))


@F.pandas_udf(T.BinaryType())
def pack_vector(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of an array."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def unpack_vector(packed: Column, size: int) -> Column:
    """The array again; null if it has not `size` numbers."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None or len(x) != 4 * size else np.frombuffer(x, dtype="<f4"))

    return run(packed)


def read_pascal(data: bytes, at: int, wide: bool = False) -> tuple[str, int]:
    """Text behind its length (a byte, or four little-endian ones that count UTF-16 units), and the place after it."""
    size = int.from_bytes(data[at : at + 4], "little") * 2 if wide else data[at]
    start = at + (4 if wide else 1)
    if start + size > len(data):
        raise ValueError("the text runs past the end")
    return data[start : start + size].decode("utf-16-le" if wide else "latin-1"), start + size


def read_msgpack(data: bytes, at: int = 0, depth: int = 0):
    """One value of the MessagePack format, and the place after it."""
    if depth > 200:
        raise ValueError("nested too deeply")
    kind = data[at]

    def number(code: str, start: int):
        return struct.unpack_from(">" + code, data, start)[0], start + struct.calcsize(code)

    def raw(size: int, start: int) -> tuple[bytes, int]:
        if start + size > len(data):
            raise ValueError("a value runs past the end")
        return data[start : start + size], start + size

    def items(count: int, start: int) -> tuple[list, int]:
        out = []
        for _ in range(count):
            value, start = read_msgpack(data, start, depth + 1)
            out.append(value)
        return out, start

    def pairs(count: int, start: int) -> tuple[dict, int]:
        flat, start = items(2 * count, start)
        return dict(zip((k if isinstance(k, (str, int, float, bool)) else repr(k) for k in flat[::2]), flat[1::2], strict=True)), start

    if kind < 0x80 or kind >= 0xE0:
        return kind if kind < 0x80 else kind - 256, at + 1
    if kind < 0xC0:
        size, kind = (kind & 15, kind & 0xF0) if kind < 0xA0 else (kind & 31, 0xA0)
        if kind == 0xA0:
            text, end = raw(size, at + 1)
            return text.decode("utf-8", "replace"), end
        return pairs(size, at + 1) if kind == 0x80 else items(size, at + 1)
    if kind in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[kind], at + 1
    if kind in (0xCA, 0xCB) or 0xCC <= kind <= 0xD3:
        return number({0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}[kind], at + 1)
    if kind in (0xC4, 0xC5, 0xC6, 0xD9, 0xDA, 0xDB):
        size, start = number({0xC4: "B", 0xC5: "H", 0xC6: "I", 0xD9: "B", 0xDA: "H", 0xDB: "I"}[kind], at + 1)
        found, end = raw(size, start)
        return (found.decode("utf-8", "replace") if kind >= 0xD9 else found), end
    if kind in (0xDC, 0xDD, 0xDE, 0xDF):
        count, start = number("H" if kind in (0xDC, 0xDE) else "I", at + 1)
        return (items if kind < 0xDE else pairs)(count, start)
    if 0xD4 <= kind <= 0xD8 or 0xC7 <= kind <= 0xC9:
        size, start = (1 << kind - 0xD4, at + 1) if kind >= 0xD4 else number({0xC7: "B", 0xC8: "H", 0xC9: "I"}[kind], at + 1)
        return raw(size + 1, start)
    raise ValueError(f"no value begins with {kind:#x}")


def json_span(data: bytes) -> tuple[dict | None, int]:
    """The first JSON object of a text and where it ends in bytes; whatever follows it doesn't matter. (None, 0) without one."""
    text = data.decode("utf-8", "surrogateescape")
    lead = len(text) - len(text.lstrip("\ufeff \t\r\n"))
    try:
        value, end = json.JSONDecoder().raw_decode(text, lead)
    except ValueError:
        return None, 0
    return (value, len(text[:end].encode("utf-8", "surrogateescape"))) if isinstance(value, dict) else (None, 0)
