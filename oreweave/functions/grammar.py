"""Formats described as data: a descriptor is turned into column expressions, so that headers are read in the JVM.

A descriptor says what must stand where (`guards`), and the fields from there on: name, type, and for packed numbers the bits.
`interpret` gives a struct of them, null where a guard fails or the bytes end too early.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreweave.functions import fields


@dataclass(frozen=True)
class Field:
    name: str
    at: int
    spec: str
    #: Lowest bit, how many, and what is added to them.
    bits: tuple[int, int, int] | None = None


@dataclass(frozen=True)
class Grammar:
    guards: tuple[tuple[int, bytes], ...]
    fields: tuple[Field, ...] = field(default_factory=tuple)


#: Headers of fixed places (fixed values of the published formats).
GRAMMARS = {
    "wav": Grammar(((0, b"RIFF"), (8, b"WAVE"), (12, b"fmt ")), (Field("format_tag", 20, "u16"), Field("channels", 22, "u16"), Field("sample_rate", 24, "u32"), Field("byte_rate", 28, "u32"), Field("block_align", 32, "u16"), Field("bits_per_sample", 34, "u16"))),
    "au": Grammar(((0, b".snd"),), (Field("data_offset", 4, "u32be"), Field("data_size", 8, "u32be"), Field("encoding", 12, "u32be"), Field("sample_rate", 16, "u32be"), Field("channels", 20, "u32be"))),
    "flac": Grammar(((0, b"fLaC"),), (
        Field("least_block", 8, "u16be"), Field("most_block", 10, "u16be"), Field("least_frame", 12, "u24be"), Field("most_frame", 15, "u24be"),
        Field("sample_rate", 18, "i64be", (44, 20, 0)), Field("channels", 18, "i64be", (41, 3, 1)), Field("bits_per_sample", 18, "i64be", (36, 5, 1)), Field("samples", 18, "i64be", (0, 36, 0)), Field("md5", 26, "x16"),
    )),
    "midi": Grammar(((0, b"MThd"),), (Field("format", 8, "u16be"), Field("tracks", 10, "u16be"), Field("division", 12, "i16be"))),
    "vag": Grammar(((0, b"VAGp"),), (Field("version", 4, "u32be"), Field("bytes", 12, "u32be"), Field("sample_rate", 16, "u32be"), Field("name", 32, "s16"))),
    "sid": Grammar(((0, b"PSID"),), (Field("version", 4, "u16be"), Field("load", 8, "u16be"), Field("songs", 14, "u16be"), Field("name", 22, "s32"), Field("author", 54, "s32"), Field("released", 86, "s32"))),
}


def interpret(content: Column, grammar: Grammar) -> Column:
    """struct of the grammar's fields."""
    def read(f: Field) -> Column:
        value = fields.read(content, F.lit(f.at), f.spec)
        if f.bits is None:
            return value.alias(f.name)
        low, count, more = f.bits
        return (fields.bits(value, low, count) + more).alias(f.name)

    fits = F.octet_length(content) >= max(f.at + fields.parse(f.spec)[1] for f in grammar.fields)
    for at, raw in grammar.guards:
        fits = fits & (F.substring(content, at + 1, len(raw)) == F.lit(raw))
    return F.when(fits, F.struct(*map(read, grammar.fields)))
