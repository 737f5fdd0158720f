"""Places in files by name: numbers, the end, found bytes, chunks and their fields, each with a distance.

`0x1c`, `28`, `end`, `end[-4]`, `find:text`, `find:0x4246`, `chunk:fmt`, `fmt.sample_rate`, and `+4` or `-0x10` behind any of
them. A spec is parsed once on the driver; a file in which it has no place gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from oreweave.sources import walkers

_NUMBER = r"0[xX][0-9a-fA-F]+|\d+"


@dataclass(frozen=True)
class Address:
    kind: str
    value: bytes | int | str
    field: str = ""
    delta: int = 0


def parse(spec: str) -> Address:
    """ValueError if it is no address."""
    text, delta = spec.strip(), 0
    if m := re.fullmatch(rf"end\[\s*([+-]?)\s*({_NUMBER})\s*\]", text):
        return Address("end", 0, delta=-int(m[2], 0) if m[1] == "-" else int(m[2], 0))
    if m := re.fullmatch(rf"(.+?)\s*([+-])\s*({_NUMBER})", text):
        text, delta = m[1], int(m[3], 0) * (-1 if m[2] == "-" else 1)
    if re.fullmatch(_NUMBER, text):
        return Address("number", int(text, 0) if text[:1] != "0" or text[1:2] in "xX" else int(text), delta=delta)
    if text == "end":
        return Address("end", 0, delta=delta)
    name, colon, rest = text.partition(":")
    if colon and name == "find" and rest:
        return Address("find", bytes.fromhex(rest[2:]) if rest[:2].lower() == "0x" else rest.encode("latin-1"), delta=delta)
    if colon and name == "chunk" and rest:
        return Address("chunk", rest.strip(), delta=delta)
    if not colon and (m := re.fullmatch(r"([\x21-\x7e/ ]{1,40}?)\.(\w+)", text)):
        return Address("chunk", m[1].strip(), m[2], delta)
    raise ValueError(f"no address: {spec!r}")


def resolve(data: bytes, kind: str | None, address: Address) -> tuple[int, int | None] | None:
    """(place, length or None); None if the file has no such place, or it lies before its start."""
    base, length = None, None
    if address.kind == "number":
        base = address.value
    elif address.kind == "end":
        base = len(data)
    elif address.kind == "find":
        base = at if (at := data.find(address.value)) >= 0 else None
    else:
        for c in walkers.walk(data, kind):
            if c["id"].strip() != address.value or c["id"] == "error":
                continue
            if not address.field:
                base, length = c["offset"], c["size"]
                break
            field = next((f for f in c["fields"] if f["name"] == address.field), None)
            if field is not None:
                base, length = c["offset"] + 8 + field["off"], field["len"]
                break
    return None if base is None or base + address.delta < 0 else (base + address.delta, length)


def resolved(files: DataFrame, specs: list[str]) -> DataFrame:
    """path, spec, place, length of each spec that has a place in a file (path, format, content)."""
    wanted = [(s, parse(s)) for s in specs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "spec", "place", "length"], (pa.string(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = data.as_py() or b""
                found = ((s, resolve(raw, kind.as_py(), a)) for s, a in wanted)
                rows += [(path.as_py(), s, *place) for s, place in found if place is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "format", "content").mapInArrow(run, "path string, spec string, place long, length long")
