"""Analytics over byte strings: histograms, entropy, windows, typed reads, searches, differences.

Rows are (file, data BINARY). A file's bytes are read where they are, as one numpy array over the Arrow buffer
(no copy, no row a byte), in time linear in its size; what leaves a task is counts, places or windows, in small batches.
Without rows for a file's bytes nothing is shuffled but where two files meet. A null file content gives no rows; files
are told apart by row, so a file named twice gives its rows twice.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreweave.sources import package

#: Rows and bytes of a batch that goes back to the JVM, about.
ROWS, BYTES = 1 << 16, 4 << 20
LAGS = (1, 2, 4, 8)


def per_file(files: DataFrame, columns: str, found: Callable[..., dict[str, np.ndarray | list]], *inputs: str) -> DataFrame:
    """file and columns (DDL): for each file the rows that found gives for its bytes (arrays uint8 of data and inputs)."""
    package.ship(files.sparkSession)
    names = ("data", *inputs)
    made = T.StructType.fromDDL(columns)
    kinds = [_arrow(f.dataType) for f in made.fields]
    full = T.StructType([files.schema["file"], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file = batch.column(batch.schema.get_field_index("file"))
            views = [batch.column(batch.schema.get_field_index(c)) for c in names]
            owners, parts, rows = [], [], 0
            for i in range(len(batch)):
                if not all(v[i].is_valid for v in views):
                    continue
                out = found(*(np.frombuffer(v[i].as_buffer() or b"", dtype=np.uint8) for v in views))
                n = len(out[made.names[0]])
                size = sum(map(len, out["data"])) if "data" in out else 0
                step = max(1, ROWS if size < BYTES else BYTES * n // size)
                for at in range(0, n, step):
                    part = [pa.array(out[c][at : at + step], k) for c, k in zip(made.names, kinds, strict=True)]
                    owners.append(np.full(len(part[0]), i))
                    parts.append(part)
                    rows += len(part[0])
                    if rows >= ROWS or size >= BYTES:
                        yield _joined(file, owners, parts)
                        owners, parts, rows = [], [], 0
            if rows:
                yield _joined(file, owners, parts)

    def _joined(file: pa.Array, owners: list, parts: list) -> pa.RecordBatch:
        columns = [pa.concat_arrays(x) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([file.take(pa.array(np.concatenate(owners))), *columns], ["file", *made.names])

    return files.select("file", *names).mapInArrow(run, full)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind.simpleString()]


def exploded(files: DataFrame) -> DataFrame:
    """file, pos (0 up), byte: for small ranges of files; nothing here needs it."""
    return per_file(files, "pos int, byte int", lambda data: {"pos": np.arange(len(data), dtype=np.int32), "byte": data.astype(np.int32)})


def _counts(data: np.ndarray) -> dict[str, np.ndarray]:
    n = np.bincount(data, minlength=256)
    some = np.flatnonzero(n)
    return {"byte": some.astype(np.int32), "n": n[some]}


def histogram(files: DataFrame) -> DataFrame:
    """file, byte, n of the bytes that a file has."""
    return per_file(files, "byte int, n long", _counts)


def entropy_of(data: np.ndarray) -> float:
    """In bits; 0 for no bytes."""
    n = np.bincount(data, minlength=256)
    n = n[n > 0] / max(1, len(data))
    return max(0.0, float(-(n * np.log2(n)).sum()))


def entropies(files: DataFrame) -> DataFrame:
    """file, total, entropy of files that are not empty."""
    return per_file(files, "total long, entropy double", lambda d: {"total": [len(d)][: len(d)], "entropy": [entropy_of(d)][: len(d)]})


def slice_entropies(files: DataFrame, count: int) -> DataFrame:
    """file, slice, entropy of the equal slices [i n // count, (i + 1) n // count) that are not empty."""

    def found(data: np.ndarray) -> dict:
        ends = np.arange(count + 1) * len(data) // count
        some = [i for i in range(count) if ends[i] < ends[i + 1]]
        return {"slice": np.array(some, dtype=np.int32), "entropy": [entropy_of(data[ends[i] : ends[i + 1]]) for i in some]}

    return per_file(files, "slice int, entropy double", found)


def printable_shares(files: DataFrame) -> DataFrame:
    """file, printable: the share of ASCII text bytes."""
    text = np.isin(np.arange(256), [*range(32, 127), 9, 10, 13])
    return per_file(files, "printable double", lambda d: {"printable": [float(text[d].mean())] if len(d) else []})


def windows(files: DataFrame, size: int, step: int) -> DataFrame:
    """file, window, windows, data: every full window of size bytes; a shorter tail gives none. windows: how many there are."""

    def found(data: np.ndarray) -> dict:
        n = max(0, (len(data) - size) // step + 1)
        raw = data.tobytes()
        return {"window": np.arange(n, dtype=np.int32), "windows": np.full(n, n), "data": [raw[i * step : i * step + size] for i in range(n)]}

    return per_file(files, "window int, windows long, data binary", found)


def correlations_of(windows: np.ndarray, lags: tuple[int, ...] = LAGS) -> np.ndarray:
    """A row for each row of windows: products of deviations at each lag over the sum of squares; 0 for flat ones."""
    dev = windows - windows.mean(axis=1, keepdims=True)
    squares = (dev * dev).sum(axis=1)
    return np.stack([np.divide((dev[:, k:] * dev[:, :-k]).sum(axis=1), squares, out=np.zeros(len(dev)), where=squares > 0) for k in lags], axis=1)


def autocorrelations(files: DataFrame, size: int, step: int, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """file, window, r<lag> of every full window of bytes."""

    def found(data: np.ndarray) -> dict:
        n = max(0, (len(data) - size) // step + 1)
        out = np.empty((n, len(lags)))
        # A few MB of windows at a time, whatever the size of the file.
        for at in range(0, n, 4096):
            rows = np.arange(at, min(n, at + 4096))[:, None] * step + np.arange(size)
            out[at : at + 4096] = correlations_of(data[rows].astype(float), lags)
        return {"window": np.arange(n, dtype=np.int32)} | {f"r{k}": out[:, i] for i, k in enumerate(lags)}

    return per_file(files, "window int, " + ", ".join(f"r{k} double" for k in lags), found)


def carved(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """file, start, end, data of ranges (file, start, end) of the files; what lies past the end is not there.

    A file's ranges are gathered to one row, so its bytes are moved once however many ranges it has.
    """
    wanted = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("ranges"))
    joined = files.join(wanted, "file")
    # The places travel as bytes beside the data.
    places = lambda c: F.unhex(F.array_join(F.transform(F.col(f"ranges.{c}"), lambda x: F.lpad(F.hex(x), 16, "0")), ""))

    def found(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
        a, b = (np.frombuffer(x.tobytes(), dtype=">i8") for x in (start, end))
        raw = data.tobytes()
        return {"start": a.tolist(), "end": np.minimum(b, len(raw)).tolist(), "data": [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]}

    return per_file(joined.select("file", "data", places("start").alias("starts"), places("end").alias("ends")), "start long, end long, data binary", found, "starts", "ends")


def spelt(data: Column, how: str) -> Column:
    """Bytes as text: hex, b64, a C initialiser (c) or a Python literal (py)."""
    digits = F.lower(F.hex(data))
    if how == "hex":
        return digits
    if how == "b64":
        return F.regexp_replace(F.base64(data), "\\s", "")
    if how == "c":
        return F.concat(F.lit("{ "), F.regexp_replace(F.regexp_replace(digits, "(..)", "0x$1, "), ", $", ""), F.lit(" }"))
    if how == "py":
        return F.concat(F.lit('b"'), F.regexp_replace(digits, "(..)", "\\\\x$1"), F.lit('"'))
    raise ValueError(f"no such spelling: {how}")


#: The class of each byte: printable text with tab and line ends, other controls, zero, 255, the rest.
CLASSES = ("null", "ctrl", "ascii", "high", "ff")


@functools.cache
def class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("high"))
    out[:32], out[0], out[255] = CLASSES.index("ctrl"), CLASSES.index("null"), CLASSES.index("ff")
    out[32:127] = out[[9, 10, 13]] = CLASSES.index("ascii")
    return out


def byte_classes(files: DataFrame) -> DataFrame:
    """file, class, n of the classes that a file has."""

    def found(data: np.ndarray) -> dict:
        n = np.bincount(class_table(), weights=np.bincount(data, minlength=256), minlength=len(CLASSES)).astype(np.int64)
        some = np.flatnonzero(n)
        return {"class": [CLASSES[i] for i in some], "n": n[some]}

    return per_file(files, "class string, n long", found)


def class_grid(files: DataFrame, order: int) -> DataFrame:
    """file, x, y, n, class: the commonest class (the first of equals) of the bytes in each cell of a Hilbert curve of 4^order cells."""
    side = 1 << order
    xs, ys = hilbert(np.arange(side * side), order)

    def found(data: np.ndarray) -> dict:
        cells = side * side
        cell = np.arange(len(data)) * cells // max(1, len(data))
        n = np.bincount(cell * len(CLASSES) + class_table()[data], minlength=cells * len(CLASSES)).reshape(cells, -1)
        some = np.flatnonzero(n.sum(axis=1))
        return {"x": xs[some].astype(np.int32), "y": ys[some].astype(np.int32), "n": n[some].sum(axis=1), "class": [CLASSES[i] for i in n[some].argmax(axis=1)]}

    return per_file(files, "x int, y int, n long, class string", found)


def hilbert(d: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of places along the Hilbert curve: quadrant by quadrant, each turned as the curve enters it."""
    x, y, t = np.zeros_like(d), np.zeros_like(d), d.copy()
    for level in range(order):
        s = 1 << level
        right = (t // 2) & 1
        up = (t ^ right) & 1
        turn = up == 0
        flip = turn & (right == 1)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        x, y, t = x + s * right, y + s * up, t // 4
    return x, y


def unsigned(data: Column, at: Column, size: int, little: bool = True) -> Column:
    """The integer of size bytes (up to 7) from place at; null past the end."""
    digits = F.hex(F.substring(data, at + 1, F.lit(size)))
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(size)]
    whole = F.concat(*(reversed(pairs) if little else pairs))
    return F.when(at + size <= F.octet_length(data), F.conv(whole, 16, 10).cast("long"))


def places(data: bytes, pattern: bytes) -> list[int]:
    out, at = [], data.find(pattern)
    while at >= 0:
        out.append(at)
        at = data.find(pattern, at + 1)
    return out


def find(files: DataFrame, pattern: bytes) -> DataFrame:
    """file, pos: every place where the pattern starts, overlapping ones too."""
    return per_file(files, "pos int", lambda data: {"pos": np.array(places(data.tobytes(), pattern), dtype=np.int32)})


def counted(files: DataFrame, pattern: bytes, most: int) -> DataFrame:
    """file, pos, total: the first `most` places, and how many there are in all."""

    def found(data: np.ndarray) -> dict:
        at = places(data.tobytes(), pattern)
        return {"pos": np.array(at[:most], dtype=np.int32), "total": np.full(min(most, len(at)), len(at))}

    return per_file(files, "pos int, total long", found)


def gathered(files: DataFrame, at: DataFrame, count: int, size: int = 4) -> DataFrame:
    """file, pos, fields: `count` little-endian numbers of `size` bytes from each place (file, pos) that has so many."""
    ranges = at.select("file", F.col("pos").alias("start"), (F.col("pos") + count * size).alias("end"))
    rows = carved(files, ranges).where(F.col("end") - F.col("start") == count * size)
    return rows.select("file", F.col("start").cast("int").alias("pos"), F.array(*(unsigned(F.col("data"), F.lit(size * i), size) for i in range(count))).alias("fields"))


def versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, data, other: files that are in both."""
    return a.join(b.select(F.col("file"), F.col("data").alias("other")), "file")


def _changed(data: np.ndarray, other: np.ndarray) -> np.ndarray:
    n = min(len(data), len(other))
    return np.flatnonzero(data[:n] != other[:n])


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, pos: places of the common prefix where two versions of a file differ."""
    return per_file(versions(a, b), "pos int", lambda x, y: {"pos": _changed(x, y).astype(np.int32)}, "other")


def changed_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, first, last, n: the runs of differing places."""

    def found(x: np.ndarray, y: np.ndarray) -> dict:
        first, last = runs(_changed(x, y))
        return {"first": first.astype(np.int32), "last": last.astype(np.int32), "n": last - first + 1}

    return per_file(versions(a, b), "first int, last int, n long", found, "other")


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of neighbours among sorted places."""
    heads = np.flatnonzero(np.append(True, np.diff(at) > 1)) if len(at) else at
    return at[heads], at[np.append(heads[1:], len(at)) - 1] if len(at) else at


def _printable(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(np.flatnonzero((data >= 0x20) & (data <= 0x7E)))


def strings(files: DataFrame, least: int) -> DataFrame:
    """file, pos, length: runs of printable bytes (0x20 to 0x7E)."""

    def found(data: np.ndarray) -> dict:
        first, last = _printable(data)
        long = last - first + 1 >= least
        return {"pos": first[long].astype(np.int32), "length": (last - first + 1)[long]}

    return per_file(files, "pos int, length long", found)


def previews(files: DataFrame) -> DataFrame:
    """file, n, max_run, padding: size, longest printable run, and whether all bytes are the same, of files that are not empty."""

    def found(data: np.ndarray) -> dict:
        first, last = _printable(data)
        one = [len(data)] if len(data) else []
        return {"n": one, "max_run": [int((last - first + 1).max(initial=0)) for _ in one], "padding": [bool((data == data[0]).all()) for _ in one]}

    return per_file(files, "n long, max_run long, padding boolean", found)


def table_of(key: int = 0, rotate: int = 0, swap: bool = False) -> bytes:
    """Where each byte goes: xored with key, then rotated right, then with its nibbles swapped."""
    x = np.arange(256) ^ key
    x = ((x >> rotate) | (x << (8 - rotate))) & 255
    return bytes((((x >> 4) | (x << 4)) & 255 if swap else x).astype(np.uint8))


def transformed(files: DataFrame, key: int = 0, rotate: int = 0, swap: bool = False) -> DataFrame:
    """file, data with every byte transformed."""
    table = table_of(key, rotate, swap)
    return per_file(files, "data binary", lambda data: {"data": [data.tobytes().translate(table)]})


def transform_sums(files: DataFrame, **tables: bytes) -> DataFrame:
    """file and for each table the sum of the file's bytes under it; of no bytes, no row."""

    def found(data: np.ndarray) -> dict:
        n = np.bincount(data, minlength=256)
        return {name: [int(n @ np.frombuffer(t, dtype=np.uint8))] if len(data) else [] for name, t in tables.items()}

    return per_file(files, ", ".join(f"{name} long" for name in tables), found)


def roughness_of(data: np.ndarray) -> float:
    """The mean step from byte to byte."""
    return float(np.abs(np.diff(data.astype(np.int16))).mean()) if len(data) > 1 else float("nan")


def roughness(files: DataFrame, keys: tuple[int, ...]) -> DataFrame:
    """file, key, roughness of each file xored with each candidate key; null for fewer than two bytes."""

    def found(data: np.ndarray) -> dict:
        rough = [roughness_of(data ^ np.uint8(k)) if len(data) > 1 else None for k in keys]
        return {"key": list(keys)[: len(keys) if len(data) else 0], "roughness": rough[: len(keys) if len(data) else 0]}

    return per_file(files, "key int, roughness double", found)


def views(files: DataFrame) -> DataFrame:
    """file, view, score: of all bytes, the even and the odd ones the view with the largest mean (the first of equals)."""

    def found(data: np.ndarray) -> dict:
        means = [(round(float(d.mean()), 9), -i, name, float(d.mean())) for i, (name, d) in enumerate((("all", data), ("even", data[::2]), ("odd", data[1::2]))) if len(d)]
        best = max(means)[2:] if means else ()
        return {"view": best[:1], "score": best[1:]}

    return per_file(files, "view string, score double", found)


def score_of(windows: np.ndarray) -> np.ndarray:
    """How far windows (a row of bytes each) look like sampled sound: strength, shape, distribution and liveness multiplied."""
    r1, r2, r4, r8 = correlations_of(windows.astype(float)).T
    printable = ((windows >= 32) & (windows <= 126) | np.isin(windows, (9, 10, 13))).mean(axis=1)
    spread = windows.astype(float).std(axis=1)
    bits = np.array([entropy_of(w) for w in windows])
    return _score(r1, r2, r4, r8, printable, spread, bits)


def _score(r1, r2, r4, r8, printable, spread, bits) -> np.ndarray:
    structure = np.maximum.reduce([np.zeros(len(r1)), np.abs(r4), np.abs(r8), r2 - r1])
    strength = np.clip((np.maximum(r1, r2) - 0.25) / 0.5, 0, 1)
    live = 0.25 + 0.75 * np.clip((spread - 2) / 14, 0, 1)
    out = strength * np.clip(structure / 0.3, 0, 1) * np.clip((0.70 - printable) / 0.35, 0, 1) * live
    return np.where((bits < 2) | (bits > 7.7), 0.0, out)


def audio_scores(files: DataFrame, size: int = 256, step: int = 128) -> DataFrame:
    """file, window, score of every full window."""

    def found(data: np.ndarray) -> dict:
        n = max(0, (len(data) - size) // step + 1)
        out = np.empty(n)
        for at in range(0, n, 4096):
            out[at : at + 4096] = score_of(data[np.arange(at, min(n, at + 4096))[:, None] * step + np.arange(size)])
        return {"window": np.arange(n, dtype=np.int32), "score": out}

    return per_file(files, "window int, score double", found)


def hexdump(files: DataFrame, width: int = 16) -> DataFrame:
    """file, line, text: offset, bytes and printable characters of every `width` bytes."""
    shown = bytes(b if 0x20 <= b <= 0x7E else 0x2E for b in range(256))

    def found(data: np.ndarray) -> dict:
        raw = data.tobytes()
        lines = [(i, raw[i : i + width]) for i in range(0, len(raw), width)]
        return {"line": np.arange(len(lines), dtype=np.int32), "text": [f"{i:08x}  {x.hex(' ')}  {x.translate(shown).decode('ascii')}" for i, x in lines]}

    return per_file(files, "line int, text string", found)
