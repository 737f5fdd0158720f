"""Writers: tables with the union of keys, carved ranges as files, plug-in formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.functions import text

_FORMATS: dict[str, Callable[[DataFrame, str], None]] = {}


def register_format(name: str, write: Callable[[DataFrame, str], None]) -> None:
    _FORMATS[name] = write


def union(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns in the order in which they are first seen, missing ones null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def render(rows: DataFrame, path: str, kind: str) -> None:
    """Write rows as csv, tsv, json (one object a line, nulls left out), parquet, or a registered format."""
    if kind not in _FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {', '.join(sorted(_FORMATS))}")
    _FORMATS[kind](rows, path)


register_format("csv", lambda rows, path: rows.write.option("header", True).csv(path))
register_format("tsv", lambda rows, path: rows.write.option("header", True).option("sep", "\t").csv(path))
register_format("json", lambda rows, path: rows.write.json(path))
register_format("parquet", lambda rows, path: rows.write.parquet(path))


def carve(files: DataFrame, regions: DataFrame) -> DataFrame:
    """name, data of each region (path, offset, length, kind) of files (path, content); names tell place and kind."""
    joined = regions.join(files.select("path", "content"), "path")
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    name = F.concat(text.safe_label(base), F.lit("_"), F.lpad(F.lower(F.hex("offset")), 8, "0"), F.lit("."), F.coalesce("kind", F.lit("bin")))
    return joined.select(name.alias("name"), F.expr("substring(content, cast(offset as int) + 1, cast(length as int))").alias("data"))


def imported_tags(samples: DataFrame, sidecars: DataFrame) -> DataFrame:
    """path, tag: tags (basename, tags array) of sidecar files, matched to samples by basename."""
    base = samples.select("path", F.element_at(F.split("path", "/"), -1).alias("basename"))
    rows = base.join(sidecars, "basename").select("path", F.explode("tags").alias("tag")).withColumn("tag", F.trim("tag"))
    return rows.where("tag <> ''").distinct()
