"""A census of walked files: what containers, chunks and fields there are, how often, and where each is first seen.

Every chunk gives facts (kind, value); they are counted with partial sums, so one kind that most files have is no hot key,
and results of parts of a collection can be merged. Examples are bounded: the first `shown` paths of each fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields whose values are counted, by chunk.
COUNTED = {"fmt ": ("format_tag", "channels", "bits_per_sample"), "bext": ("version",), "LIST": ("form",), "COMM": ("channels", "bits_per_sample")}
FLAGS = {"overrun": "claims|past the end|past its parent", "wrong size": "declares", "pad": "pad byte", "left over": "left over", "stopped": "walker stopped|more than"}


def facts(chunks: DataFrame) -> DataFrame:
    """path, kind, value: a row for each thing to be counted."""
    def fact(kind: Column | str, value: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))

    value = lambda name: F.get(F.filter("fields", lambda f: f["name"] == name)["value"], 0)
    top = F.col("seq") == 0
    out = [F.when(top & value("form").isNotNull(), fact("container", F.concat("id", F.lit("/"), value("form")))), F.when(top & value("form").isNull(), fact("container", F.col("id"))), F.when(~top, fact("chunk", F.col("id")))]
    out += [F.when(F.col("id") == c, fact(f"{c.strip()}.{n}", value(n))) for c, names in COUNTED.items() for n in names]
    out += [F.when(F.col("id") == "fact", fact("fact size", F.col("size").cast("string")))]
    said = F.array_join("warnings", "\n")
    out += [F.when(said.rlike(pattern), fact("flag", F.lit(name))) for name, pattern in FLAGS.items()]
    rows = chunks.select("path", F.explode(F.array_compact(F.array(*out))).alias("f")).select("path", "f.kind", "f.value")
    return rows.where("value is not null")


def census(found: DataFrame) -> DataFrame:
    """kind, value, n, files, first (the smallest path) of facts."""
    each = found.groupBy("kind", "value", "path").agg(F.count("*").alias("n"))
    return each.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.min("path").alias("first"))


def merged(*parts: DataFrame) -> DataFrame:
    """Censuses of collections that have no file in common as one."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("files").alias("files"), F.min("first").alias("first"))


def examples(found: DataFrame, shown: int = 25) -> DataFrame:
    """kind, value, path, place: the first paths of each fact; what is beyond them is cut off before it is moved."""
    w = Window.partitionBy("kind", "value").orderBy("path")
    return found.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= shown)
