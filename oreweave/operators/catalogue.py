"""Operators of the sample catalogue: filters, tag division, facets, totals, upserts, pruning.

Tables: samples (path, library, format, duration, bpm, key, ...), tags (path, tag), features (path, vec, version).
All libraries are one table with a `library` column; a scope is a filter on it, so a partitioned table is pruned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = {"bpm": "bpm", "duration": "duration"}
EQUAL = ("key", "format", "device", "category", "creator", "product")


def parse_range(spec: str, field: str) -> tuple[float | None, float | None]:
    """`120` is exact, `120:130`, `120:` and `:130` are bounds; anything else is a ValueError."""
    low, colon, high = spec.strip().partition(":")
    try:
        bounds = (float(low) if low.strip() else None, (float(high) if high.strip() else None) if colon else float(low))
    except ValueError:
        raise ValueError(f"{field}: {spec!r} is no number or range") from None
    if bounds == (None, None):
        raise ValueError(f"{field}: empty range")
    return bounds


def between(column: Column, low: float | None, high: float | None) -> list[Column]:
    """Inclusive bounds; null never matches."""
    return ([column >= low] if low is not None else []) + ([column <= high] if high is not None else [])


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains(column: Column, text: str) -> Column:
    """Substring without regard to case; wildcards in text are literal."""
    return column.ilike(f"%{escape_like(text)}%")


def starts_with(column: Column, text: str) -> Column:
    return column.ilike(f"{escape_like(text)}%")


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_all_tags(samples: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows whose tags hold all of wanted, without regard to case: relational division."""
    names = sorted({w.lower() for w in wanted})
    having = tags.where(F.lower("tag").isin(names)).groupBy("path").agg(F.countDistinct(F.lower("tag")).alias("n")).where(F.col("n") == len(names))
    return samples.join(having, "path", "left_semi")


def search(samples: DataFrame, tags: DataFrame | None = None, *, scope: str | None = None, text: Column | None = None, wanted: list[str] | None = None, **filters) -> DataFrame:
    """All rows that pass every given filter: <field>_min, <field>_max, or a text equality."""
    parts: list[Column] = []
    if scope is not None:
        parts.append(F.col("library") == scope)
    for name, value in filters.items():
        if value is None:
            continue
        field, _, bound = name.rpartition("_")
        if bound in ("min", "max") and field in RANGES:
            parts += between(F.col(RANGES[field]), *((value, None) if bound == "min" else (None, value)))
        elif name in EQUAL:
            parts.append(same_text(F.col(name), value))
        else:
            raise TypeError(f"unknown filter {name}")
    if text is not None:
        parts.append(text)
    out = samples.where(conjunction(parts))
    return with_all_tags(out, tags, wanted) if wanted else out


def page(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows by order, each with the exact total and whether rows were left out.

    The total is one more aggregation of the same filters, so the page itself stays a top-k of each partition.
    """
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    total = rows.agg(F.count("*").alias("total"))
    # One row.
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def keep_first(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """value, n: null excluded."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def infer_kind(duration: Column, beats: Column) -> Column:
    d, b = F.coalesce(duration, F.lit(0.0)), F.coalesce(beats, F.lit(0))
    return F.when((b > 0) | (d >= 2), "loop").when((d < 1) & (b <= 0), "one_shot").otherwise("any")


def is_kind(kind: str, duration: Column, beats: Column) -> Column:
    if kind == "loop":
        return F.coalesce((beats > 0) | (duration >= 2), F.lit(False))
    if kind == "one_shot":
        return (beats.isNull() | (beats == 0)) & (duration.isNull() | (duration < 1))
    return F.lit(True)


def stats(samples: DataFrame, tags: DataFrame, features: DataFrame, version: int, by_library: bool) -> DataFrame:
    """library (or 'all'), samples, formats, features, distinct tags."""
    name = F.col("library") if by_library else F.lit("all")
    base = samples.select("path", name.alias("library"), "format")
    joined = base.join(features.where(F.col("version") == version).select("path", F.lit(1).alias("has")), "path", "left")
    counts = joined.groupBy("library").agg(F.count("*").alias("samples"), F.countDistinct("format").alias("formats"), F.sum(F.coalesce("has", F.lit(0))).alias("features"))
    tagged = base.join(tags, "path").groupBy("library").agg(F.countDistinct("tag").alias("tags"))
    return counts.join(tagged, "library", "left").withColumn("tags", F.coalesce("tags", F.lit(0)))


def stale(samples: DataFrame, features: DataFrame, version: int) -> DataFrame:
    """Samples whose features are missing or of another version."""
    f = features.select(F.col("path").alias("_p"), "version")
    return samples.join(f, samples["path"] == f["_p"], "left").where(F.col("_p").isNull() | (F.col("version") != version)).drop("_p")


def documents(samples: DataFrame, tags: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Each sample with its sorted tags and description."""
    lists = tags.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return samples.join(lists, "path", "left").join(descriptions, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def ancestors(path: Column) -> Column:
    """Every directory above path, the root last: array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda n: F.when(n == 1, "/").otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the longest root that is the path or above it; an equi-join on exploded ancestors, no theta join."""
    up = paths.select("path", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("root"))
    hit = up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").join(hit, "path", "left")


def overlaps(roots: DataFrame) -> DataFrame:
    """root, inside: roots that lie in another registered root."""
    up = roots.select("root", F.explode(ancestors(F.col("root"))).alias("inside"))
    return up.join(roots.select(F.col("root").alias("inside")), "inside", "left_semi").select("root", "inside")


def discover(samples: DataFrame, least: int, depth: int) -> DataFrame:
    """dir, n: the topmost directories of at most depth levels that hold at least `least` samples."""
    dirs = samples.select(F.explode(ancestors(F.col("path"))).alias("dir")).where(F.col("dir") != "/")
    counts = dirs.groupBy("dir").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.size(F.split("dir", "/")) - 1 <= depth))
    above = counts.select("dir", "n", F.explode_outer(F.filter(ancestors(F.col("dir")), lambda d: d != "/")).alias("up"))
    chosen = counts.select(F.col("dir").alias("up"), F.lit(True).alias("taken"))
    return above.join(chosen, "up", "left").groupBy("dir", "n").agg(F.max(F.coalesce("taken", F.lit(False))).alias("inside")).where("not inside").select("dir", "n")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after changes: rows of their keys replaced, new ones added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def actions(listing: DataFrame, table: DataFrame) -> DataFrame:
    """path, action of an incremental index run: both sides have path, mtime, size."""
    old = table.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    joined = listing.join(old, listing["path"] == old["_p"], "full_outer")
    action = F.when(F.col("_p").isNull(), "added").when(F.col("path").isNull(), "pruned").when(same, "skipped").otherwise("updated")
    return joined.select(F.coalesce("path", "_p").alias("path"), action.alias("action"))


def prune(table: DataFrame, started: float, root: str) -> DataFrame:
    """Rows under root that the walk started then has not seen go."""
    under = F.col("path").startswith(root.rstrip("/") + "/")
    return table.where(~(under & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < started))))
