"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is cut into paragraphs, and these into clauses (after each line end and each of `.!?,;|`; the pieces joined give
the text again), so that a text of one paragraph can be like another in part. Each piece is hashed to a wide vector of
small numbers, and the vectors are summed modulo 2^32: eight lanes tell texts apart, 128 lanes count the set bits
of two more hashes and make likeness measurable. Sums don't depend on order, and pieces can be added or taken away with
`insert` and `delete` alone. Likeness is the cosine of the centred counts, an estimate of the share of common
pieces with a standard deviation near 0.09, cut to 0..1. Counts are exact up to 2^31 pieces, more than a text can have.

The edited text of a document needs the next one in descending order of doc_id. Documents are dealt to ranges
of doc_id (bounds from approximate percentiles, as many as there are `range_bytes` of text), each range is one group of a
window, and the first row of each range, one a range, is handed to the last of the range before it. An id (or null) that
fills several ranges is dealt to them by its texts' hashes. Texts are shuffled once; hashing, summing and the window share
that partitioning.

Defined cases: a null text is empty; the fingerprint of an empty text is that of no pieces, and two empty
texts have likeness 1; rows are ordered by doc_id descending, nulls last, then by the texts' hashes, so repeated
rows follow each other; a table of one row is its own next; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreweave.llm import base

#: Hash seeds: four for equality (two lanes of 32 bits each), two for the 128 counting lanes.
EQUAL, COUNTED = 4, 2
LANE = 0xFFFFFFFF


def pieces(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[.!?,;|\n])"), lambda x: x != "")


def _sums() -> list[Column]:
    """Over exploded pieces in column `piece`; null pieces (of empty texts) count as none."""
    out = [F.count("piece").alias("n")]
    for seed in range(EQUAL):
        h = F.xxhash64(F.lit(seed), "piece")
        out += [F.sum(F.when(F.col("piece").isNotNull(), h.bitwiseAND(F.lit(LANE)))).alias(f"e{2 * seed}"), F.sum(F.when(F.col("piece").isNotNull(), F.shiftrightunsigned(h, 32))).alias(f"e{2 * seed + 1}")]
    for seed in range(COUNTED):
        h = F.xxhash64(F.lit(EQUAL + seed), "piece")
        # Bits i and i + 32 of the hash in the two halves of a long: no carry below 2^31 pieces.
        out += [F.sum(F.when(F.col("piece").isNotNull(), F.shiftrightunsigned(h, i).bitwiseAND(F.lit(0x0000000100000001)))).alias(f"c{32 * seed + i}") for i in range(32)]
    return out


def _lanes() -> Column:
    """struct<n, equal: 8 lanes, counts: 128 lanes> of the sums, all modulo 2^32."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    equal = F.array(*(zero(f"e{i}").bitwiseAND(F.lit(LANE)) for i in range(2 * EQUAL)))
    packed = F.array(*(zero(f"c{i}") for i in range(32 * COUNTED)))
    counts = F.flatten(F.transform(packed, lambda x: F.array(x.bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(x, 32))))
    return F.struct(F.col("n").bitwiseAND(F.lit(LANE)).alias("n"), equal.alias("equal"), counts.alias("counts"))


def as_text(lanes: Column) -> Column:
    """The fingerprint as lower-case hexadecimal digits of one length."""
    wide = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(F.lpad(F.lower(F.hex(lanes["n"])), 8, "0"), wide(lanes["equal"]), wide(lanes["counts"]))


def insert(lanes: Column, other: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _combined(lanes, other, 1)


def delete(lanes: Column, other: Column) -> Column:
    """The fingerprint without the pieces of the other, which it must hold."""
    return _combined(lanes, other, -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    lane = lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(LANE))
    return F.struct(lane(a["n"], b["n"]).alias("n"), F.zip_with(a["equal"], b["equal"], lane).alias("equal"), F.zip_with(a["counts"], b["counts"], lane).alias("counts"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints. Counts are centred by half the number of pieces; neither wraps."""
    centred = lambda x: F.transform(x["counts"], lambda c: (c * 2 - x["n"]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    u, v = centred(a), centred(b)
    norm = F.sqrt(dot(u, u) * dot(v, v))
    cosine = F.when(norm > 0, dot(u, v) / norm).otherwise(F.lit(0.0))
    return F.when((a["equal"] == b["equal"]) & (a["n"] == b["n"]), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """keys and, for each name in texts, the lanes of that text column. keys must tell rows apart."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("of"), pieces(F.coalesce(F.col(c), F.lit(""))).alias("pieces")) for name, c in texts.items()))).alias("t")
    cut = docs.select(*keys, each).select(*keys, "t.of", F.explode_outer("t.pieces").alias("piece"))
    summed = cut.groupBy(*keys, "of").agg(*_sums()).select(*keys, "of", _lanes().alias("lanes"))
    return summed.groupBy(*keys).agg(*(F.max(F.when(F.col("of") == name, F.col("lanes"))).alias(name) for name in texts))


def _ranges(docs: DataFrame, ranges: int) -> Column:
    """The number of each row's range, ascending in the order of the rows; bounds are looked up in two steps.

    docs: doc_id and `part`, in [0, 1), by which rows of an id that fills several ranges are dealt to them.
    """
    share = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges) if ranges > 1 else F.lit(None)
    found = docs.agg(share.alias("bounds"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    bounds = sorted(found["bounds"] or [])
    without = max(1, math.ceil(ranges * found["nulls"] / max(1, found["n"])))
    least = len(bounds) + F.floor(F.col("part") * without).cast("int") + 1
    if not bounds:
        return F.when(F.col("doc_id").isNull(), least).otherwise(F.lit(0))
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def count(test) -> Column:
        """How many bounds pass; those that do come first."""
        block = F.size(F.filter(F.array(*(F.lit(b[0]) for b in blocks)), test))
        inner = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(block, F.lit(1)))
        return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(inner, test)))

    below, upto = count(lambda x: x < F.col("doc_id")), count(lambda x: x <= F.col("doc_id"))
    # An id that is a bound more than once goes to as many ranges, its rows of large parts first.
    at = below + F.least(upto - below, F.floor(F.col("part") * (upto - below)).cast("int") + 1)
    return F.when(F.col("doc_id").isNull(), least).otherwise(len(bounds) - at)


def with_next(rows: DataFrame, order: list[Column], value: str, into: str) -> DataFrame:
    """`value` of the next row over all ranges (column `range`, ascending), and of the first row after the last."""
    spec = Window.partitionBy("range").orderBy(*order)
    rows = rows.withColumns({"_next": F.lead(F.struct(value)).over(spec), "_rank": F.row_number().over(spec)})
    first = rows.where("_rank = 1").select("range", F.struct(value).alias("_first"))
    # One row a range: few enough for one task.
    whole = Window.orderBy("range")
    over = first.select(F.col("range").alias("_range"), F.coalesce(F.lead("_first").over(whole), F.first("_first").over(whole)).alias("_over"))
    return rows.join(over, rows["range"] == over["_range"]).withColumn(into, F.coalesce("_next", "_over")[value]).drop("_next", "_rank", "_range", "_over")


def edited(docs: DataFrame, ranges: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, range, rank, text, n_chars, edited: the second half of each text replaced by the start of the next document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / range_bytes))
    part = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    docs = docs.withColumn("part", part)
    # Ids fall from range to range; of one id, and of none, those of larger and of smaller parts come first.
    hashed = F.when(F.col("doc_id").isNull(), F.col("part")).otherwise(-F.col("part"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hashed"), F.col("text").desc()]
    rows = with_next(docs.withColumns({"range": _ranges(docs, ranges), "hashed": hashed}), order, "text", "next_text")
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "rank": F.row_number().over(Window.partitionBy("range").orderBy(*order))})
    swap = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    return rows.withColumn("edited", swap).drop("next_text", "part", "hashed")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    lanes = base.cut(fingerprints(rows, ["range", "rank", "doc_id", "n_chars", "edited_sha256"], {"own": "text", "other": "edited"}))
    both = with_next(lanes, [F.col("rank")], "own", "next")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
