"""Gaps, islands, intervals and chains over ordered rows: one window order each, so one exchange and sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave.sources.scratch import cut


def islands(rows: DataFrame, part: list[str], order: list[str], is_new: Column, name: str = "island") -> DataFrame:
    """rows with the number of the island each belongs to; is_new may use lag over the same window."""
    w = Window.partitionBy(*part).orderBy(*order)
    flagged = rows.withColumn("_new", F.when(F.coalesce(is_new, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def bridged(hits: DataFrame, part: list[str], index: str, most_gap: int) -> DataFrame:
    """Islands of hits with at most most_gap misses between two of them."""
    w = Window.partitionBy(*part).orderBy(index)
    return islands(hits, part, [index], F.col(index) - F.lag(index).over(w) > most_gap + 1)


def merged(spans: DataFrame, part: list[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """Unions of overlapping or touching spans (or those within slack): part, start, end, n."""
    w = Window.partitionBy(*part).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(end) > F.col(start)).withColumn("_reach", reach)
    out = islands(marked, part, [start, end], F.col(start) > F.col("_reach") + slack)
    return out.groupBy(*part, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def gaps(unions: DataFrame, sizes: DataFrame, part: list[str], start: str, end: str, size: str, least: int) -> DataFrame:
    """Stretches of [0, size) that no span of merged() covers, of at least `least`."""
    w = Window.partitionBy(*part).orderBy(start)
    joined = sizes.join(unions, part, "left").withColumn("_from", F.coalesce(F.lag(end).over(w), F.lit(0)))
    inner = joined.select(*part, F.col("_from").alias("gap_start"), F.coalesce(F.col(start), F.col(size)).alias("gap_end"))
    tail = unions.groupBy(*part).agg(F.max(end).alias("gap_start")).join(sizes, part).select(*part, "gap_start", F.col(size).alias("gap_end"))
    return inner.unionByName(tail).where(F.col("gap_end") - F.col("gap_start") >= least)


def runs(rows: DataFrame, part: list[str], index: str, value: str, least: int) -> DataFrame:
    """Maximal runs of equal values in consecutive rows: part, value, first, last, n."""
    w = Window.partitionBy(*part).orderBy(index)
    new = (F.col(value) != F.lag(value).over(w)) | (F.col(index) != F.lag(index).over(w) + 1)
    out = islands(rows, part, [index], new).groupBy(*part, "island", value).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("island")


def coalesced(records: DataFrame, part: list[str], order: str, end: str, kind: str, wanted: str, slack: int) -> DataFrame:
    """Neighbouring records of the wanted kind joined when close; a record of another kind keeps them apart."""
    w = Window.partitionBy(*part).orderBy(order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col(kind) != wanted) | (F.lag(kind).over(w) != wanted) | (F.col(order) - reach > slack)
    out = islands(records.withColumn("_is_new", new), part, [order], F.col("_is_new"))
    return out.groupBy(*part, "island", kind).agg(F.min(order).alias(order), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def interval_anti(rows: DataFrame, others: DataFrame, part: list[str], start: str, end: str, share: float) -> DataFrame:
    """Rows of which no single other interval of the same part covers `share` or more.

    What covers a whole row begins no later and ends no earlier, so for that one window with a running maximum does: linear in
    the intervals of a part. For smaller shares a part's intervals are compared in a join.
    """
    if share >= 1:
        both = rows.withColumn("_row", F.lit(1)).unionByName(others.select(*part, start, end).withColumn("_row", F.lit(0)), allowMissingColumns=True)
        before = Window.partitionBy(*part).orderBy(start, "_row").rowsBetween(Window.unboundedPreceding, 0)
        reach = F.max(F.when(F.col("_row") == 0, F.col(end))).over(before)
        open_ = F.col("_reach").isNull() | (F.col("_reach") < F.col(end)) | (F.col(end) <= F.col(start))
        return both.withColumn("_reach", reach).where((F.col("_row") == 1) & open_).drop("_row", "_reach")
    o = others.select(*(F.col(p).alias(f"_{p}") for p in part), F.col(start).alias("_other_start"), F.col(end).alias("_other_end"))
    same = [rows[p] == o[f"_{p}"] for p in part]
    over = F.least(F.col(end), F.col("_other_end")) - F.greatest(F.col(start), F.col("_other_start"))
    condition = (over > 0) & (over >= share * (F.col(end) - F.col(start)))
    for s in same:
        condition = s & condition
    return rows.join(o, condition, "left_anti")


def chain_lengths(records: DataFrame, part: list[str], start: str, end: str, rounds: int = 40, batch: int = 4) -> DataFrame:
    """part, start, length: how many records follow one another from here, each starting where the last ended.

    Pointer doubling: as many joins as the logarithm of the longest chain, `batch` of them between two tables that cut the
    lineage. Of records that start at one place the shortest counts; records of no length end a chain.
    """
    steps = records.where(F.col(end) > F.col(start)).groupBy(*part, start).agg(F.min(end).alias("to"), F.lit(1).cast("long").alias("length"))

    def doubled(steps: DataFrame) -> DataFrame:
        onward = steps.select(*(F.col(p).alias(f"_{p}") for p in part), F.col(start).alias("_from"), F.col("to").alias("_to"), F.col("length").alias("_n"))
        condition = steps["to"] == onward["_from"]
        for p in part:
            condition = (steps[p] == onward[f"_{p}"]) & condition
        joined = steps.join(onward, condition, "left")
        return joined.select(*part, start, F.coalesce("_to", "to").alias("to"), (F.col("length") + F.coalesce("_n", F.lit(0))).alias("length"), F.col("_n").isNotNull().alias("_grew"))

    for _ in range(0, rounds, batch):
        for _ in range(batch):
            steps = doubled(steps.drop("_grew"))
        steps = cut(steps)
        if not steps.where("_grew").take(1):
            return steps.select(*part, start, "length")
    raise RuntimeError(f"chains of over 2^{rounds} records")
