"""Compatible samples by key and tempo, and similar samples by standardised vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave.functions import music

#: The step of samples for references without a tempo.
ANY = -(1 << 30)
KEY_RANK = {"same": 0, "relative": 1, "down": 2, "up": 3}


def tempo_windows(bpm: Column, tolerance: float, half_double: bool = True) -> Column:
    """array<struct<ord, label, low, high>>; the first one wins ties."""
    centres = [("same", bpm)] + ([("half", bpm / 2), ("double", bpm * 2)] if half_double else [])
    return F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), (c * (1 - tolerance)).alias("low"), (c * (1 + tolerance)).alias("high")) for i, (label, c) in enumerate(centres)))


def compatible(references: DataFrame, samples: DataFrame, tolerance: float = 0.06, half_double: bool = True) -> DataFrame:
    """ref, path, key_rel, bpm_rel, bpm_dist, score for every reference and each sample that fits it in key and tempo.

    References (path, key, bpm) are exploded to their four keys and to the steps of log2(bpm), as wide as a tempo window,
    that their windows touch: both are equi-join keys, so no key of a large library meets all tempi. A keyless reference
    matches keyless samples only; without a tempo on the reference there is no tempo test.
    """
    refs = references.select(F.col("path").alias("ref"), F.when(F.col("key") != "", music.camelot(F.col("key"))).alias("code"), F.col("bpm").alias("ref_bpm"))
    codes = F.when(F.col("code").isNull(), F.array(F.lit("none"))).otherwise(music.neighbours(F.col("code")))
    refs = refs.select("ref", "ref_bpm", F.posexplode(codes).alias("place", "match")).withColumn("keyless", F.col("match") == "none")
    refs = refs.groupBy("ref", "ref_bpm", "match", "keyless").agg(F.min("place").alias("place"))
    relation = F.when(F.col("keyless"), None).otherwise(F.element_at(F.array(*map(F.lit, KEY_RANK)), (F.col("place") + 1).cast("int")))
    coded = samples.withColumn("match", F.coalesce(music.camelot(F.when(F.col("key") != "", F.col("key"))), F.when(F.coalesce("key", F.lit("")) == "", "none")))
    coded = coded.select("path", "bpm", "match")
    width = max(math.log2((1 + tolerance) / (1 - tolerance)), 0.01) if tolerance < 1 else 64.0
    step = lambda bpm: F.floor(F.log2(F.greatest(bpm, F.lit(1e-6))) / width).cast("int")
    steps = F.array_distinct(F.flatten(F.transform(tempo_windows(F.col("ref_bpm"), tolerance, half_double), lambda w: F.sequence(step(w["low"]), step(w["high"])))))
    # A sample stands at its step and at one for references that ask for no tempo.
    refs = refs.withColumn("step", F.explode(F.when(F.col("ref_bpm").isNull(), F.array(F.lit(ANY))).otherwise(steps)))
    places = F.array_compact(F.array(step(F.col("bpm")), F.lit(ANY)))
    joined = coded.withColumn("step", F.explode(places)).join(refs, ["match", "step"]).drop("step").where(F.col("path") != F.col("ref")).withColumn("key_rel", relation)
    windows = F.filter(tempo_windows(F.col("ref_bpm"), tolerance, half_double), lambda w: (F.col("bpm") >= w["low"]) & (F.col("bpm") <= w["high"]))
    best = F.array_min(F.transform(windows, lambda w: F.struct(F.abs(F.col("bpm") - (w["low"] + w["high"]) / 2).alias("dist"), w["ord"].alias("ord"), w["label"].alias("label"))))
    fit = joined.withColumn("best", F.when(F.col("ref_bpm").isNotNull(), best)).where(F.col("ref_bpm").isNull() | F.col("best").isNotNull())
    key_rank = F.coalesce(*(F.when(F.col("key_rel") == k, r) for k, r in KEY_RANK.items()), F.lit(4))
    bpm_rank = F.when(F.col("best").isNull(), 2).when(F.col("best.label") == "same", 0).otherwise(1)
    return fit.select("ref", "path", "key_rel", F.col("best.label").alias("bpm_rel"), F.coalesce(F.col("best.dist"), F.lit(0.0)).alias("bpm_dist"), (key_rank * 3 + bpm_rank).alias("score"))


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The best `limit` of each reference by score, tempo distance, path."""
    order = Window.partitionBy("ref").orderBy("score", "bpm_dist", "path")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def similar(vectors: DataFrame, target: int | str) -> DataFrame:
    """id, similarity, percentile, above_mean: cosine of vectors standardised over all candidates and the target.

    vectors: id, vec. Means and deviations are one row of two arrays, joined to every row, so vectors are read
    twice and nothing but those two arrays and the target's vector is moved.
    """
    items = vectors.select(F.posexplode("vec").alias("i", "x"))
    moments = items.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    moments = moments.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("moments"))
    aim = vectors.where(F.col("id") == target).select(F.col("vec").alias("aim"))
    z = lambda v: F.zip_with(v, "moments", lambda x, m: (x - m["m"]) / m["s"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    # One row each.
    both = vectors.where(F.col("id") != target).join(F.broadcast(moments)).join(F.broadcast(aim)).select("id", z("vec").alias("u"), z("aim").alias("v"))
    norm = F.sqrt(dot("u", "u") * dot("v", "v"))
    scored = both.select("id", F.round(F.when(norm > 0, dot("u", "v") / norm).otherwise(0.0), 6).alias("similarity"))
    whole = scored.agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"))
    below = Window.orderBy("similarity")
    counts = scored.groupBy("similarity").agg(F.count("*").alias("c")).withColumn("below", F.coalesce(F.sum("c").over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = scored.join(counts, "similarity").join(F.broadcast(whole))
    return out.select("id", "similarity", F.round(100 * F.col("below") / F.col("n"), 1).alias("percentile"), F.round(F.col("similarity") - F.col("mean"), 6).alias("above_mean"))
