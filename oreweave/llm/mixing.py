"""Mixing sources to target weights by Poisson replication.

Every document gets a number of copies from a Poisson distribution whose mean is its source's target rate
(target share of the output / rows of the source). The draw inverts the distribution at a number hashed from
the seed and the document, so it is the same on every run and in every partitioning, and no source needs to
be counted exactly as it is emitted. A sum of independent Poisson numbers is one: rates above `MOST` are split into
equal chunks of at most that, each with a draw of its own, so a source of one row among 10^9 has lists of bounded length
too. Copies are shuffled over all partitions by a second hash and sorted by it.

Cumulative probabilities are one row a source, of at most about 900 numbers. They are broadcast only when they hold
`broadcast_bytes` at most; beyond that the join is salted by document, so a source with a third of all rows is met in
many tasks.

Defined cases: a null source is a source of its own; sources that `weights` doesn't name get weight 0; a null
doc_id draws by its text; repeated rows draw the same count, each its own copies; empty and very long texts
are treated as any other; no rows give no rows; other columns are carried along whatever their names, but columns named
copy or mix_key are replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave.llm import base


#: The largest rate of one draw: e^-MOST is far from the smallest double.
MOST = 500


def document() -> Column:
    """What a document's hashes are made of: its id, or its text if it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5("text"), F.lit(""))))


def uniform(seed: str, chunk: Column) -> Column:
    """In [0, 1): 52 bits of the MD5 of seed, document and chunk (if it is not the first)."""
    key = F.concat(F.lit(f"{seed}:"), document(), F.when(chunk > 0, F.concat(F.lit("#"), chunk.cast("string"))).otherwise(""))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, epochs: float) -> DataFrame:
    """source, rate, chunks, cdf: the cumulative Poisson probabilities of 0, 1, 2, ... copies at the rate of a chunk.

    weights None: every source gets the same share of the output. epochs: rows out per row in, as a mean.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is not None:
        spark = docs.sparkSession
        named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        counts = counts.join(named.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        counts = counts.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        counts = counts.withColumn("weight", F.lit(1.0))
    total = counts.agg(F.sum("n").cast("double").alias("all_n"), F.sum("weight").alias("all_w"))
    # total is one row: this adds its two numbers to every source.
    counts = counts.join(F.broadcast(total)).withColumn("rate", F.lit(float(epochs)) * F.col("all_n") * F.col("weight") / (F.col("all_w") * F.col("n")))
    counts = counts.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST)).cast("int"))
    counts = counts.withColumn("each", F.col("rate") / F.col("chunks"))
    most = F.ceil(F.col("each") + 12 * F.sqrt("each") + 30).cast("int")
    # log P(k) = k log(each) - each - log(k!), summed up.
    steps = counts.withColumn("k", F.sequence(F.lit(0), most))
    logs = F.aggregate(
        "k", F.struct(F.lit(0.0).alias("fact"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf")),
        lambda s, k: _step(s, k), lambda s: s["cdf"],
    )
    return steps.select("source", "rate", "chunks", F.when(F.col("rate") > 0, logs).otherwise(F.array().cast("array<double>")).alias("cdf"))


def _step(s: Column, k: Column) -> Column:
    fact = s["fact"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
    total = s["sum"] + F.exp(k.cast("double") * F.log(F.col("each")) - F.col("each") - fact)
    return F.struct(fact.alias("fact"), total.alias("sum"), F.concat(s["cdf"], F.array(total)).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = "mix", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The columns of docs, copy (from 1; of later chunks from 1 + MOST * 4, ...) and mix_key (the order of the global shuffle)."""
    table = base.cut(rates(docs, weights, epochs)).withColumnRenamed("source", "_source")
    plain = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    columns = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rows = base.wrap(docs.select(*(F.col(f"`{c}`") for c in columns)), *plain)
    size = table.agg(F.sum(8 * F.size("cdf") + F.coalesce(F.octet_length("_source"), F.lit(0)) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_source"]))
    else:
        salts = 64
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(document()), F.lit(salts)).cast("int"))
        dealt = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(dealt, salted["source"].eqNullSafe(dealt["_source"]) & (salted["_salt"] == dealt["_s"])).drop("_salt", "_s")
    chunked = joined.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    copies = F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.col("_chunk"))))
    base_number = 4 * MOST * F.col("_chunk")
    out = chunked.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(base_number + 1, base_number + copies))))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed} order"), document(), F.col("_copy").cast("string"))))
    # Repeated rows have the same key: they are dealt by where they come from too.
    out = out.withColumn("_from", F.spark_partition_id()).repartition("mix_key", "_from").sortWithinPartitions("mix_key")
    back = [F.col(c) if c in plain else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return out.select(*back, F.col("_copy").alias("copy"), "mix_key")
