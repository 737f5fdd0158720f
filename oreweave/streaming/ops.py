"""Structured Streaming forms: windows, sessions, keyed state across batches, and idempotent merges of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oreweave.sources import scratch


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files at path, in as many files a batch."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A file source watches folders.
        return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return stream.parquet(path)


def drained(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run the stream over all that is there, batch by batch, and stop; a failed batch is run again by its number."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch.path(stream.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream puts out, as a table: its last batch in complete mode, else all batches."""
    spark, at = stream.sparkSession, scratch.path(stream.sparkSession)
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")
        last.append(number)

    drained(stream, mode, write)
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{at}/batch={max(last)}") if mode == "complete" else spark.read.option("basePath", at).parquet(at).drop("batch")


def tumbling(events: DataFrame, size: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Rows of a key joined while no gap lies between them: the streaming form of bridged regions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def carried(events: DataFrame, key: str, value: Column) -> DataFrame:
    """key, n, total: a running sum modulo 256 of each key, carried from batch to batch as a decoder's state is."""
    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        for part in parts:
            n += len(part)
            total = int((total + part["x"].sum()) % 256)
        state.update((int(n), total))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "total": [total]})

    rows = events.select(F.col(key).alias("key"), value.cast("long").alias("x"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, n long, total long", "n long, total long", "update", GroupStateTimeout.NoTimeout)


def merged(stream: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest row of each key, kept in a table that every batch is merged into.

    Batch n reads version n - 1 and writes version n, so running a batch again gives the same table.
    """
    spark, at = stream.sparkSession, scratch.path(stream.sparkSession)
    versions = []

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.unionByName(spark.read.parquet(f"{at}/version={number - 1}")) if number - 1 in versions else batch
        names = [c for c in batch.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")
        newest.write.mode("overwrite").parquet(f"{at}/version={number}")
        versions.append(number)

    drained(stream, "append", write)
    return spark.read.parquet(f"{at}/version={max(versions)}") if versions else spark.createDataFrame([], stream.schema)
