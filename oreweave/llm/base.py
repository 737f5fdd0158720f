"""Shared helpers: reading tables, cutting lineage in the shared folder, chunking Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.sources import package

#: The white space of every operator here: space and the ASCII controls 9 to 13.
WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ascii_lower(text: str) -> str:
    """A-Z to a-z; every other character stays (str.lower would change more)."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def sql_ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows in an Arrow batch, and Spark's own number that it replaces: texts are long, and batches are held several times.
_BATCH, _BATCH_ROWS, _SPARKS_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "500", "10000"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers; keep Arrow batches small unless the session has chosen a size."""
    package.ship(spark)
    if spark.conf.get(_BATCH, _SPARKS_ROWS) == _SPARKS_ROWS:
        spark.conf.set(_BATCH, _BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def wrap(docs: DataFrame, *plain: str) -> DataFrame:
    """The plain columns (those that docs has) and all others in one struct, out of reach of an operator's own names."""
    rest = [c for c in docs.columns if c not in plain]
    return docs.select(*(c for c in docs.columns if c in plain), (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(1).alias("none"))).alias("_row"))


def unwrap(wrapped: DataFrame, columns: list[str], *plain: str) -> DataFrame:
    """The columns that wrap hid, in their order."""
    return wrapped.select(*(F.col(c) if c in plain else F.col(f"_row.`{c}`").alias(c) for c in columns))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder that the session's spark.checkpoint.dir names.

    Only where the session names none and everything runs on this machine (tests) is a temporary folder set.
    Scratch tables are deleted when the application ends.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="oreweave-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    own = f"{root.rstrip('/')}/oreweave-{sc.applicationId}"
    if own not in _roots:
        _roots.add(own)
        atexit.register(_drop, spark, own)
    path = f"{own}/{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


_roots: set[str] = set()
_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the scratch tables that are made meanwhile."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]


def reads(df: DataFrame) -> set[str]:
    """The paths that df reads files from."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(k).toString() for k in range(roots.size())}
    return out


def _drop(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session may have stopped already; the folder is then left to its owner
        return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's own setting that removes an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, so a lost executor costs no rerun of what came before.

    The shuffle files of the write go with it, before the next stage adds its own.
    """
    spark = df.sparkSession
    path, before = scratch(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


@functools.cache
def _trim():
    """The C library's own function that gives back free memory, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give back the memory that is free: workers live on between tasks and share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `text` column holds about `most` bytes, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        start, size = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(sizes) > start:
            yield batch.slice(start)
    tidy()


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def salt_of(*columns: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def per_key_join(rows: DataFrame, keys: list[str], spread: Column, values: dict[str, tuple[str, Column]], salts: int = 64, keep: Column | None = None, how: str = "left") -> DataFrame:
    """Aggregates of each key, joined to every row of the key, without a task that holds a hot key's rows.

    Rows of a key are dealt over `salts` shares by `spread`, and each share is reduced to one row before the
    shares of a key meet, so a key with a third of all rows is met in `salts` tasks. `values` maps a new
    column to ("min" | "max" | "sum", expression). `keep` filters the aggregated keys.
    """
    reduce = {"min": F.min, "max": F.max, "sum": F.sum}
    salted = rows.withColumn("_salt", salt_of(spread, salts=salts))
    shares = salted.groupBy(*keys, "_salt").agg(*(reduce[kind](c).alias(name) for name, (kind, c) in values.items()))
    whole = shares.groupBy(*keys).agg(*(reduce[kind](name).alias(name) for name, (kind, _) in values.items()), F.collect_list("_salt").alias("_salts"))
    if keep is not None:
        whole = whole.where(keep)
    dealt = whole.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *values, F.explode("_salts").alias("_k_salt"))
    on = [salted[k].eqNullSafe(dealt[f"_k_{k}"]) for k in keys] + [salted["_salt"] == dealt["_k_salt"]]
    return salted.join(dealt, on, how).drop("_salt", "_k_salt", *(f"_k_{k}" for k in keys))
