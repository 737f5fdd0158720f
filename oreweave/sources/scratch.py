"""Tables that cut lineage, in the folder that the session's spark.checkpoint.dir names and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted as the application ends.

    Only where the session names no folder and everything runs on this machine is a temporary one set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="oreweave-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    own = f"{root.rstrip('/')}/oreweave-tables-{sc.applicationId}"
    if own not in _roots:
        _roots.add(own)
        atexit.register(_drop, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _drop(spark: SparkSession, own: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have stopped already; the folder is then left to its owner
        return


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at = path(spark)
    df.write.parquet(at)
    return spark.read.parquet(at)
