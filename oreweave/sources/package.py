"""Sends this package to the Python workers of a session, so nothing needs to be installed on them."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session: the package as a zip file over Spark's own file distribution."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # Spark's file server reads it from here as long as the application runs.
    folder = tempfile.mkdtemp(prefix="oreweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "oreweave.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
