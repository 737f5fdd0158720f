"""Collects the queries of all plan modules: name -> (spark, sf_dir) -> DataFrame, and the SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES and ORACLE_SQL.
MODULES = ("catalogue", "sequences", "derived", "formats", "streams", "more", "blobs", "fieldwork")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"oreweave.plans.{module}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
