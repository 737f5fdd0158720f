"""What can be done with which format: the registries as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreweave.functions import grammar
from oreweave.sources import defects, extract, sniff, tags, walkers

COLUMNS = ("sniffed", "walked", "extracted", "tagged", "described", "checked")


def capabilities(spark: SparkSession) -> DataFrame:
    """format and a boolean for each of COLUMNS; a few dozen rows, made on the driver."""
    found = {
        "sniffed": {name for name, *_ in sniff.MAGICS}, "walked": set(walkers.WALKERS), "extracted": set(extract.EXTRACTORS), "tagged": set(tags.READERS), "described": set(grammar.GRAMMARS),
        "checked": {k for _, kinds, _ in defects.RULES for k in kinds or ()},
    }
    names = sorted(set().union(*found.values()))
    return spark.createDataFrame([(n, *(n in found[c] for c in COLUMNS)) for n in names], "format string, " + ", ".join(f"{c} boolean" for c in COLUMNS))
