"""From raw documents to token ids: quality rules, near-duplicates, repeated windows, source mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet
before the next one starts. All but the last return the columns of documents. As a stage starts, the scratch tables of
the stage before it are deleted, unless its docs still read them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from oreweave.llm import base, bpe, mixing, quality_rules, shingles, suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stages that have run, by application.
_left: dict[str, list[str]] = {}


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        base.ship(spark)
        left, read = _left.setdefault(spark.sparkContext.applicationId, []), {x.partition(":")[2].lstrip("/") for x in base.reads(docs)}
        still = [p for p in left if p.partition(":")[2].lstrip("/") in read]
        for path in left:
            if path not in still:
                base.drop_path(spark, path)
        with base.scope() as made:
            out = f(spark, docs, sf_dir)
        left[:] = still + made
        return out

    return run


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles) stays: the one of the smallest id."""
    return shingles.deduplicate(docs)


@_stage
def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte windows that a smaller document has too are taken out of the texts."""
    return suffix_dedup.remove(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share; rows repeat as often as their Poisson draw says."""
    plain = ("doc_id", "text", "source")
    return base.unwrap(mixing.mix(base.wrap(docs, *plain)), docs.columns, *plain)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_windows),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", encoding),
]

#: SQL can express neither the shingle groups nor the encoding; tests/llm compares all rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with base.scope() as made:
            docs = base.cut(stage(spark, docs, sf_dir))
        if before is not None:
            base.drop_path(spark, before)
        before = made[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
