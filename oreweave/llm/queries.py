"""The opN_<name> queries over whole tables, with production parameters, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from oreweave.llm import base, bpe, fingerprint, lm_score, mixing, quality_gbdt, quality_rules, simhash, suffix_dedup, toxicity, warc


def op1_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(base.documents(spark, sf_dir))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = base.scratch(spark)
    mark = warc.write(warc.resolve(pages), path)
    return warc.read(spark, path, mark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(base.documents(spark, sf_dir))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.groups(base.documents(spark, sf_dir))
    return grouped.select("doc_id", simhash.as_hex(grouped["fp"]).alias("fingerprint"), "component_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(base.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(base.documents(spark, sf_dir), labels)
    return scored.select("doc_id", "held_out", "score", "predicted", scored["evidence.doc_id"].alias("evidence"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.score(base.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(base.documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.report(base.documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(spark, base.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_backoff_automaton, op2_warc_revisits, op3_repeated_windows, op4_simhash_components, op5_bpe_round_trip, op6_toxic_neighbours, op7_quality_trees, op8_source_mixing, op9_weak_supervision, op10_multiset_fingerprints)}

_BASE32 = "list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(payload), 1 + 10 * i, 10))::BIGINT >> (35 - 5 * j)) & 31)::INT + 1, 1) for j in range(8)] for i in range(4)]), 'string_agg', '')"

ORACLE_SQL = {
    "op2_warc_revisits": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
                     max(page_id) OVER (PARTITION BY payload) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op8_source_mixing": """
        WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE * 1.0 / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n),
        e AS (SELECT source, greatest(1, ceil(rate / 500))::INT AS chunks, rate / greatest(1, ceil(rate / 500))::INT AS each FROM r),
        k AS (SELECT source, chunks, each, unnest(range(0, ceil(each + 12 * sqrt(each) + 30)::BIGINT + 1)) AS k FROM e),
        c AS (SELECT source, chunks, sum(exp(k * ln(each) - each - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
        a AS (SELECT source, any_value(chunks) AS chunks, list(cdf ORDER BY cdf) AS cdf FROM c GROUP BY source),
        p AS (SELECT documents.*, a.cdf, coalesce(doc_id::VARCHAR, 'text:' || coalesce(md5(text), '')) AS d, unnest(range(0, a.chunks)) AS chunk FROM documents JOIN a ON documents.source IS NOT DISTINCT FROM a.source),
        m AS (SELECT *, len(list_filter(cdf, lambda x: x <= (('0x' || substr(md5('mix:' || d || CASE WHEN chunk > 0 THEN '#' || chunk::VARCHAR ELSE '' END), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0)) AS copies FROM p),
        o AS (SELECT doc_id, text, lang, source, n_chars, d, (unnest(range(1, copies + 1)) + 2000 * chunk)::INT AS copy FROM m)
        SELECT doc_id, text, lang, source, n_chars, copy, md5('mix order:' || d || ':' || copy::VARCHAR) AS mix_key FROM o""",
}
