"""Catalogue tables bound to the driver's tables, in Spark and in SQL.

samples come from part, tags from its type, brand and first word of the name, features from embeddings,
libraries from nation and region, byte strings from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["C", "Am", "C#", "A#m", "D", "Bm", "D#", "Cm", "E", "C#m", "F", "Dm", "F#", "D#m", "G", "Em", "G#", "Fm", "A", "F#m", "A#", "Gm", "B", "G#m"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/lib"), (F.col("p_size") % 3).cast("string"), F.lit("/"), F.col("p_type"), F.lit("/"), k.cast("string"), F.lit(".wav")).alias("path"),
        F.concat(F.lit("lib"), (F.col("p_size") % 3).cast("string")).alias("library"),
        F.lower("p_brand").alias("format"),
        (F.col("p_size") / 8.0).alias("duration"),
        F.when(k % 17 != 0, (60 + k % 140).cast("double")).alias("bpm"),
        F.when(k % 11 != 0, F.element_at(F.array(*map(F.lit, KEYS)), (k % 24 + 1).cast("int"))).alias("key"),
        (k % 5).alias("acid_beats"), F.col("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_partkey").alias("id"),
        (k * 37 % 1000).cast("double").alias("mtime"), (k * 91 % 5000).alias("size"), F.when(k % 13 != 0, (k % 500).cast("double")).alias("last_seen_at"),
    )


SAMPLES = f"""samples AS (SELECT '/lib' || (p_size % 3) || '/' || p_type || '/' || p_partkey || '.wav' AS path, 'lib' || (p_size % 3) AS library, lower(p_brand) AS format,
    p_size / 8.0::DOUBLE AS duration, CASE WHEN p_partkey % 17 <> 0 THEN (60 + p_partkey % 140)::DOUBLE END AS bpm,
    CASE WHEN p_partkey % 11 <> 0 THEN ({KEYS})[p_partkey % 24 + 1] END AS key, p_partkey % 5 AS acid_beats, p_type AS category, p_name AS title, p_partkey AS id,
    (p_partkey * 37 % 1000)::DOUBLE AS mtime, p_partkey * 91 % 5000 AS size, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 500)::DOUBLE END AS last_seen_at FROM part)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.select("path", F.explode(F.array("category", "format", F.split("title", " ")[0])).alias("tag")).distinct()


TAGS = "tags AS (SELECT DISTINCT path, unnest([category, format, split_part(title, ' ', 1)]) AS tag FROM samples)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    s = samples(spark, sf_dir).select("path", F.col("id").alias("vec_id"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.when(v % 10 != 0, 3).otherwise(2).alias("version"))
    return e.join(s, "vec_id").select("path", "vec", "version")


FEATURES = "features AS (SELECT path, embedding::DOUBLE[] AS vec, CASE WHEN vec_id % 10 <> 0 THEN 3 ELSE 2 END AS version FROM embeddings JOIN samples ON vec_id = samples.id)"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, label: regions as roots, nations as roots inside them."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.concat(F.lit("/"), "r_name").alias("root"), F.col("r_name").alias("label"))
    inner = n.join(r, n["n_regionkey"] == r["r_regionkey"]).where("n_nationkey % 2 = 0").select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("root"), F.col("n_name").alias("label"))
    return top.unionByName(inner)


ROOTS = """roots AS (SELECT '/' || r_name AS root, r_name AS label FROM region UNION ALL
    SELECT '/' || r_name || '/' || n_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of one file per supplier, below its nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "s_name").alias("path"))


FILES = "files AS (SELECT '/' || r_name || '/' || n_name || '/' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, id, offset, size: an order's lines, in order of line, one after another."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity").cast("long")
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("file"), F.row_number().over(w).cast("long").alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("id"),
        (F.sum(q).over(w.rowsBetween(Window.unboundedPreceding, 0)) - q + F.floor(F.col("l_discount") * 100).cast("long")).alias("offset"), q.alias("size"), (F.col("l_tax") * 100).cast("long").alias("flag"),
    )


CHUNKS = """chunks AS (SELECT l_orderkey AS file, row_number() OVER w AS seq, l_returnflag || l_linestatus AS id,
    (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - l_quantity::BIGINT + floor(l_discount * 100)::BIGINT)::BIGINT AS offset_,
    l_quantity::BIGINT AS size, trunc(l_tax * 100)::BIGINT AS flag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""
