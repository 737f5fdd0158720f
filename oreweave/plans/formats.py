"""Format queries over sound files that are put together from embeddings as PCM, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.functions import codecs
from oreweave.plans import bindings as b
from oreweave.sources import sniff, walkers
from oreweave.sources.package import ship


def _le(value, size: int):
    """Little-endian bytes of a number as hexadecimal digits."""
    digits = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))


def files(spark, sf):
    """path, content: a WAVE file of 64 samples for each vector; every third has a `note` chunk of odd size in front."""
    ship(spark)
    e = b.table(spark, sf, "embeddings")
    pcm = F.array_join(F.transform("embedding", lambda x: _le(F.floor(x.cast("double") * 32000).cast("long"), 2)), "")
    chunk = lambda name, size, body: F.concat(F.lit(name.encode().hex()), _le(F.lit(size), 4), body)
    rate = 8000 + F.col("vec_id") * 10
    fmt = F.concat(_le(F.lit(1), 2), _le(F.lit(1), 2), _le(rate, 4), _le(rate * 2, 4), _le(F.lit(2), 2), _le(F.lit(16), 2))
    note = F.when(F.col("vec_id") % 3 == 0, chunk("note", 5, F.lit("68656c6c6f00"))).otherwise("")
    body = F.concat(chunk("fmt ", 16, fmt), note, chunk("data", 128, pcm))
    whole = F.concat(F.lit(b"RIFF".hex()), _le(F.length(body) / 2 + 4, 4), F.lit(b"WAVE".hex()), body)
    return e.select("vec_id", F.concat(F.lit("/v/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.unhex(whole).alias("content"))


def s06_sniff(spark, sf):
    return files(spark, sf).select("vec_id", sniff.sniff(F.col("content")).alias("format"), F.octet_length("content").alias("length"))


def s09_walk_chunks(spark, sf):
    f = files(spark, sf).withColumn("format", sniff.sniff(F.col("content")))
    return walkers.chunks(f).select("path", "seq", "id", "offset", "size", F.size("warnings").alias("warnings"))


def s18_format_fields(spark, sf):
    f = files(spark, sf).withColumn("format", sniff.sniff(F.col("content")))
    fields = walkers.flat_fields(walkers.chunks(f))
    return fields.where("name IN ('sample_rate', 'bits_per_sample', 'channels')").select("path", "name", F.col("value").cast("int").alias("value"))


def s11_generic_grid(spark, sf):
    f = files(spark, sf).withColumn("format", F.lit(None).cast("string"))
    return walkers.chunks(f).where("id = 'data'").select("path", "offset", "size")


def x16_classify(spark, sf):
    """A ladder of cheap tests before dear ones: magic, then the extension, then the share of printable bytes."""
    f = files(spark, sf).select("path", "content").unionByName(b.table(spark, sf, "benchmark").select(F.concat(F.lit("/b/"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".txt").otherwise("")).alias("path"), F.col("text").cast("binary").alias("content")))
    kind = F.coalesce(sniff.sniff(F.col("content")), F.nullif(sniff.extension(F.col("path")), F.lit("")), F.when(F.octet_length("content") > 0, "opaque"))
    return f.select("path", kind.alias("kind"))


def f42_pcm_decode(spark, sf):
    """The samples of the chunk that the walker finds."""
    f = files(spark, sf).withColumn("format", F.lit("wav"))
    found = walkers.chunks(f).where("id = 'data'").select("path", "offset", "size")
    f = f.join(found, "path").withColumn("pcm", codecs.udf(codecs.pcm)(F.expr("substring(content, cast(offset as int) + 9, cast(size as int))")))
    return f.select("vec_id", F.posexplode("pcm").alias("i", "v")).select("vec_id", "i", F.round(F.col("v") * 32768).cast("int").alias("sample"))


def f45_mu_law(spark, sf):
    ship(spark)
    f = b.table(spark, sf, "benchmark").select("item_id", codecs.udf(codecs.mu_law)(F.col("text").cast("binary")).alias("v"))
    return f.select("item_id", F.aggregate("v", F.lit(0.0), lambda t, x: t + x).alias("s"), F.size("v").alias("n")).select("item_id", "n", F.round(F.col("s") * 32768).cast("long").alias("total"))


_FILES = "files AS (SELECT vec_id, '/v/' || vec_id || '.wav' AS path, vec_id % 3 = 0 AS note FROM embeddings)"

QUERIES = {f.__name__: f for f in (f42_pcm_decode, f45_mu_law, s06_sniff, s09_walk_chunks, s11_generic_grid, s18_format_fields, x16_classify)}
ORACLE_SQL = {
    "f42_pcm_decode": "SELECT vec_id, i::INT AS i, floor(v * 32000)::INT AS sample FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings)",
    "f45_mu_law": """WITH b AS (SELECT item_id, 255 - ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT AS v FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark), (SELECT unnest(range((SELECT max(octet_length(encode(text))) FROM benchmark))) AS i) WHERE 2 * i < length(h)),
        s AS (SELECT item_id, v, ((((v & 15) << 3) + 132) << ((v >> 4) & 7)) - 132 AS size FROM b) SELECT item_id, count(*)::INT AS n, sum(CASE WHEN v & 128 > 0 THEN -size ELSE size END)::BIGINT AS total FROM s GROUP BY item_id""",
    "s06_sniff": f"WITH {_FILES} SELECT vec_id, 'wav' AS format, CASE WHEN note THEN 186 ELSE 172 END AS length FROM files",
    "s09_walk_chunks": f"""WITH {_FILES} SELECT path, 0 AS seq, 'RIFF' AS id, 0 AS offset, CASE WHEN note THEN 178 ELSE 164 END AS size, 0 AS warnings FROM files UNION ALL
        SELECT path, 1, 'fmt ', 12, 16, 0 FROM files UNION ALL SELECT path, 2, 'note', 36, 5, 0 FROM files WHERE note UNION ALL
        SELECT path, CASE WHEN note THEN 3 ELSE 2 END, 'data', CASE WHEN note THEN 50 ELSE 36 END, 128, 0 FROM files""",
    "s11_generic_grid": f"WITH {_FILES} SELECT path, 36 AS offset, 128 AS size FROM files WHERE NOT note",
    "s18_format_fields": f"WITH {_FILES} SELECT path, 'sample_rate' AS name, 8000 + vec_id * 10 AS value FROM files UNION ALL SELECT path, 'bits_per_sample', 16 FROM files UNION ALL SELECT path, 'channels', 1 FROM files",
    "x16_classify": f"WITH {_FILES} SELECT path, 'wav' AS kind FROM files UNION ALL SELECT '/b/' || item_id || CASE WHEN item_id % 2 = 0 THEN '.txt' ELSE '' END, CASE WHEN item_id % 2 = 0 THEN 'txt' ELSE 'opaque' END FROM benchmark",
}
