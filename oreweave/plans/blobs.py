"""Queries over bytes of files that are put together here, odd ones among them, and their DuckDB twins.

A twin knows where things are from the rule by which the files are made; the queries read the bytes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.functions import fields, grammar
from oreweave.operators import addresses, census, contents, regions
from oreweave.operators import bytestrings as bs
from oreweave.plans import bindings as b
from oreweave.plans import formats
from oreweave.plans.formats import _le as le
from oreweave.plans.sequences import BYTES
from oreweave.plans.sequences import files as texts
from oreweave.sources import defects, edit, extract, sniff, tags, walkers
from oreweave.sources.package import ship

QUERIES, ORACLE_SQL = {}, {}


def query_of(queries: dict, twins: dict):
    """A decorator that registers a query with its twin."""

    def query(sql: str | None, *ctes: str):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                twins[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
            return f

        return register

    return query


query = query_of(QUERIES, ORACLE_SQL)


def zeros(n):
    return F.repeat(F.lit("00"), n.cast("int"))


def text(s: str):
    return F.lit(s.encode("latin-1").hex())


def odd_files(spark, sf):
    """path, format, content: a WAVE file for each vector, broken in one of eight ways (0: not at all)."""
    ship(spark)
    kind = F.col("vec_id") % 8
    pcm = F.array_join(F.transform("embedding", lambda x: le(F.floor(x.cast("double") * 32000).cast("long"), 2)), "")
    chunk = lambda name, size, body: F.concat(text(name), le(F.lit(size), 4), body)
    fmt = F.concat(le(F.lit(1), 2), le(F.lit(1), 2), le(F.lit(8000), 4), le(F.lit(16000), 4), le(F.lit(2), 2), le(F.lit(16), 2))
    more = F.when(kind == 2, chunk("note", 5, text("helloA"))).when(kind == 3, F.repeat(chunk("fact", 4, le(F.lit(64), 4)), 2)).when(kind == 4, chunk("JUNK", 1024, F.repeat(text("x"), 1024)))
    more = more.when(kind == 5, chunk("LIST", 18, F.concat(text("INFOINAM"), le(F.lit(6), 4), text("a\1b\2c\0")))).otherwise("")
    body = F.concat(chunk("fmt ", 16, fmt), more, chunk("data", 128, pcm))
    end = F.when(kind == 1, text("extra!")).when(kind == 6, text("PK\5\6" + "\0" * 18)).when(kind == 7, text("APETAGEX" + "\0" * 24)).otherwise("")
    whole = F.concat(text("RIFF"), le(F.length(body) / 2 + 4, 4), text("WAVE"), body, end)
    rows = b.table(spark, sf, "embeddings").select(F.concat(F.lit("/odd/"), F.col("vec_id").cast("string")).alias("path"), F.unhex(whole).alias("content"))
    return rows.withColumn("format", sniff.sniff(F.col("content")))


_ODD = """found AS (SELECT '/odd/' || vec_id AS path, severity, offset_::BIGINT AS "offset", rule FROM embeddings JOIN (VALUES
    (1, 'warn', 0, 'structure'), (1, 'warn', 172, 'structure'), (1, 'notice', 172, 'trailing_data'), (2, 'warn', 36, 'structure'), (2, 'warn', 49, 'nonzero_pad'), (3, 'warn', 48, 'duplicate_chunk'),
    (4, 'notice', 44, 'cavity_content'), (5, 'notice', 48, 'nonprintable_text'), (6, 'warn', 0, 'structure'), (6, 'warn', 188, 'structure'), (6, 'notice', 172, 'trailing_data'), (6, 'alert', 172, 'polyglot'),
    (7, 'warn', 0, 'structure'), (7, 'warn', 172, 'structure'), (7, 'notice', 172, 'trailing_data'), (7, 'notice', 172, 'wrong_format_tag')) AS r(kind, severity, offset_, rule) ON vec_id % 8 = kind)"""


@query('SELECT path, severity, "offset", rule FROM found', _ODD)
def x12_anomalies(spark, sf):
    return defects.defects(odd_files(spark, sf)).select("path", "severity", "offset", "rule")


@query("SELECT '/odd/' || vec_id AS path, count(rule) AS findings, CASE max(CASE severity WHEN 'alert' THEN 3 WHEN 'warn' THEN 2 WHEN 'notice' THEN 1 END) WHEN 3 THEN 'alert' WHEN 2 THEN 'warn' WHEN 1 THEN 'notice' END AS worst, CASE WHEN bool_or(severity = 'alert') THEN 2 WHEN count(rule) > 0 THEN 1 ELSE 0 END AS code FROM embeddings LEFT JOIN found ON path = '/odd/' || vec_id GROUP BY vec_id", _ODD)
def x22_audit_code(spark, sf):
    f = odd_files(spark, sf)
    return defects.verdicts(f, defects.defects(f))


def blobs(spark, sf):
    """file, data: zeros, a WAVE file (of each fourth the size is wrong), a few letters, an AU file."""
    k = F.col("vec_id")
    wav = F.when(k % 4 == 0, F.concat(F.substring(F.hex("content"), 1, 8), text("\xff\xff\xff\x7f"), F.expr("substring(hex(content), 17)"))).otherwise(F.hex("content"))
    big = lambda n: F.lpad(F.hex(F.lit(n)), 8, "0")
    au = F.concat(text(".snd"), big(24), big(32), big(3), big(8000), big(1), F.repeat(text("\1\2"), 16))
    return formats.files(spark, sf).select(F.col("path").alias("file"), F.unhex(F.concat(zeros(16 + k % 40), wav, F.repeat(text("x"), (k % 9).cast("int")), au)).alias("data"))


_BLOBS = "w AS (SELECT '/v/' || vec_id || '.wav' AS file, vec_id, 16 + vec_id % 40 AS a, 16 + vec_id % 40 + CASE WHEN vec_id % 3 = 0 THEN 186 ELSE 172 END AS z FROM embeddings)"


@query("""SELECT file, 'container' AS kind, 'wav' AS format, a AS "offset", CASE WHEN vec_id % 4 = 0 THEN z + vec_id % 9 ELSE z END AS "end", 0.9::DOUBLE AS confidence, vec_id % 4 <> 0 AS declared FROM w
    UNION ALL SELECT file, 'container', 'au', z + vec_id % 9, z + vec_id % 9 + 56, 0.9, true FROM w""", _BLOBS)
def x09_locate(spark, sf):
    return regions.located(blobs(spark, sf))


@query("""SELECT file, a AS "offset", z - 12 AS "end", CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS chunks, 'little' AS "order" FROM w""", _BLOBS)
def x14_resync(spark, sf):
    """Chunks of WAVE files whose header is gone, behind some zeros."""
    k = F.col("vec_id")
    bare = formats.files(spark, sf).select(F.col("path").alias("file"), F.unhex(F.concat(zeros(16 + k % 40), F.expr("substring(hex(content), 25)"))).alias("data"))
    return regions.recovered(bare)


@query("SELECT '/v/' || vec_id || '.wav' AS path, 'wav' AS format, CASE WHEN vec_id % 3 = 0 THEN 4 ELSE 3 END::BIGINT AS chunks, 0::BIGINT AS complaints FROM embeddings")
def s12_forced_walk(spark, sf):
    return walkers.forced_walks(formats.files(spark, sf).withColumn("path", F.col("path")), 1).select("path", "format", "chunks", "complaints")


def streams(spark, sf):
    """file, data: zeros, 8 to 19 MPEG frames of 417 bytes, and of each third a part of one more."""
    k = F.col("c_custkey")
    frame = F.concat(text("\xff\xfb\x90\0"), F.repeat(text("\0"), 413))
    data = F.concat(zeros(k % 50), F.repeat(frame, (8 + k % 12).cast("int")), F.when(k % 3 == 0, F.concat(text("\xff\xfb\x90\0"), F.repeat(text("\0"), 100))).otherwise(""))
    return b.table(spark, sf, "customer").select(k.alias("file"), F.unhex(data).alias("data"))


@query("""SELECT c_custkey AS file, c_custkey % 50 AS "start", c_custkey % 50 + 417 * (8 + c_custkey % 12) + CASE WHEN c_custkey % 3 = 0 THEN 104 ELSE 0 END AS "end", 8 + c_custkey % 12 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS frames FROM customer WHERE 8 + c_custkey % 12 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END >= 12""")
def w20_frame_chains(spark, sf):
    return regions.mpeg_chains(streams(spark, sf))


@query("SELECT c_custkey AS file, 8 + c_custkey % 12 AS frames, c_custkey % 50 AS stray, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS cut FROM customer")
def a26_frame_validity(spark, sf):
    return regions.mpeg_checks(streams(spark, sf))


@query("SELECT c_custkey AS path, CASE c_custkey % 4 WHEN 0 THEN 'mp3' WHEN 2 THEN 'dmx' END AS format FROM customer")
def s07_second_look(spark, sf):
    """Two frames; one frame alone; a size that fits; text."""
    ship(spark)
    k = F.col("c_custkey")
    frame = F.concat(text("\xff\xfb\x90\0"), F.repeat(text("\0"), 413))
    dmx = F.concat(le(F.lit(3), 2), le(F.lit(11025), 2), le(k % 100, 4), zeros(k % 100))
    data = F.when(k % 4 == 0, F.repeat(frame, 2)).when(k % 4 == 1, frame).when(k % 4 == 2, dmx).otherwise(F.hex(F.col("c_name").cast("binary")))
    files = b.table(spark, sf, "customer").select(k.cast("string").alias("path"), F.unhex(data).alias("content"))
    return sniff.sniffed(files).select(F.col("path").cast("long").alias("path"), "format")


_CURVE = """RECURSIVE hil AS (SELECT d, d AS t, 1 AS s, 0 AS x, 0 AS y FROM (SELECT unnest(range(256)) AS d) UNION ALL
    SELECT d, t // 4, s * 2, s * rx + CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - y ELSE y END ELSE x END, s * ry + CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - x ELSE x END ELSE y END
    FROM (SELECT *, (t // 2) & 1 AS rx, xor(t, (t // 2) & 1) & 1 AS ry FROM hil) WHERE s < 16)"""
_CLASSED = "classed AS (SELECT file, pos * 256 // n AS cell, CASE WHEN byte = 0 THEN 0 WHEN byte = 255 THEN 4 WHEN byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) THEN 2 WHEN byte < 32 THEN 1 ELSE 3 END AS c FROM byte)"


@query("SELECT file, x::INT AS x, y::INT AS y, sum(k)::BIGINT AS n, (['null', 'ctrl', 'ascii', 'high', 'ff'])[arg_max(c, k * 10 - c) + 1] AS class FROM (SELECT file, cell, c, count(*) AS k FROM classed GROUP BY ALL) JOIN hil ON cell = d AND s = 16 GROUP BY file, cell, x, y", _CURVE, BYTES, _CLASSED)
def a22_byte_map(spark, sf):
    return bs.class_grid(texts(spark, sf), 4)


@query("SELECT '/v/' || vec_id || '.wav' AS path, 0::INT AS seq, (8000 + vec_id * 10)::INT AS rate, 64::BIGINT AS frames, 172::INT AS bytes FROM embeddings")
def x25_extracted_samples(spark, sf):
    files = formats.files(spark, sf).withColumn("format", sniff.sniff(F.col("content")))
    return extract.extracted(files).select("path", "seq", "rate", "frames", F.octet_length("wav").alias("bytes"))


@query("SELECT '/v/' || vec_id || '.wav' AS path, 8000::BIGINT AS rate, floor(embedding[1]::DOUBLE * 32000)::BIGINT AS first, floor(embedding[64]::DOUBLE * 32000)::BIGINT AS last FROM embeddings")
def x27_converted(spark, sf):
    """AU files of big-endian samples as WAVE files, whose fields are read again."""
    ship(spark)
    big = lambda x, n: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 8 * n) - 1))), 2 * n, "0")
    pcm = F.array_join(F.transform("embedding", lambda x: big(F.floor(x.cast("double") * 32000), 2)), "")
    au = F.concat(text(".snd"), *(big(F.lit(v), 4) for v in (24, 128, 3, 8000, 1)), pcm)
    files = b.table(spark, sf, "embeddings").select(F.concat(F.lit("/v/"), F.col("vec_id").cast("string"), F.lit(".au")).alias("path"), F.lit("au").alias("format"), F.unhex(au).alias("content"))
    read = lambda at, spec: fields.read(F.col("wav"), F.lit(at), spec)
    return extract.converted(files).select("path", read(24, "u32").alias("rate"), read(44, "i16").alias("first"), read(44 + 126, "i16").alias("last"))


def wrong_files(spark, sf):
    """vec_id, path, format, content, right: WAVE files, each third with a wrong size, each fifth with a wrong byte rate."""
    k, h = F.col("vec_id"), F.hex("content")
    cut = lambda a, n: F.substring(h, 2 * a + 1, F.lit(2 * n))
    size, rate = F.when(k % 3 == 1, text(",\0\0\0")).otherwise(cut(4, 4)), F.when(k % 5 == 1, text("\7\0\0\0")).otherwise(cut(28, 4))
    wrong = F.unhex(F.concat(cut(0, 4), size, cut(8, 20), rate, F.expr("substring(hex(content), 65)")))
    return formats.files(spark, sf).select("vec_id", "path", F.lit("wav").alias("format"), wrong.alias("content"), F.col("content").alias("right"))


@query("""SELECT '/v/' || vec_id || '.wav' AS path, 'form size' AS field, 4::BIGINT AS place, 44::BIGINT AS stored, 164::BIGINT AS computed, true AS witnessed FROM embeddings WHERE vec_id % 3 = 1
    UNION ALL SELECT '/v/' || vec_id || '.wav', 'byte rate', 28, 7, 2 * (8000 + vec_id * 10), true FROM embeddings WHERE vec_id % 5 = 1""")
def x17_violations(spark, sf):
    return edit.checked(wrong_files(spark, sf))


@query("SELECT '/v/' || vec_id || '.wav' AS path, CASE WHEN vec_id % 3 = 1 OR vec_id % 5 = 1 THEN 'changed' ELSE 'same' END AS state, true AS as_it_was FROM embeddings")
def x17_repaired(spark, sf):
    """After the repair each file is what it was before it was broken."""
    f = wrong_files(spark, sf)
    fixed = edit.mended(f)
    return fixed.join(f.select("path", "right"), "path").select("path", "state", (F.col("content") == F.col("right")).alias("as_it_was"))


@query("SELECT '/v/' || vec_id || '.wav' AS path, CASE WHEN vec_id % 3 = 0 THEN 178 ELSE 164 END::BIGINT + 32 AS size, 'changed' AS state, 'vector ' || vec_id AS title FROM embeddings WHERE vec_id BETWEEN 100 AND 999")
def k16_edited_titles(spark, sf):
    """A title of ten letters in a list of its own; sizes follow from the bottom up, and a wrong one is made right."""
    f = wrong_files(spark, sf).where("vec_id between 100 and 999")
    new = edit.changed(f, lambda data, kind: edit.with_info(data, {"INAM": "vector " + str((int.from_bytes(data[24:28], "little") - 8000) // 10)}))
    end = F.expr("substring(content, octet_length(content) - 11, 10)").cast("string")
    return new.select("path", fields.read(F.col("content"), F.lit(4), "u32").alias("size"), "state", end.alias("title"))


def media_files(spark, sf):
    """file, data: an MP4 file's boxes for each customer; the media header of each fourth states ten seconds too many."""
    k = F.col("c_custkey")
    big = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    box = lambda name, body: F.concat(big(F.length(body) / 2 + 8), text(name), body)
    zero = F.lit("00000000")
    stated = 100 * (5 + k % 7) + F.when(k % 4 == 0, 1000).otherwise(0)
    mdhd = box("mdhd", F.concat(zero, zero, zero, big(F.lit(100)), big(stated), zero))
    stts = box("stts", F.concat(zero, big(F.lit(2)), big(5 + k % 7 - 1), big(F.lit(100)), big(F.lit(1)), big(F.lit(100))))
    moov = box("moov", box("trak", box("mdia", F.concat(mdhd, box("minf", box("stbl", stts))))))
    return b.table(spark, sf, "customer").select(k.alias("file"), F.unhex(F.concat(box("ftyp", text("M4A \0\0\0\0")), moov)).alias("data"))


@query("SELECT c_custkey AS file, 5 + c_custkey % 7 + CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 0 END::DOUBLE AS stated, (5 + c_custkey % 7)::DOUBLE AS measured, c_custkey % 4 = 0 AS wrong FROM customer")
def x20_media_durations(spark, sf):
    def found(data):
        seconds = edit.media_seconds(data.tobytes())
        return {"stated": [seconds[0]], "measured": [seconds[1]], "wrong": [abs(seconds[0] - seconds[1]) > 0.5]} if seconds else {"stated": [], "measured": [], "wrong": []}

    return bs.per_file(media_files(spark, sf), "stated double, measured double, wrong boolean", found)


@query("SELECT c_custkey::VARCHAR AS path, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS genre, CASE WHEN c_custkey % 3 = 0 THEN (60 + c_custkey % 100)::VARCHAR END AS bpm FROM customer")
def s15_tag_records(spark, sf):
    """ID3 tags of one to three frames."""
    ship(spark)
    k = F.col("c_custkey")
    big = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    frame = lambda name, value: F.concat(text(name), big(F.octet_length(value) + 1), F.lit("000000"), F.hex(value.cast("binary")))
    body = F.concat(frame("TIT2", F.col("c_name")), F.when(k % 2 == 0, frame("TCON", F.col("c_mktsegment"))).otherwise(""), F.when(k % 3 == 0, frame("TBPM", (60 + k % 100).cast("string"))).otherwise(""))
    size = F.length(body) / 2
    safe = F.concat(*(F.lpad(F.hex(F.shiftright(size.cast("int"), 7 * (3 - i)).bitwiseAND(F.lit(127))), 2, "0") for i in range(4)))
    files = b.table(spark, sf, "customer").select(k.cast("string").alias("path"), F.lit("mp3").alias("format"), F.unhex(F.concat(text("ID3\3\0\0"), safe, body)).alias("content"))
    return tags.records(files).select("path", "title", "genre", "bpm")


@query("SELECT c_custkey::VARCHAR AS path, 'Vital' AS device, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS category FROM customer")
def s16_preset_records(spark, sf):
    """Presets as JSON, of each third with something behind the object."""
    ship(spark)
    k = F.col("c_custkey")
    value = F.to_json(F.struct(F.col("c_name").alias("preset_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("preset_style"), F.struct(F.lit(1).alias("x")).alias("settings")))
    files = b.table(spark, sf, "customer").select(k.cast("string").alias("path"), F.lit("vital").alias("format"), F.concat(value, F.when(k % 3 == 0, "}more").otherwise("")).cast("binary").alias("content"))
    return tags.records(files).select("path", "device", "title", "category")


_TOC = "e AS (SELECT c_custkey AS file, 4 + c_custkey % 5 AS n, 20 + c_custkey % 11 AS z, unnest(range(4 + c_custkey % 5)) AS i FROM customer)"


@query("SELECT file, 16::BIGINT AS \"table\", 'snd' || i || '.wav' AS name, 16 + 32 * n + i * z AS \"offset\", z AS size, true AS known FROM e", _TOC)
def x15_contents(spark, sf):
    """Archives of four to eight sounds: a magic, records of a name, an offset and a size, then the sounds."""
    ship(spark)
    k = F.col("c_custkey")
    n, z = (4 + k % 5).cast("int"), (20 + k % 11).cast("int")
    index = F.sequence(F.lit(0), n - 1)
    record = lambda i: F.concat(F.hex(F.concat(F.lit("snd"), i.cast("string"), F.lit(".wav")).cast("binary")), zeros(F.lit(12)), le(16 + 32 * n + i * z, 4), le(z, 4), zeros(F.lit(4)))
    data = F.concat(text("ARCHIVE."), zeros(F.lit(8)), F.array_join(F.transform(index, record), ""), F.repeat(F.concat(text("RIFF"), zeros(z - 4)), n))
    # A table of keys is small for the work its files are, so it is dealt over all cores.
    keys = b.table(spark, sf, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return contents.discovered(keys.select(k.alias("file"), F.unhex(data).alias("data"))).drop("confidence")


@query("""SELECT file, kind, format, min(s) AS "offset", max(e) AS "end", count(*) AS parts FROM (SELECT *, sum(CASE WHEN edge > 0 AND abs(s - edge) <= 6 AND abs(p - edge) <= 6 AND s - p <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY file, kind, format ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
    FROM (SELECT *, round(s / 32.0) * 32 AS edge, lag(e) OVER (PARTITION BY file, kind, format ORDER BY s, e) AS p FROM (SELECT file, 'blob' AS kind, id AS format, offset_ AS s, offset_ + size AS e FROM chunks))) GROUP BY file, kind, format, g""", b.CHUNKS)
def t05_stitched_segments(spark, sf):
    """Regions of files that were read in segments of 32 bytes."""
    rows = b.chunks(spark, sf).select("file", F.lit("blob").alias("kind"), F.col("id").alias("format"), F.col("offset"), (F.col("offset") + F.col("size")).alias("end"))
    return regions.stitched(rows, 32, 6)


@query("""SELECT kind, value, n, n AS files, '/odd/' || f AS first FROM (SELECT kind, value, count(*) AS n, min(vec_id::VARCHAR) AS f FROM embeddings JOIN (VALUES
    ('container', 'RIFF/WAVE', -1), ('chunk', 'fmt ', -1), ('chunk', 'data', -1), ('fmt.format_tag', '1', -1), ('fmt.channels', '1', -1), ('fmt.bits_per_sample', '16', -1), ('chunk', 'note', 2), ('chunk', 'JUNK', 4), ('chunk', 'LIST', 5), ('chunk', 'INFO/INAM', 5), ('LIST.form', 'INFO', 5),
    ('chunk', 'tail', 1), ('chunk', 'tail', 6), ('chunk', 'hex:504b0506', 6), ('chunk', 'hex:00000000', 6), ('chunk', 'APET', 7), ('flag', 'wrong size', 1), ('flag', 'wrong size', 6), ('flag', 'wrong size', 7), ('flag', 'left over', 1), ('flag', 'left over', 6), ('flag', 'pad', 2), ('flag', 'overrun', 7)) AS v(kind, value, k) ON k IN (-1, vec_id % 8) GROUP BY kind, value)""")
def a05_byte_census(spark, sf):
    """The census of the odd files, without the facts that one file has more than once."""
    found = census.facts(walkers.chunks(odd_files(spark, sf)))
    return census.census(found).where("n = files")


@query("SELECT vec_id, 1::BIGINT AS format_tag, 8000 + vec_id * 10 AS sample_rate, 16::BIGINT AS bits_per_sample, 44100::BIGINT AS flac_rate, 2::BIGINT AS flac_channels, 24::BIGINT AS flac_bits, 1000 + vec_id AS flac_samples FROM embeddings")
def s18_grammar(spark, sf):
    """Headers by descriptors, without a walker: of WAVE files, and of FLAC files whose numbers are packed in bits."""
    big = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    packed = F.lit(44100).cast("long") * (1 << 44) + F.lit((1 << 41) + (23 << 36)) + 1000 + F.col("vec_id")
    flac = F.unhex(F.concat(text("fLaC"), big(F.lit(34), 4), zeros(F.lit(10)), big(packed, 8), zeros(F.lit(16))))
    rows = formats.files(spark, sf).select("vec_id", grammar.interpret(F.col("content"), grammar.GRAMMARS["wav"]).alias("w"), grammar.interpret(flac, grammar.GRAMMARS["flac"]).alias("f"))
    return rows.select("vec_id", "w.format_tag", "w.sample_rate", "w.bits_per_sample", F.col("f.sample_rate").alias("flac_rate"), F.col("f.channels").alias("flac_channels"), F.col("f.bits_per_sample").alias("flac_bits"), F.col("f.samples").alias("flac_samples"))


@query("""WITH w AS (SELECT '/v/' || vec_id || '.wav' AS path, CASE WHEN vec_id % 3 = 0 THEN 14 ELSE 0 END AS more, vec_id FROM embeddings)
    SELECT path, '0x10+4' AS spec, 20 AS place, NULL::BIGINT AS length FROM w UNION ALL SELECT path, 'end[-4]', 168 + more, NULL FROM w UNION ALL SELECT path, 'find:WAVE-8', 0, NULL FROM w
    UNION ALL SELECT path, 'chunk:data', 36 + more, 128 FROM w UNION ALL SELECT path, 'fmt.sample_rate', 24, 4 FROM w UNION ALL SELECT path, 'chunk:note+8', 44, 5 FROM w WHERE vec_id % 3 = 0""")
def p18_addresses(spark, sf):
    files = formats.files(spark, sf).withColumn("format", F.lit("wav"))
    return addresses.resolved(files, ["0x10+4", "end[-4]", "find:WAVE-8", "chunk:data", "fmt.sample_rate", "chunk:note+8"])
