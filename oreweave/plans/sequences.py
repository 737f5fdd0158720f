"""Queries over byte strings, windows, islands, chunks and chains, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oreweave.operators import bytestrings as bs
from oreweave.operators import islands as isl
from oreweave.plans import bindings as b

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return register


#: Byte strings: the texts of the benchmark items, whole.
BYTES = """files AS (SELECT item_id AS file, hex(encode(text)) AS h, octet_length(encode(text))::BIGINT AS n FROM benchmark),
    byte AS (SELECT file, n, pos, ('0x' || substr(h, (2 * pos + 1)::INT, 2))::INT AS byte FROM files, (SELECT unnest(range((SELECT max(n) FROM files))) AS pos) WHERE pos < n)"""


def files(spark, sf):
    return b.table(spark, sf, "benchmark").select(F.col("item_id").alias("file"), F.col("text").cast("binary").alias("data"))


@query("SELECT file, byte, count(*) AS n FROM byte GROUP BY ALL", BYTES)
def a09_byte_histogram(spark, sf):
    return bs.histogram(files(spark, sf))


@query("SELECT file, sum(n)::BIGINT AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT file, byte, count(*) AS n FROM byte GROUP BY ALL) GROUP BY file", BYTES)
def a10_entropy(spark, sf):
    return bs.entropies(files(spark, sf)).select("file", "total", F.round("entropy", 6).alias("entropy"))


@query("SELECT file, round(avg(CASE WHEN byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) THEN 1.0 ELSE 0.0 END), 6) AS printable FROM byte GROUP BY file", BYTES)
def a11_printable(spark, sf):
    return bs.printable_shares(files(spark, sf)).select("file", F.round("printable", 6).alias("printable"))


@query("SELECT file, w::INT AS window, (n - 64) // 32 + 1 AS windows, substr(h, (64 * w + 1)::INT, 128) AS digits FROM files, (SELECT unnest(range((SELECT max(n) FROM files))) AS w) WHERE w * 32 + 64 <= n", BYTES)
def w01_windows(spark, sf):
    return bs.windows(files(spark, sf), 64, 32).select("file", "window", "windows", F.hex("data").alias("digits"))


_AUTO = """d AS (SELECT file, w, pos, byte - avg(byte) OVER (PARTITION BY file, w) AS d FROM byte, (SELECT unnest(range((SELECT max(n) FROM files) // 128 + 1)) AS w) WHERE pos >= w * 128 AND pos < w * 128 + 256 AND w * 128 + 256 <= n),
    l AS (SELECT file, w, d, lag(d, 1) OVER o AS l1, lag(d, 2) OVER o AS l2, lag(d, 4) OVER o AS l4, lag(d, 8) OVER o AS l8 FROM d WINDOW o AS (PARTITION BY file, w ORDER BY pos))"""


@query("SELECT file, w::INT AS window, round(sum(d * l1) / sum(d * d), 5) AS r1, round(sum(d * l2) / sum(d * d), 5) AS r2, round(sum(d * l4) / sum(d * d), 5) AS r4, round(sum(d * l8) / sum(d * d), 5) AS r8 FROM l GROUP BY file, w", BYTES, _AUTO)
def w04_autocorrelation(spark, sf):
    r = bs.autocorrelations(files(spark, sf), 256, 128)
    return r.select("file", "window", *(F.round(c, 5).alias(c) for c in ("r1", "r2", "r4", "r8")))


@query("SELECT file, slice::INT AS slice, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS entropy FROM (SELECT file, ((pos + 1) * 8 - 1) // n AS slice, byte, count(*) AS n FROM byte GROUP BY ALL) GROUP BY file, slice",
    BYTES)
def w05_sliced_entropy(spark, sf):
    return bs.slice_entropies(files(spark, sf), 8).select("file", "slice", F.round("entropy", 5).alias("entropy"))


@query("SELECT file, CASE WHEN byte = 0 THEN 'null' WHEN byte = 255 THEN 'ff' WHEN byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) THEN 'ascii' WHEN byte < 32 THEN 'ctrl' ELSE 'high' END AS class, count(*) AS n FROM byte GROUP BY ALL", BYTES)
def f35_byte_classes(spark, sf):
    return bs.byte_classes(files(spark, sf))


@query("SELECT file, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS little, ('0x' || substr(h, 1, 8))::BIGINT AS big, ('0x' || substr(h, 9, 6))::BIGINT AS big24 FROM files", BYTES)
def f30_typed_reads(spark, sf):
    d = F.col("data")
    return files(spark, sf).select("file", bs.unsigned(d, F.lit(0), 4).alias("little"), bs.unsigned(d, F.lit(0), 4, False).alias("big"), bs.unsigned(d, F.lit(4), 3, False).alias("big24"))


@query("SELECT file, pos::INT AS pos FROM files, (SELECT unnest(range((SELECT max(n) FROM files))) AS pos) WHERE pos + 2 <= n AND substr(h, (2 * pos + 1)::INT, 4) = '616E'", BYTES)
def f32_find_bytes(spark, sf):
    return bs.find(files(spark, sf), b"an")


@query("SELECT file, min(pos)::INT AS pos, count(*) AS length FROM (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS run FROM byte WHERE byte BETWEEN 32 AND 126) GROUP BY file, run HAVING count(*) >= 12", BYTES)
def w12_strings(spark, sf):
    return bs.strings(files(spark, sf), 12)


@query("SELECT file, min(pos)::INT AS first, max(pos)::INT AS last, count(*) AS n FROM (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS run FROM (SELECT x.file, x.pos FROM byte x JOIN byte y ON y.file = x.file + 1 AND y.pos = x.pos AND y.byte <> x.byte WHERE x.file % 2 = 0)) GROUP BY file, run",
    BYTES)
def w11_changed_ranges(spark, sf):
    f = files(spark, sf)
    return bs.changed_ranges(f.where("file % 2 = 0"), f.where("file % 2 = 1").select((F.col("file") - 1).alias("file"), "data"))


QUERIES["j21_changed_bytes"] = lambda spark, sf: bs.changed(files(spark, sf).where("file % 2 = 0"), files(spark, sf).where("file % 2 = 1").select((F.col("file") - 1).alias("file"), "data"))
ORACLE_SQL["j21_changed_bytes"] = f"WITH {BYTES} SELECT x.file, x.pos::INT AS pos FROM byte x JOIN byte y ON y.file = x.file + 1 AND y.pos = x.pos AND y.byte <> x.byte WHERE x.file % 2 = 0"


@query("SELECT file, sum(xor(byte, 90))::BIGINT AS xored, sum(((byte >> 3) | (byte << 5)) & 255)::BIGINT AS rotated, sum(((byte >> 4) | (byte << 4)) & 255)::BIGINT AS swapped FROM byte GROUP BY file", BYTES)
def f39_reversible_transforms(spark, sf):
    return bs.transform_sums(files(spark, sf), xored=bs.table_of(key=90), rotated=bs.table_of(rotate=3), swapped=bs.table_of(swap=True))


@query("SELECT file, k::INT AS key, round(avg(abs(d)), 4) AS roughness FROM (SELECT file, k, xor(byte, k::INT) - lag(xor(byte, k::INT)) OVER (PARTITION BY file, k ORDER BY pos) AS d FROM byte, (SELECT unnest([0, 1, 90, 128, 255]) AS k)) GROUP BY file, k", BYTES)
def j19_transform_candidates(spark, sf):
    """Every file under each candidate key."""
    return bs.roughness(files(spark, sf), (0, 1, 90, 128, 255)).select("file", "key", F.round("roughness", 4).alias("roughness"))


_DAY = "ev AS (SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS hour, value FROM events)"


def _hours(spark, sf):
    return b.table(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"), "value")


@query(", hits AS (SELECT user_id, hour, avg(value) AS score FROM ev GROUP BY ALL HAVING avg(value) >= 10.0005), g AS (SELECT *, sum(CASE WHEN hour - p <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY hour) AS island FROM (SELECT *, lag(hour) OVER (PARTITION BY user_id ORDER BY hour) AS p FROM hits)) SELECT user_id, min(hour) AS first, max(hour) AS last, count(*) AS hits, round(avg(score), 6) AS score FROM g GROUP BY user_id, island", _DAY)
def w02_bridged_regions(spark, sf):
    hits = _hours(spark, sf).groupBy("user_id", "hour").agg(F.avg("value").alias("score")).where("score >= 10.0005")
    return isl.bridged(hits, ["user_id"], "hour", 4).groupBy("user_id", "island").agg(F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("hits"), F.round(F.avg("score"), 6).alias("score")).drop("island")


@query(", m AS (SELECT file, offset_ AS s, offset_ + size AS e FROM chunks WHERE size > 0), r AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m), i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT file, min(s) AS start, max(e) AS end_, count(*) AS n FROM i GROUP BY file, island", b.CHUNKS)
def w08_interval_union(spark, sf):
    spans = b.chunks(spark, sf).select("file", F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("end_"))
    return isl.merged(spans, ["file"], "start", "end_")


@query(""", m AS (SELECT file, offset_ AS s, offset_ + size AS e FROM chunks WHERE size > 0), z AS (SELECT file, max(offset_ + size) + 6 AS size FROM chunks GROUP BY file),
    r AS (SELECT file, s AS gap_end, coalesce(max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start FROM m UNION ALL SELECT file, size, size - 6 FROM z) SELECT file, gap_start, gap_end FROM r WHERE gap_end - gap_start >= 4""", b.CHUNKS)
def x13_cavities(spark, sf):
    c = b.chunks(spark, sf)
    spans = c.select("file", F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("end_"))
    sizes = c.groupBy("file").agg((F.max(F.col("offset") + F.col("size")) + 6).alias("size"))
    return isl.gaps(isl.merged(spans, ["file"], "start", "end_"), sizes, ["file"], "start", "end_", "size", 4)


@query(", m AS (SELECT file, offset_ AS s, offset_ + size AS e FROM chunks WHERE size > 0), z AS (SELECT file, max(e) AS size FROM m GROUP BY file), u AS (SELECT file, unnest(range(s, e)) AS x FROM m) SELECT file, round(count(DISTINCT x) / any_value(size), 6) AS covered FROM u JOIN z USING (file) GROUP BY file", b.CHUNKS)
def a19_coverage(spark, sf):
    spans = b.chunks(spark, sf).select("file", F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("end_"))
    return isl.merged(spans, ["file"], "start", "end_").groupBy("file").agg(F.round(F.sum(F.col("end_") - F.col("start")) / F.max("end_"), 6).alias("covered"))


@query(", l AS (SELECT file, seq, id, lag(id) OVER o AS p FROM chunks WINDOW o AS (PARTITION BY file ORDER BY seq)), i AS (SELECT *, sum(CASE WHEN id = p THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY seq) AS island FROM l) SELECT file, id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM i GROUP BY file, island, id HAVING count(*) >= 2", b.CHUNKS)
def w09_runs(spark, sf):
    return isl.runs(b.chunks(spark, sf).select("file", "seq", "id"), ["file"], "seq", "id", 2)


@query(", l AS (SELECT file, seq, id, offset_, offset_ + size AS e, lag(id) OVER o AS p, max(offset_ + size) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chunks WINDOW o AS (PARTITION BY file ORDER BY seq)), i AS (SELECT *, sum(CASE WHEN id = 'NO' AND p = 'NO' AND offset_ - reach <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY seq) AS island FROM l) SELECT file, id, min(offset_) AS offset_, max(e) AS end_, count(*) AS n FROM i GROUP BY file, island, id", b.CHUNKS)
def w06_coalesced_regions(spark, sf):
    c = b.chunks(spark, sf).select("file", "seq", "id", F.col("offset").alias("offset_"), (F.col("offset") + F.col("size")).alias("end_"))
    w = Window.partitionBy("file").orderBy("seq")
    reach = F.max("end_").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ~((F.col("id") == "NO") & (F.lag("id").over(w) == "NO") & (F.col("offset_") - reach <= 3))
    out = isl.islands(c.withColumn("_n", F.coalesce(new, F.lit(True))), ["file"], ["seq"], F.col("_n"))
    return out.groupBy("file", "island", "id").agg(F.min("offset_").alias("offset_"), F.max("end_").alias("end_"), F.count("*").alias("n")).drop("island")


@query(", r AS (SELECT file, seq, id, offset_ AS s, offset_ + size AS e FROM chunks) SELECT a.file, a.seq FROM r a WHERE a.id = 'NO' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.file = a.file AND o.id = 'RF' AND least(a.e, o.e) - greatest(a.s, o.s) > 0 AND least(a.e, o.e) - greatest(a.s, o.s) >= 0.1 * (a.e - a.s))", b.CHUNKS)
def j12_overlap_anti(spark, sf):
    c = b.chunks(spark, sf).select("file", "seq", "id", F.col("offset").alias("s"), (F.col("offset") + F.col("size")).alias("e"))
    return isl.interval_anti(c.where("id = 'NO'"), c.where("id = 'RF'"), ["file"], "s", "e", 0.1).select("file", "seq")


@query(", r AS (SELECT file, seq, id, offset_ AS s, offset_ + size AS e FROM chunks) SELECT a.file, a.seq FROM r a WHERE a.id = 'AF' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.file = a.file AND o.id = 'RF' AND a.s >= o.s AND a.s < o.e)", b.CHUNKS)
def j13_point_anti(spark, sf):
    c = b.chunks(spark, sf).select("file", "seq", "id", F.col("offset").alias("s"), (F.col("offset") + F.col("size")).alias("e"))
    points = c.where("id = 'AF'").select("file", "seq", "s", (F.col("s") + 1).alias("e"))
    return isl.interval_anti(points, c.where("id = 'RF'"), ["file"], "s", "e", 1.0).select("file", "seq")


@query(", r AS (SELECT file, seq, offset_ AS s, offset_ + size AS e FROM chunks) SELECT a.file, a.seq, (SELECT min(o.seq) FROM r o WHERE o.file = a.file AND o.seq <> a.seq AND a.s >= o.s AND a.s < o.e) AS holder FROM r a", b.CHUNKS)
def j14_holder(spark, sf):
    c = b.chunks(spark, sf).select("file", "seq", F.col("offset").alias("s"), (F.col("offset") + F.col("size")).alias("e"))
    o = c.select(F.col("file").alias("_f"), F.col("seq").alias("_q"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    joined = c.join(o, (c["file"] == o["_f"]) & (c["seq"] != o["_q"]) & (c["s"] >= o["_s"]) & (c["s"] < o["_e"]), "left")
    return joined.groupBy("file", "seq").agg(F.min("_q").alias("holder"))


_CHAINS = ", k AS (SELECT file, offset_ AS s, min(offset_ + size) AS e FROM chunks WHERE size > 0 GROUP BY ALL)"


def j15_chains(spark, sf):
    c = b.chunks(spark, sf).select("file", F.col("offset").alias("s"), (F.col("offset") + F.col("size")).alias("e"))
    return isl.chain_lengths(c, ["file"], "s", "e")


QUERIES["j15_chains"] = j15_chains
ORACLE_SQL["j15_chains"] = f"WITH RECURSIVE {b.CHUNKS}{_CHAINS}, c(file, s, pos, length) AS (SELECT file, s, e, 1 FROM k UNION ALL SELECT c.file, c.s, k.e, c.length + 1 FROM c JOIN k ON k.file = c.file AND k.s = c.pos) SELECT file, s, max(length)::BIGINT AS length FROM c GROUP BY file, s"


@query(" SELECT file, round(avg(CASE WHEN e = nx THEN 1.0 ELSE 0.0 END), 6) AS score FROM (SELECT file, offset_ + size AS e, lead(offset_) OVER (PARTITION BY file ORDER BY seq) AS nx FROM chunks) WHERE nx IS NOT NULL GROUP BY file", b.CHUNKS)
def w15_pairing(spark, sf):
    w = Window.partitionBy("file").orderBy("seq")
    rows = b.chunks(spark, sf).select("file", (F.col("offset") + F.col("size")).alias("e"), F.lead("offset").over(w).alias("nx")).where("nx IS NOT NULL")
    return rows.groupBy("file").agg(F.round(F.avg(F.when(F.col("e") == F.col("nx"), 1.0).otherwise(0.0)), 6).alias("score"))


@query(" SELECT file, count(*) FILTER (offset_ < p) * 20 <= count(*) AND count(*) FILTER (offset_ > p) * 2 >= count(*) AND max(offset_) - min(offset_) > count(*) AS offset_like FROM (SELECT file, offset_, lag(offset_) OVER (PARTITION BY file ORDER BY seq) AS p FROM chunks) GROUP BY file", b.CHUNKS)
def w16_offset_columns(spark, sf):
    w = Window.partitionBy("file").orderBy("seq")
    rows = b.chunks(spark, sf).select("file", "offset", F.lag("offset").over(w).alias("p"))
    n = F.count("*")
    like = (F.count_if(F.col("offset") < F.col("p")) * 20 <= n) & (F.count_if(F.col("offset") > F.col("p")) * 2 >= n) & (F.max("offset") - F.min("offset") > n)
    return rows.groupBy("file").agg(like.alias("offset_like"))


@query(" SELECT file, seq, offset_ AS start, coalesce(lead(offset_) OVER (PARTITION BY file ORDER BY offset_, seq), max(offset_ + size) OVER (PARTITION BY file)) AS end_ FROM chunks", b.CHUNKS)
def w25_table_regions(spark, sf):
    w = Window.partitionBy("file").orderBy("offset", "seq")
    end = F.max(F.col("offset") + F.col("size")).over(Window.partitionBy("file"))
    return b.chunks(spark, sf).select("file", "seq", F.col("offset").alias("start"), F.coalesce(F.lead("offset").over(w), end).alias("end_"))


@query(" SELECT id, count(DISTINCT file) AS files, min(file) AS example FROM chunks GROUP BY id", b.CHUNKS)
def a07_survey(spark, sf):
    return b.chunks(spark, sf).select("file", "id").distinct().groupBy("id").agg(F.count("*").alias("files"), F.min("file").alias("example"))


@query(" SELECT shape, count(*) AS n FROM (SELECT file, string_agg(DISTINCT id, ',' ORDER BY id) AS shape FROM chunks GROUP BY file) GROUP BY shape", b.CHUNKS)
def a08_shapes(spark, sf):
    shapes = b.chunks(spark, sf).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("shape"))
    return shapes.groupBy("shape").agg(F.count("*").alias("n"))


@query(" SELECT id, count(*) AS n, min(file) AS first_seen, count(*) <= 5 AS rare, list_aggregate(list_sort(list(DISTINCT file))[1:25], 'string_agg', ',') AS examples FROM chunks GROUP BY id", b.CHUNKS)
def a05_census(spark, sf):
    """Counts with the first 25 files of each id: every partial keeps 25, so a hot id stays small."""
    rows = b.chunks(spark, sf).select("file", "id")
    counts = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("first_seen"))
    some = rows.distinct().withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("file"))).where("k <= 25")
    lists = some.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("examples"))
    return counts.join(lists, "id").withColumn("rare", F.col("n") <= 5)


@query(" SELECT file, id, count(*) AS n FROM chunks GROUP BY file, id HAVING count(*) > 1", b.CHUNKS)
def a24_duplicate_chunks(spark, sf):
    return b.chunks(spark, sf).groupBy("file", "id").agg(F.count("*").alias("n")).where("n > 1")


@query(" SELECT file FROM chunks GROUP BY file HAVING bool_or(id IN ('RF', 'AF'))", b.CHUNKS)
def p14_files_with_chunks(spark, sf):
    ids = b.chunks(spark, sf).groupBy("file").agg(F.collect_set("id").alias("ids"))
    return ids.where(F.arrays_overlap("ids", F.array(F.lit("RF"), F.lit("AF")))).select("file")


@query(" SELECT file, seq, id FROM chunks WHERE upper(id) IN ('NO', 'RF') AND NOT id = 'RF'", b.CHUNKS)
def p15_chunk_selection(spark, sf):
    return b.chunks(spark, sf).where(F.upper("id").isin("NO", "RF") & ~F.upper("id").isin("RF")).select("file", "seq", "id")


@query(" SELECT file, string_agg(DISTINCT CASE WHEN flag > 6 THEN 'late' WHEN size > 40 THEN 'large' ELSE 'plain' END, ',' ORDER BY CASE WHEN flag > 6 THEN 'late' WHEN size > 40 THEN 'large' ELSE 'plain' END) AS rules FROM chunks GROUP BY file", b.CHUNKS)
def p17_rule_sets(spark, sf):
    rule = F.when(F.col("flag") > 6, "late").when(F.col("size") > 40, "large").otherwise("plain")
    return b.chunks(spark, sf).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set(rule)), ",").alias("rules"))


@query(" SELECT file, seq, name, value FROM (SELECT file, seq, unnest(['offset', 'size', 'flag']) AS name, unnest([offset_, size, flag]) AS value FROM chunks)", b.CHUNKS)
def p19_flat_fields(spark, sf):
    c = b.chunks(spark, sf)
    fields = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("offset", "size", "flag")))
    return c.select("file", "seq", F.explode(fields).alias("f")).select("file", "seq", "f.name", "f.value")


@query(" SELECT file, bit_or(size) AS bits, CASE bit_or(size) & -bit_or(size) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 3 WHEN 16 THEN 4 WHEN 32 THEN 5 END AS trailing FROM chunks GROUP BY file", b.CHUNKS)
def a12_effective_bits(spark, sf):
    r = b.chunks(spark, sf).groupBy("file").agg(F.bit_or("size").alias("bits"))
    return r.select("file", "bits", F.log2(F.col("bits").bitwiseAND(-F.col("bits"))).cast("int").alias("trailing"))


_SIGNAL = "sig AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings)"


def _signal(spark, sf):
    return b.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))


@query("SELECT vec_id, round(max(abs(v)), 6) AS peak, round(sqrt(avg(v * v)), 6) AS rms, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM sig GROUP BY vec_id", _SIGNAL)
def a17_levels(spark, sf):
    return _signal(spark, sf).groupBy("vec_id").agg(F.round(F.max(F.abs("v")), 6).alias("peak"), F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 6).alias("rms"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("SELECT l.vec_id, round(corr(l.v, r.v), 6) AS corr, round(10 * log10(sum((l.v - r.v) * (l.v - r.v)) / sum((l.v + r.v) * (l.v + r.v))), 5) AS side_db, CASE WHEN bool_and(l.v = r.v) THEN 'dual-mono' WHEN corr(l.v, r.v) >= 0.9995 AND 10 * log10(sum((l.v - r.v) * (l.v - r.v)) / sum((l.v + r.v) * (l.v + r.v))) <= -60 THEN 'near-mono' ELSE 'stereo' END AS verdict FROM sig l JOIN sig r ON r.vec_id = l.vec_id + 1 AND r.i = l.i WHERE l.vec_id % 2 = 0 GROUP BY l.vec_id", _SIGNAL)
def a15_stereo(spark, sf):
    s = _signal(spark, sf)
    left = s.where("vec_id % 2 = 0")
    right = s.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("_k"), F.col("i").alias("_i"), F.col("v").alias("r"))
    both = left.join(right, (left["vec_id"] == right["_k"]) & (left["i"] == right["_i"]))
    side, mid = F.sum((F.col("v") - F.col("r")) * (F.col("v") - F.col("r"))), F.sum((F.col("v") + F.col("r")) * (F.col("v") + F.col("r")))
    out = both.groupBy("vec_id").agg(F.corr("v", "r").alias("c"), (10 * F.log10(side / mid)).alias("db"), F.every(F.col("v") == F.col("r")).alias("same"))
    verdict = F.when(F.col("same"), "dual-mono").when((F.col("c") >= 0.9995) & (F.col("db") <= -60), "near-mono").otherwise("stereo")
    return out.select("vec_id", F.round("c", 6).alias("corr"), F.round("db", 5).alias("side_db"), verdict.alias("verdict"))


@query("SELECT vec_id, (i // 8)::INT AS cell, round(max(abs(v)), 6) AS peak FROM sig GROUP BY ALL", _SIGNAL)
def w22_peaks(spark, sf):
    return _signal(spark, sf).groupBy("vec_id", F.floor(F.col("i") / 8).cast("int").alias("cell")).agg(F.round(F.max(F.abs("v")), 6).alias("peak"))


@query("SELECT vec_id, i::INT AS i, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) AS scaled FROM sig WINDOW w AS (PARTITION BY vec_id)", _SIGNAL)
def w23_scaled(spark, sf):
    w = Window.partitionBy("vec_id")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return _signal(spark, sf).select("vec_id", "i", F.round(F.when(high > low, (F.col("v") - low) / (high - low)).otherwise(0.0), 6).alias("scaled"))


@query("SELECT vec_id, i::INT AS i, round(median(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 6) AS med FROM sig", _SIGNAL)
def w24_sliding_median(spark, sf):
    w = Window.partitionBy("vec_id").orderBy("i").rowsBetween(-8, 8)
    return _signal(spark, sf).select("vec_id", "i", F.round(_median(F.sort_array(F.collect_list("v").over(w))), 6).alias("med"))


def _median(a):
    n = F.size(a)
    return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor((n + 2) / 2).cast("int"))) / 2


@query("SELECT vec_id, i::INT AS i, (sum((v * 1000)::BIGINT) OVER (PARTITION BY vec_id ORDER BY i) % 256 + 256)::BIGINT % 256 AS decoded FROM sig", _SIGNAL)
def w19_delta_decode(spark, sf):
    w = Window.partitionBy("vec_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = F.round(F.col("v") * 1000, 0).cast("long")
    return _signal(spark, sf).select("vec_id", "i", F.pmod(F.sum(d).over(w), F.lit(256)).alias("decoded"))


@query("SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS n FROM (SELECT user_id, s, sum(CASE WHEN s - p < 43200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS g FROM (SELECT user_id, event_id, epoch(ts)::BIGINT AS s, lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events))) GROUP BY user_id, g HAVING count(*) >= 2")
def w18_silence_splits(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    out = isl.islands(e, ["user_id"], ["s", "event_id"], F.col("s") - F.lag("s").over(w) >= 43200)
    return out.groupBy("user_id", "island").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count("*").alias("n")).where("n >= 2").drop("island")


@query("SELECT user_id, event_id, round(60 / (nx - s), 4) AS tempo FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx - s > 1")
def w17_derived_tempos(spark, sf):
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = b.table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    e = e.withColumn("nx", F.lead("s").over(w)).where("nx - s > 1")
    return e.select("user_id", "event_id", F.round(60 / (F.col("nx") - F.col("s")), 4).alias("tempo"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t08_tumbling(spark, sf):
    e = b.table(spark, sf, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT doc_id, t.term AS term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) t WHERE term IN ('that', 'with') AND doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) WHERE term IN ('that', 'with', 'the') GROUP BY doc_id HAVING count(*) = 3)")
def p06_full_text_and(spark, sf):
    """Documents that hold all three words. Without an index: a cheap search for each in the scan, then whole words; no shuffle."""
    low = F.lower("text")
    d = b.table(spark, sf, "documents")
    for word in ("that", "with", "the"):
        d = d.where(F.contains(low, F.lit(word)) & low.rlike(f"(^|[^a-z0-9]){word}([^a-z0-9]|$)"))
    return d.select("doc_id", F.explode(F.array(F.lit("that"), F.lit("with"))).alias("term"))
