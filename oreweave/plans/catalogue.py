"""Catalogue queries (filters, joins, facets, limits, upserts) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.functions import music, text
from oreweave.operators import catalogue as c
from oreweave.operators import harmonic
from oreweave.plans import bindings as b

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str, *ctes: str):
    """Registers a query and its twin; ctes are the bound tables that the twin names."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return register


SHOWN = ("path", "format", "duration", "bpm", "key")


@query("SELECT path, format, duration, bpm, key FROM samples WHERE bpm >= 100 AND bpm <= 130 AND duration >= 2 AND lower(key) = 'am'", b.SAMPLES)
def p01_conjunctive_filter(spark, sf):
    return c.search(b.samples(spark, sf), bpm_min=100, bpm_max=130, duration_min=2, key="AM").select(*SHOWN)


@query("SELECT path, bpm FROM samples WHERE bpm >= 120 AND bpm <= 125.5", b.SAMPLES)
def p02_range(spark, sf):
    return b.samples(spark, sf).where(c.conjunction(c.between(F.col("bpm"), *c.parse_range("120:125.5", "bpm")))).select("path", "bpm")


@query("SELECT path, bpm FROM samples WHERE bpm = 120 UNION ALL SELECT path, bpm FROM samples WHERE bpm <= 62", b.SAMPLES)
def p03_range_specs(spark, sf):
    s = b.samples(spark, sf).select("path", "bpm")
    parts = [s.where(c.conjunction(c.between(F.col("bpm"), *c.parse_range(spec, "bpm")))) for spec in ("120", ":62")]
    return parts[0].unionByName(parts[1])


@query("SELECT path, category FROM samples WHERE lower(category) = lower('Economy')", b.SAMPLES)
def p04_equal_ignoring_case(spark, sf):
    return c.search(b.samples(spark, sf), category="eConomy").select("path", "category")


@query("SELECT path FROM samples WHERE path IN (SELECT path FROM tags WHERE lower(tag) IN ('economy', 'small') GROUP BY path HAVING count(DISTINCT lower(tag)) = 2)", b.SAMPLES, b.TAGS)
def p05_all_tags(spark, sf):
    return c.with_all_tags(b.samples(spark, sf), b.tags(spark, sf), ["Small", "ECONOMY"]).select("path")


@query("SELECT path FROM samples WHERE path ILIKE '%1\\_%' ESCAPE '\\' OR path ILIKE '%eConomy/1%'", b.SAMPLES)
def p07_substring(spark, sf):
    return b.samples(spark, sf).where(c.contains(F.col("path"), "1_") | c.contains(F.col("path"), "economy/1")).select("path")


@query("SELECT DISTINCT tag FROM tags WHERE tag ILIKE 'brand#1%'", b.SAMPLES, b.TAGS)
def p08_prefix(spark, sf):
    return b.tags(spark, sf).where(c.starts_with(F.col("tag"), "BRAND#1")).select("tag").distinct()


@query("SELECT path, library FROM samples WHERE library = 'lib1'", b.SAMPLES)
def p09_scope(spark, sf):
    return c.search(b.samples(spark, sf), scope="lib1").select("path", "library")


@query("SELECT path, 'loop' AS kind FROM samples WHERE acid_beats > 0 OR duration >= 2 UNION ALL SELECT path, 'one_shot' FROM samples WHERE (acid_beats IS NULL OR acid_beats = 0) AND (duration IS NULL OR duration < 1)", b.SAMPLES)
def p10_kind_filter(spark, sf):
    s = b.samples(spark, sf)
    one = lambda k: s.where(c.is_kind(k, F.col("duration"), F.col("acid_beats"))).select("path", F.lit(k).alias("kind"))
    return one("loop").unionByName(one("one_shot"))


@query("SELECT path, CASE WHEN coalesce(acid_beats, 0) > 0 OR coalesce(duration, 0) >= 2 THEN 'loop' WHEN coalesce(duration, 0) < 1 THEN 'one_shot' ELSE 'any' END AS kind FROM samples", b.SAMPLES)
def p11_infer_kind(spark, sf):
    return b.samples(spark, sf).select("path", c.infer_kind(F.col("duration"), F.col("acid_beats")).alias("kind"))


@query("SELECT path FROM samples WHERE key IS NULL OR key = ''", b.SAMPLES)
def p12_keyless(spark, sf):
    return b.samples(spark, sf).where(F.col("key").isNull() | (F.col("key") == "")).select("path")


@query("""SELECT path, '{"path":"' || path || '"' || CASE WHEN bpm IS NOT NULL THEN ',"bpm":' || bpm::VARCHAR ELSE '' END || CASE WHEN key IS NOT NULL THEN ',"key":"' || key || '"' ELSE '' END || '}' AS shown FROM samples""", b.SAMPLES)
def p13_without_nulls(spark, sf):
    return b.samples(spark, sf).select("path", F.to_json(F.struct("path", "bpm", "key")).alias("shown"))


@query("SELECT count(*) AS total, count(*) > 20 AS truncated FROM samples WHERE bpm >= 100", b.SAMPLES)
def a01_total(spark, sf):
    n = b.samples(spark, sf).where("bpm >= 100").agg(F.count("*").alias("total"))
    return n.select("total", (F.col("total") > 20).alias("truncated"))


@query("SELECT 'tag' AS facet, tag AS value, count(*) AS n FROM tags GROUP BY tag UNION ALL SELECT 'key', key, count(*) FROM samples WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT 'format', format, count(*) FROM samples GROUP BY format", b.SAMPLES, b.TAGS)
def a02_facets(spark, sf):
    s = b.samples(spark, sf)
    one = lambda d, col: c.facet(d, col).select(F.lit(col).alias("facet"), "value", "n")
    return one(b.tags(spark, sf), "tag").unionByName(one(s, "key")).unionByName(one(s, "format"))


_STATS = """, j AS (SELECT {lib} AS library, samples.path, format, f.path IS NOT NULL AS has FROM samples LEFT JOIN (SELECT path FROM features WHERE version = 3) f ON f.path = samples.path)
    SELECT library, count(*) AS samples, count(DISTINCT format) AS formats, count(*) FILTER (has) AS features,
    (SELECT count(DISTINCT tag) FROM tags JOIN j j2 ON j2.path = tags.path WHERE j2.library = j.library) AS tags FROM j GROUP BY library"""


def _stats(lib: str) -> str:
    return f"WITH {b.SAMPLES}, {b.TAGS}, {b.FEATURES}" + _STATS.format(lib=lib)


def a03_stats_by_library(spark, sf):
    return c.stats(b.samples(spark, sf), b.tags(spark, sf), b.features(spark, sf), 3, True)


def a04_stats(spark, sf):
    return c.stats(b.samples(spark, sf), b.tags(spark, sf), b.features(spark, sf), 3, False)


QUERIES |= {"a03_stats_by_library": a03_stats_by_library, "a04_stats": a04_stats}
ORACLE_SQL |= {"a03_stats_by_library": _stats("library"), "a04_stats": _stats("'all'")}


@query("SELECT path, bpm, (SELECT count(*) FROM samples WHERE bpm >= 90 AND path IN (SELECT path FROM tags WHERE lower(tag) = 'economy')) AS total, true AS truncated FROM samples WHERE bpm >= 90 AND path IN (SELECT path FROM tags WHERE lower(tag) = 'economy') ORDER BY path LIMIT 5", b.SAMPLES, b.TAGS)
def x01_search_samples(spark, sf):
    found = c.search(b.samples(spark, sf), b.tags(spark, sf), bpm_min=90, wanted=["economy"]).select("path", "bpm")
    return c.page(found, 5, F.col("path"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY path) AS n FROM samples WHERE duration <= 3) SELECT path, library FROM r WHERE n <= 10 ORDER BY path LIMIT 10", b.SAMPLES)
def x02_query_over_libraries(spark, sf):
    """A top-k of each library and of all: the planner's own top-k of each partition does both."""
    return b.samples(spark, sf).where("duration <= 3").select("path", "library").orderBy("path").limit(10)


ORACLE_SQL["x02_query_over_libraries"] = ORACLE_SQL["x02_query_over_libraries"].replace(" , r AS", ", r AS")


@query("SELECT path, version FROM features JOIN samples USING (path) WHERE version = 3 AND (acid_beats > 0 OR duration >= 2)", b.SAMPLES, b.FEATURES)
def j02_features_of_samples(spark, sf):
    f = b.features(spark, sf).where("version = 3").select("path", "version")
    return f.join(b.samples(spark, sf).where(c.is_kind("loop", F.col("duration"), F.col("acid_beats"))).select("path"), "path")


@query("SELECT samples.path FROM samples LEFT JOIN features ON features.path = samples.path WHERE features.path IS NULL OR version <> 3", b.SAMPLES, b.FEATURES)
def j03_stale_features(spark, sf):
    return c.stale(b.samples(spark, sf), b.features(spark, sf), 3).select("path")


@query("SELECT path, EXISTS (SELECT 1 FROM features f WHERE f.path = samples.path AND version = 3) AS has_features FROM samples", b.SAMPLES, b.FEATURES)
def j05_has_features(spark, sf):
    f = b.features(spark, sf).where("version = 3").select("path", F.lit(True).alias("has_features"))
    return b.samples(spark, sf).select("path").join(f, "path", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))


@query("SELECT samples.path, list_aggregate(list_sort(list(DISTINCT tag)), 'string_agg', ',') AS tags, any_value(title) AS description FROM samples JOIN tags ON tags.path = samples.path GROUP BY samples.path", b.SAMPLES, b.TAGS)
def j06_sample_documents(spark, sf):
    s = b.samples(spark, sf)
    docs = c.documents(s.select("path"), b.tags(spark, sf), s.select("path", F.col("title").alias("description")))
    return docs.select("path", F.array_join("tags", ",").alias("tags"), "description")


_COMPATIBLE = f"""WITH {b.SAMPLES}, k AS (SELECT unnest({b.KEYS}) AS key, unnest(range(24)) AS i),
    codes AS (SELECT key, i // 2 AS pitch, CASE WHEN i % 2 = 1 THEN (i // 2 + 9) % 12 ELSE i // 2 END AS pc, i % 2 = 1 AS minor FROM k),
    cam AS (SELECT key, (CASE WHEN minor THEN (pc + 3) % 12 ELSE pc END * 7 + 7) % 12 + 1 AS num, minor FROM codes),
    s AS (SELECT path, bpm, num, minor, id FROM samples LEFT JOIN cam USING (key)),
    refs AS (SELECT path AS ref, bpm AS rb, num AS rn, minor AS rm FROM s WHERE id IN (1, 2, 3, 11, 17, 40)),
    j AS (SELECT ref, path, bpm, rb, CASE WHEN rn IS NULL THEN NULL WHEN num = rn AND minor = rm THEN 'same' WHEN num = rn THEN 'relative' WHEN minor = rm AND num = (rn + 10) % 12 + 1 THEN 'down' ELSE 'up' END AS key_rel, rn IS NULL AS keyless
        FROM refs JOIN s ON path <> ref AND ((rn IS NULL AND num IS NULL) OR num = rn OR (minor = rm AND (num = (rn + 10) % 12 + 1 OR num = rn % 12 + 1)))),
    w AS (SELECT *, unnest([{{'o': 0, 'l': 'same', 'c': rb}}, {{'o': 1, 'l': 'half', 'c': rb / 2}}, {{'o': 2, 'l': 'double', 'c': rb * 2}}]) AS t FROM j),
    f AS (SELECT *, abs(bpm - (t.c * 0.94 + t.c * 1.06) / 2) AS d FROM w WHERE rb IS NULL OR (bpm >= t.c * 0.94 AND bpm <= t.c * 1.06)),
    best AS (SELECT *, row_number() OVER (PARTITION BY ref, path ORDER BY d, t.o) AS n FROM f),
    scored AS (SELECT ref, path, key_rel, CASE WHEN rb IS NOT NULL THEN t.l END AS bpm_rel, round(coalesce(CASE WHEN rb IS NOT NULL THEN d END, 0), 6) AS bpm_dist,
        CASE key_rel WHEN 'same' THEN 0 WHEN 'relative' THEN 1 WHEN 'down' THEN 2 WHEN 'up' THEN 3 ELSE 4 END * 3 + CASE WHEN rb IS NULL THEN 2 WHEN t.l = 'same' THEN 0 ELSE 1 END AS score FROM best WHERE n = 1)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score, bpm_dist, path) AS place FROM scored) {{where}}"""


def j09_compatible(spark, sf):
    s = b.samples(spark, sf)
    return harmonic.ranked(harmonic.compatible(s.where(F.col("id").isin(1, 2, 3, 11, 17, 40)), s).withColumn("bpm_dist", F.round("bpm_dist", 6)), 1 << 30)


def x03_find_compatible(spark, sf):
    s = b.samples(spark, sf)
    return harmonic.ranked(harmonic.compatible(s.where(F.col("id").isin(1, 2, 3, 11, 17, 40)), s).withColumn("bpm_dist", F.round("bpm_dist", 6)), 20)


QUERIES |= {"j09_compatible": j09_compatible, "x03_find_compatible": x03_find_compatible}
ORACLE_SQL |= {"j09_compatible": _COMPATIBLE.replace("{where}", ""), "x03_find_compatible": _COMPATIBLE.replace("{where}", "WHERE place <= 20")}


@query("""SELECT vec_id AS id, similarity, round(100.0 * (rank() OVER (ORDER BY similarity) - 1) / count(*) OVER (), 1) AS percentile, round(similarity - avg(similarity) OVER (), 6) AS above_mean FROM (
    SELECT a.vec_id, round(sum(a.z * t.z) / sqrt(sum(a.z * a.z) * sum(t.z * t.z)), 6) AS similarity FROM z a JOIN z t ON t.i = a.i AND t.vec_id = 1 WHERE a.vec_id <> 1 GROUP BY a.vec_id)""",
    "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings)", "z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM e)")
def x04_find_similar(spark, sf):
    v = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return harmonic.similar(v, 1)


@query("SELECT path, arg_max(root, length(root)) AS root FROM files LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path", b.ROOTS, b.FILES)
def j10_owner(spark, sf):
    return c.owner(b.files(spark, sf).distinct(), b.roots(spark, sf))


@query("SELECT a.root, b.root AS inside FROM roots a JOIN roots b ON starts_with(a.root, b.root || '/')", b.ROOTS)
def j11_overlapping_roots(spark, sf):
    return c.overlaps(b.roots(spark, sf))


@query("SELECT n.dir, n.n FROM n WHERE n.n >= 3 AND n.depth <= 2 AND NOT EXISTS (SELECT 1 FROM n u WHERE u.n >= 3 AND u.depth <= 2 AND starts_with(n.dir, u.dir || '/'))",
    b.FILES, "parts AS (SELECT path, string_split(path, '/') AS p FROM files)", "up AS (SELECT array_to_string(p[1:k], '/') AS dir, k - 1 AS depth FROM parts, (SELECT unnest([2, 3]) AS k))", "n AS (SELECT dir, depth, count(*) AS n FROM up GROUP BY ALL)")
def a29_discover(spark, sf):
    return c.discover(b.files(spark, sf), 3, 2)


@query("SELECT path, arg_min(library, length(library) * 1000 + id) AS library FROM (SELECT '/' || category || '/' || (id % 50) AS path, library, id FROM samples) GROUP BY path", b.SAMPLES)
def o04_keep_first(spark, sf):
    s = b.samples(spark, sf).select(F.concat(F.lit("/"), "category", F.lit("/"), (F.col("id") % 50).cast("string")).alias("path"), "library", "id")
    return c.keep_first(s, "path", F.length("library"), F.col("id")).select("path", "library")


@query("SELECT path FROM samples ORDER BY path LIMIT 25", b.SAMPLES)
def o01_first_by_path(spark, sf):
    return b.samples(spark, sf).select("path").orderBy("path").limit(25)


@query("SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 10", b.SAMPLES, b.TAGS)
def o06_top_tags(spark, sf):
    return b.tags(spark, sf).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("SELECT id, similarity FROM (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 2)), 6) AS similarity FROM embeddings WHERE vec_id <> 2) ORDER BY similarity DESC, id LIMIT 7")
def o03_nearest(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    aim = e.where("id = 2").select(F.col("v").alias("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    # One row.
    scored = e.where("id <> 2").join(F.broadcast(aim)).select("id", F.round(dot("v", "a") / F.sqrt(dot("v", "v") * dot("a", "a")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(7)


@query("SELECT label, root FROM roots ORDER BY length(label) DESC, label", b.ROOTS)
def o10_libraries(spark, sf):
    return b.roots(spark, sf).select("label", "root").orderBy(F.length("label").desc(), "label")


@query("SELECT category, path, total, total > 3 AS truncated FROM (SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY path) AS n, count(*) OVER (PARTITION BY category) AS total FROM samples) WHERE n <= 3", b.SAMPLES)
def o08_capped_but_counted(spark, sf):
    from pyspark.sql import Window

    s = b.samples(spark, sf).select("category", "path")
    total = s.groupBy("category").agg(F.count("*").alias("total"))
    first = s.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("path"))).where("n <= 3").drop("n")
    return first.join(total, "category").withColumn("truncated", F.col("total") > 3)


@query("SELECT root FROM roots WHERE NOT EXISTS (SELECT 1 FROM files WHERE path LIKE '%0' AND starts_with(path, root || '/'))", b.ROOTS, b.FILES)
def u03_orphan_roots(spark, sf):
    up = b.files(spark, sf).where(F.col("path").endswith("0")).select(F.explode(c.ancestors(F.col("path"))).alias("root")).distinct()
    return b.roots(spark, sf).select("root").join(up, "root", "left_anti")


@query("SELECT DISTINCT path FROM (SELECT path FROM samples WHERE library = 'lib0' UNION ALL SELECT path FROM samples WHERE bpm > 150)", b.SAMPLES)
def u01_union_of_libraries(spark, sf):
    s = b.samples(spark, sf)
    return s.where("library = 'lib0'").select("path").unionByName(s.where("bpm > 150").select("path")).distinct()


_OLD = "old AS (SELECT path, mtime + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS mtime, size FROM samples WHERE id % 3 <> 0)"
_NEW = "new AS (SELECT path, mtime, size FROM samples WHERE id % 4 <> 0)"


def _old(s):
    return s.where("id % 3 <> 0").select("path", (F.col("mtime") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("mtime"), "size")


@query("SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'pruned' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n FROM new n FULL JOIN old o ON n.path = o.path GROUP BY 1", b.SAMPLES, _OLD, _NEW)
def x06_index_actions(spark, sf):
    s = b.samples(spark, sf)
    return c.actions(s.where("id % 4 <> 0").select("path", "mtime", "size"), _old(s)).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT * FROM new UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)", b.SAMPLES, _OLD, _NEW)
def k04_upsert(spark, sf):
    s = b.samples(spark, sf)
    return c.upsert(_old(s), s.where("id % 4 <> 0").select("path", "mtime", "size"), "path")


@query("SELECT path, tag FROM tags WHERE NOT (tag = 'ECONOMY') UNION SELECT path, trim(' new ') FROM samples WHERE id % 9 = 0", b.SAMPLES, b.TAGS)
def k05_tag_changes(spark, sf):
    t = b.tags(spark, sf)
    gone = t.where("tag = 'ECONOMY'")
    new = b.samples(spark, sf).where("id % 9 = 0").select("path", F.trim(F.lit(" new ")).alias("tag"))
    return t.join(gone, ["path", "tag"], "left_anti").unionByName(new.where("tag <> ''")).dropDuplicates(["path", "tag"])


@query("SELECT path, CASE WHEN id % 4 = 0 THEN 'd' || id ELSE title END AS description FROM samples WHERE NOT (id % 4 = 0 AND id % 8 = 0)", b.SAMPLES)
def k06_descriptions(spark, sf):
    s = b.samples(spark, sf)
    changes = s.where("id % 4 = 0").select("path", F.when(F.col("id") % 8 != 0, F.concat(F.lit("d"), F.col("id").cast("string"))).alias("description"))
    return c.upsert(s.select("path", F.col("title").alias("description")), changes, "path").where("description IS NOT NULL AND description <> ''")


@query("SELECT path FROM samples WHERE NOT (starts_with(path, '/lib1/') AND (last_seen_at IS NULL OR last_seen_at < 250))", b.SAMPLES)
def k11_prune(spark, sf):
    return c.prune(b.samples(spark, sf), 250.0, "/lib1").select("path")


@query("SELECT path, tag FROM tags WHERE path NOT IN (SELECT path FROM samples WHERE starts_with(path, '/lib2/'))", b.SAMPLES, b.TAGS)
def k12_remove_root(spark, sf):
    gone = b.samples(spark, sf).where(F.col("path").startswith("/lib2/")).select("path")
    return b.tags(spark, sf).join(gone, "path", "left_anti")


@query("SELECT path, 2 AS generation, count(*) AS files FROM (SELECT category AS path FROM samples) GROUP BY path", b.SAMPLES)
def k10_scan_roots(spark, sf):
    s = b.samples(spark, sf)
    old = s.select(F.col("category").alias("path"), F.lit(1).alias("generation"), F.lit(0).cast("long").alias("files")).distinct()
    new = s.groupBy(F.col("category").alias("path")).agg(F.lit(2).alias("generation"), F.count("*").alias("files"))
    return c.upsert(old, new, "path")


@query(f"""SELECT key, (CASE WHEN minor THEN (pc + 3) % 12 ELSE pc END * 7 + 7) % 12 + 1 || CASE WHEN minor THEN 'A' ELSE 'B' END AS code FROM
    (SELECT key, CASE WHEN i % 2 = 1 THEN (i // 2 + 9) % 12 ELSE i // 2 END AS pc, i % 2 = 1 AS minor FROM (SELECT unnest({b.KEYS}) AS key, unnest(range(24)) AS i)) WHERE key IN (SELECT key FROM samples)""", b.SAMPLES)
def f21_camelot(spark, sf):
    return b.samples(spark, sf).where("key IS NOT NULL").select("key", music.camelot(F.col("key")).alias("code")).distinct()


@query("SELECT path, CASE WHEN acid_beats = 0 THEN NULL WHEN id % 2 = 0 THEN acid_beats WHEN abs(acid_beats / bpm * 60 - duration) / duration < 0.15 THEN acid_beats END AS beats FROM samples", b.SAMPLES)
def f28_vetted_beats(spark, sf):
    s = b.samples(spark, sf)
    return s.select("path", music.vetted_beats(F.col("acid_beats"), F.col("id") % 2 == 1, F.col("bpm"), F.col("duration")).alias("beats"))


@query("SELECT path, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][id % 128 % 12 + 1] || (id % 128 // 12 - 2) AS note, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024) || ' KiB' ELSE printf('%.1f', n / 1048576) || ' MiB' END AS size FROM (SELECT *, size * (id % 1000) AS n FROM samples)", b.SAMPLES)
def f18_note_names(spark, sf):
    return b.samples(spark, sf).select("path", music.note_name(F.col("id") % 128).alias("note"), text.human_size(F.col("size") * (F.col("id") % 1000)).alias("size"))


@query("SELECT path, CASE WHEN bpm IS NULL OR d < 60 OR d > 200 THEN bpm WHEN abs(d - bpm) <= 20 THEN round(d, 6) WHEN abs(d * 2 - bpm) <= 20 THEN round(d * 2, 6) WHEN abs(d * 0.5 - bpm) <= 20 THEN round(d * 0.5, 6) WHEN abs(d * 1.5 - bpm) <= 20 THEN round(d * 1.5, 6) WHEN abs(d / 1.5 - bpm) <= 20 THEN round(d / 1.5, 6) ELSE d END AS tempo FROM (SELECT path, (size % 260)::DOUBLE AS d, bpm FROM samples) WHERE bpm IS NOT NULL", b.SAMPLES)
def f26_improved_bpm(spark, sf):
    s = b.samples(spark, sf).where("bpm IS NOT NULL")
    return s.select("path", F.round(music.improved_bpm((F.col("size") % 260).cast("double"), F.col("bpm")), 6).alias("tempo"))
