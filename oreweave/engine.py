"""The catalogue's tools on one object, over tables in any place that Spark reads and writes.

A catalogue is a folder of tables: samples, tags, descriptions, features, roots. Searching tools return DataFrames;
changing tools write a new version of a table beside the old one and then name it current, so a failed job leaves
the catalogue as it was.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.functions import music
from oreweave.operators import analysis, catalogue, fulltext, harmonic, regions
from oreweave.sources import defects, sniff, walkers
from oreweave.sources.scratch import cut

VERSION = 3
#: Versions of a table that stay, for readers that have begun with an older one.
KEPT = 3
SCHEMAS = {
    "samples": "path string, library string, format string, key string, title string, category string, mtime double, size long, duration double, bpm double, acid_beats long, root_note long, sample_rate long, channels long, bits_per_sample long, chunks string, last_seen_at double",
    "tags": "path string, tag string",
    "descriptions": "path string, description string",
    "features": "path string, vec array<double>, version int",
    "roots": "root string, label string, last_indexed_at double, files long",
}


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- tables

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _current(self, name: str) -> str | None:
        """The newest complete version: names sort by time."""
        fs, top = self._fs(), self._path(f"{self.folder}/{name}")
        if not fs.exists(top):
            return None
        done = [s.getPath().toString() for s in fs.listStatus(top) if fs.exists(self._path(f"{s.getPath().toString()}/_SUCCESS"))]
        return max(done, default=None)

    def table(self, name: str) -> DataFrame:
        current = self._current(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(current) if current else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.parquet(f"{self.folder}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        fs, top = self._fs(), self._path(f"{self.folder}/{name}")
        done = sorted(s.getPath().toString() for s in fs.listStatus(top) if fs.exists(self._path(f"{s.getPath().toString()}/_SUCCESS")))
        for old in done[:-KEPT]:
            fs.delete(self._path(old), True)

    # -- searching

    def search_samples(self, limit: int = 50, tags: list[str] | None = None, text: str | None = None, root: str | None = None, **filters) -> DataFrame:
        rows = catalogue.search(self.table("samples"), self.table("tags"), wanted=tags, scope=root, **filters)
        if text:
            rows = rows.join(fulltext.match(self.text_index(), text).withColumnRenamed("id", "path"), "path", "left_semi")
        return catalogue.page(rows, limit, F.col("path"))

    def text_index(self) -> DataFrame:
        """The index of the tables as they are now: written once, sorted by term, so that a search reads few of its pages."""
        made_from = hashlib.sha1("|".join(str(self._current(t)) for t in ("samples", "tags", "descriptions")).encode()).hexdigest()[:16]
        fs, top = self._fs(), f"{self.folder}/words"
        at = f"{top}/{made_from}"
        if not fs.exists(self._path(f"{at}/_SUCCESS")):
            docs = catalogue.documents(self.table("samples").select("path", "title", "category"), self.table("tags"), self.table("descriptions"))
            docs = docs.withColumn("tags", F.array_join("tags", " ")).withColumn("name", F.col("path"))
            found = fulltext.index(docs, "path", ["name", "title", "category", "tags", "description"])
            found.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(at)
            done = sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(self._path(top)))
            for _, old in done[:-KEPT]:
                fs.delete(self._path(old), True)
        return self.spark.read.parquet(at)

    def get_sample(self, path: str) -> DataFrame:
        one = lambda t: self.table(t).where(F.col("path") == path)
        found = one("features").where(F.col("version") == VERSION).select("path", F.lit(True).alias("has_features"))
        docs = catalogue.documents(one("samples"), one("tags"), one("descriptions"))
        return docs.join(found, "path", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))

    def locate_sample(self, name: str, limit: int = 10) -> DataFrame:
        return catalogue.page(self.table("samples").where(catalogue.contains(F.col("path"), name)).select("path"), limit, F.col("path"))

    def list_libraries(self) -> DataFrame:
        counts = self.table("samples").groupBy(F.col("library").alias("label")).agg(F.count("*").alias("samples"))
        return self.table("roots").join(counts, "label", "left").orderBy(F.desc_nulls_last("last_indexed_at"), "label")

    def list_tags(self, prefix: str = "") -> DataFrame:
        return catalogue.facet(self.table("tags").where(catalogue.starts_with(F.col("tag"), prefix)), "tag").orderBy(F.desc("n"), "value")

    def list_keys(self) -> DataFrame:
        return catalogue.facet(self.table("samples"), "key").orderBy(F.desc("n"), "value")

    def list_formats(self) -> DataFrame:
        return catalogue.facet(self.table("samples"), "format").orderBy(F.desc("n"), "value")

    def index_stats(self, by_library: bool = False) -> DataFrame:
        return catalogue.stats(self.table("samples"), self.table("tags"), self.table("features"), VERSION, by_library)

    def find_compatible(self, path: str, bpm_tolerance_pct: float = 6, half_double: bool = True, limit: int = 20) -> DataFrame:
        s = self.table("samples")
        return harmonic.ranked(harmonic.compatible(s.where(F.col("path") == path), s, bpm_tolerance_pct / 100, half_double), limit)

    def find_similar(self, path: str, n: int = 5, kind: str | None = None) -> DataFrame:
        f = self.table("features").where(F.col("version") == VERSION)
        if kind:
            fitting = self.table("samples").where(catalogue.is_kind(kind, F.col("duration"), F.col("acid_beats")) | (F.col("path") == path))
            f = f.join(fitting.select("path"), "path", "left_semi")
        return harmonic.similar(f.select(F.col("path").alias("id"), "vec"), path).orderBy(F.desc("similarity"), "id").limit(n)

    # -- hearing

    def _read(self, paths: list[str]) -> DataFrame:
        """path, format, content of named files."""
        found = self.spark.read.format("binaryFile").load(paths)
        return sniff.sniffed(found.select("path", "content")).withColumn("format", F.coalesce("format", F.nullif(sniff.extension(F.col("path")), F.lit(""))))

    def analyze_sample(self, path: str) -> DataFrame:
        """Key, tempo, bandwidth and features of one file, from its sound and its name."""
        return analysis.analyzed(self._read([path]))

    def detect_bpm_key(self, path: str) -> DataFrame:
        return self.analyze_sample(path).select("path", "bpm", "key", "heard_bpm", "heard_key", "key_margin", "key_relative")

    def locate_sound(self, path: str, mode: str = "normal") -> DataFrame:
        """Where the sound is in a file of any kind."""
        return regions.located(self._read([path]).select(F.col("path").alias("file"), F.col("content").alias("data")), mode)

    def inspect(self, path: str) -> DataFrame:
        return walkers.chunks(self._read([path]))

    def defects(self, path: str) -> DataFrame:
        return defects.defects(self._read([path]))

    def reindex_features(self, most: int = 10_000) -> int:
        """Hear up to `most` samples whose vectors are missing or of an old version (a batch's size: call again for the rest)."""
        paths = [r["path"] for r in self.stale_features().orderBy("path").limit(most).collect()]
        if paths:
            self.set_features(analysis.heard(self._read(paths)).select("path", "vec"))
        return len(paths)

    def stale_features(self) -> DataFrame:
        return catalogue.stale(self.table("samples"), self.table("features"), VERSION).select("path")

    # -- changing

    def reindex(self, root: str, label: str, extensions: list[str] | None = None) -> dict[str, int]:
        """Scan root, read what is new or changed, drop what is gone; counts by action."""
        began = time.time()
        files = sniff.identified(sniff.scan(self.spark, root, extensions)).withColumns({"mtime": F.unix_micros("modificationTime") / 1e6, "size": F.col("length")})
        old, mine = self.table("samples"), F.col("library") == label
        # One listing for all that follows: files may change meanwhile.
        actions = cut(catalogue.actions(files.select("path", "mtime", "size"), old.where(mine)))
        counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        fresh = files.join(actions.where(F.col("action").isin("added", "updated")).select("path"), "path", "left_semi")
        rows = self._described(fresh, label, began)
        kept = old.where(mine).join(actions.where("action = 'skipped'").select("path"), "path", "left_semi").withColumn("last_seen_at", F.lit(began))
        self._write("samples", old.where(~mine | F.col("library").isNull()).unionByName(kept).unionByName(rows))
        gone = actions.where("action = 'pruned'").select("path")
        for name in ("tags", "descriptions", "features"):
            if self._current(name):
                self._write(name, self.table(name).join(gone, "path", "left_anti"))
        self.register_library(root, label, began, sum(v for k, v in counts.items() if k != "pruned"))
        return counts

    def _described(self, files: DataFrame, label: str, seen: float) -> DataFrame:
        found = walkers.chunks(files)
        fields = walkers.flat_fields(found)
        number = lambda n: F.max(F.when(F.col("name") == n, F.col("value").try_cast("double")))
        facts = fields.groupBy("path").agg(
            number("sample_rate").alias("sample_rate"), number("channels").alias("channels"), number("bits_per_sample").alias("bits_per_sample"), number("byte_rate").alias("byte_rate"),
            number("beats").alias("acid_beats"), number("tempo").alias("tempo"), number("root_note").alias("root_note"), F.max(F.when(F.col("name") == "text", F.col("value"))).alias("title"),
        )
        lists = found.groupBy("path").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"])), ",").alias("chunks"), F.max(F.when(F.col("id") == "data", F.col("size"))).alias("bytes"))
        rows = files.select("path", "format", "mtime", "size").join(facts, "path", "left").join(lists, "path", "left")
        named = music.bpm_from_name(F.element_at(F.split("path", "/"), -1))
        whole = lambda c: F.col(c).cast("long")
        return rows.select(
            "path", F.lit(label).alias("library"), "format", F.lit(None).cast("string").alias("key"), "title", F.lit(None).cast("string").alias("category"), "mtime", "size",
            F.when(F.col("byte_rate") > 0, F.col("bytes") / F.col("byte_rate")).alias("duration"), F.coalesce(F.when(F.col("tempo") > 0, F.col("tempo")), named).alias("bpm"), whole("acid_beats").alias("acid_beats"),
            F.when(F.col("root_note") > 0, whole("root_note")).alias("root_note"), whole("sample_rate").alias("sample_rate"), whole("channels").alias("channels"), whole("bits_per_sample").alias("bits_per_sample"), "chunks", F.lit(seen).alias("last_seen_at"),
        )

    def register_library(self, root: str, label: str, indexed_at: float | None = None, files: int = 0) -> None:
        """A root that lies in or over another label's root is refused."""
        mine = self.spark.createDataFrame([(root.rstrip("/"), label, indexed_at, files)], SCHEMAS["roots"])
        others = self.table("roots").where(F.col("label") != label)
        if catalogue.overlaps(others.unionByName(mine)).where((F.col("root") == root.rstrip("/")) | (F.col("inside") == root.rstrip("/"))).count() or others.where(F.col("root") == root.rstrip("/")).count():
            raise ValueError(f"{root} overlaps a registered library")
        self._write("roots", catalogue.upsert(self.table("roots"), mine, "label"))

    def forget_library(self, label: str) -> None:
        gone = self.table("samples").where(F.col("library") == label).select("path")
        for name in ("tags", "descriptions", "features"):
            self._write(name, self.table(name).join(gone, "path", "left_anti"))
        self._write("samples", self.table("samples").where(F.col("library") != label))
        self._write("roots", self.table("roots").where(F.col("label") != label))

    def discover_libraries(self, root: str, min_samples: int = 20, max_depth: int = 3) -> DataFrame:
        """Directories below root worth registering that no registered root covers."""
        files = sniff.scan(self.spark, root).select("path")
        found = catalogue.discover(files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path")), min_samples, max_depth)
        return catalogue.owner(found.select(F.col("dir").alias("path")), self.table("roots")).where("root IS NULL").select(F.col("path").alias("dir")).join(found, "dir")

    def tag_sample(self, path: str, add: list[str] = (), remove: list[str] = ()) -> None:
        new = self.spark.createDataFrame([(path, t.strip()) for t in add if t.strip()], SCHEMAS["tags"])
        gone = self.spark.createDataFrame([(path, t.strip()) for t in remove], SCHEMAS["tags"])
        self._write("tags", self.table("tags").join(gone, ["path", "tag"], "left_anti").unionByName(new).dropDuplicates(["path", "tag"]))

    def set_sample_description(self, path: str, description: str | None) -> None:
        change = self.spark.createDataFrame([(path, description)], SCHEMAS["descriptions"])
        self._write("descriptions", catalogue.upsert(self.table("descriptions"), change, "path").where("description <> ''"))

    def set_features(self, vectors: DataFrame) -> None:
        """path, vec of the current version."""
        self._write("features", catalogue.upsert(self.table("features"), vectors.select("path", F.col("vec").cast("array<double>").alias("vec"), F.lit(VERSION).alias("version")), "path"))
