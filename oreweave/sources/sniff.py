"""What a file is by its first bytes: an ordered list of magic numbers as one CASE expression."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreweave.functions import frames

#: Published magic numbers (fixed values): format, offset and bytes, then an optional second offset and bytes. First match wins.
MAGICS: list[tuple] = [
    ("wav", 0, b"RIFF", 8, b"WAVE"),
    ("avi", 0, b"RIFF", 8, b"AVI "),
    ("sf2", 0, b"RIFF", 8, b"sfbk"),
    ("rmid", 0, b"RIFF", 8, b"RMID"),
    ("rf64", 0, b"RF64", 8, b"WAVE"),
    ("rifx", 0, b"RIFX"),
    ("akp", 0, b"RIFF", 8, b"APRG"),
    ("cdxa", 0, b"RIFF", 8, b"CDXA"),
    ("riff", 0, b"RIFF"),
    ("aiff", 0, b"FORM", 8, b"AIFF"),
    ("aifc", 0, b"FORM", 8, b"AIFC"),
    ("8svx", 0, b"FORM", 8, b"8SVX"),
    ("smus", 0, b"FORM", 8, b"SMUS"),
    ("e4b", 0, b"FORM", 8, b"E4B0"),
    ("e5b", 0, b"FORM", 8, b"E5B0"),
    ("iff", 0, b"FORM"),
    ("rx2", 0, b"CAT ", 8, b"REX2"),
    ("midi2", 0, b"SMF2CLIP"),
    ("midi", 0, b"MThd"),
    ("flac", 0, b"fLaC"),
    ("ogg", 0, b"OggS"),
    ("au", 0, b".snd"),
    ("mp3", 0, b"ID3"),
    ("mp4", 4, b"ftyp"),
    ("caf", 0, b"caff"),
    ("voc", 0, b"Creative Voice File\x1a"),
    ("wavpack", 0, b"wvpk"),
    ("ape", 0, b"MAC "),
    ("xm", 0, b"Extended Module: "),
    ("it", 0, b"IMPM"),
    ("s3m", 44, b"SCRM"),
    ("mod", 1080, b"M.K."),
    ("nsf", 0, b"NESM\x1a"),
    ("sid", 0, b"PSID"),
    ("rsid", 0, b"RSID"),
    ("vag", 0, b"VAGp"),
    ("nsfe", 0, b"NSFE"),
    ("sap", 0, b"SAP\r\n"),
    ("okt", 0, b"OKTASONG"),
    ("med", 0, b"MMD0"),
    ("med", 0, b"MMD1"),
    ("med", 0, b"MMD2"),
    ("med", 0, b"MMD3"),
    ("fc", 0, b"FC13"),
    ("fc", 0, b"FC14"),
    ("gf1pat", 0, b"GF1PATCH1"),
    ("brstm", 0, b"RSTM"),
    ("hps", 0, b" HALPST\0"),
    ("fxp", 0, b"CcnK"),
    ("wt", 0, b"vawt"),
    ("krz", 0, b"PRAM"),
    ("ncw", 0, b"\x01\xa8\x9e\xd6"),
    ("amxd", 0, b"ampf"),
    ("bitwig", 0, b"BtWg"),
    ("gcm", 28, b"\xc2\x33\x9f\x3d"),
    ("cdxa", 0, b"\0\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\0"),
    ("gzip", 0, b"\x1f\x8b"),
    ("zip", 0, b"PK\x03\x04"),
    ("png", 0, b"\x89PNG"),
    ("mp3", 0, b"\xff\xfb"),
]

#: What a zip file is by a member, and compressed XML by its root and the file's extension.
MEMBERS = {"multisample.xml": "multisample", "Expansion.xml": "xpn", "bank.xml": "labx", "SNAPSHOT": "als"}
LIVE = ("als", "alc", "adg", "adv", "agr")
#: Tags of module files at byte 1080 with other than four channels.
MODULES = re.compile(rb"M[.!]K[.!]|FLT[48]|OCTA|CD81|\d\dC[HN]|\dCHN")


def sniff(content: Column) -> Column:
    """The format of a file's bytes, null if no magic matches."""
    def at(offset: int, magic: bytes) -> Column:
        return F.substring(content, offset + 1, len(magic)) == F.lit(magic)

    out = F.lit(None).cast("string")
    for name, *tests in reversed(MAGICS):
        match = at(tests[0], tests[1]) & (at(tests[2], tests[3]) if len(tests) > 2 else F.lit(True))
        out = F.when(match, name).otherwise(out)
    return out


def deep(data: bytes, path: str, first: str | None) -> str | None:
    """A second look at what a magic number alone does not tell, or tells wrongly.

    A frame header needs a second frame where the first one ends; a tag in front of other sound is named; zip files and
    compressed XML are told by what is in them; formats without a magic number are told by sizes that must fit.
    """
    suffix = path.rpartition(".")[2].lower()
    if first == "mp3" and data[:3] == b"ID3" and len(data) > 10:
        after = 10 + sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(data[6:10]))
        if data[after : after + 4] in (b"fLaC", b"RIFF", b"FORM", b"OggS") or data[after + 4 : after + 8] == b"ftyp":
            return "id3-wrapped"
    elif first == "mp3" or first is None and data[:1] == b"\xff":
        head = frames.mpeg_header(data, 0)
        first = "mp3" if head and frames.mpeg_header(data, head["length"]) else None
    if first == "zip":
        for name, kind in MEMBERS.items():
            if name.encode() in data:
                return kind
    elif first == "gzip":
        try:
            head = zlib.decompressobj(31).decompress(data[: 1 << 16], 4096)
        except zlib.error:
            return first
        return (suffix if suffix in LIVE else "als") if b"<Ableton" in head else first
    if first is not None:
        return first
    if data[32_769:32_774] == b"CD001":
        return "iso"
    if len(data) >= 1084 and MODULES.fullmatch(data[1080:1084]):
        return "mod"
    if suffix == "cue" and re.search(rb"(?mi)^\s*FILE\s", data[:4096]):
        return "cue"
    if len(data) >= 8 and data[:2] == b"\3\0" and int.from_bytes(data[4:8], "little") + 8 == len(data):
        return "dmx"
    if len(data) >= 6 and data[:2] == b"\x80\0" and (at := int.from_bytes(data[2:4], "big")) >= 2 and data[at - 2 : at + 4] == b"(c)CRI":
        return "adx"
    end = data.find(b"\r\n\x1a", 0, 512)
    if end >= 0 and (base := data.find(b"\0", end + 3, end + 64) + 1) and base + 4 <= len(data):
        voices, channel = int.from_bytes(data[base : base + 2], "big"), int.from_bytes(data[base + 2 : base + 4], "big")
        if channel >= 20 and base + max(voices, channel) <= len(data):
            return "mdx"
    if data.lstrip(b" \t\r\n")[:1] == b"{" and suffix in ("vital", "sigmf-meta"):
        return "vital" if suffix == "vital" else "sigmf"
    return None


def sniffed(files: DataFrame) -> DataFrame:
    """files (path, content) with format: by magic, and where that leaves doubt by a second look."""

    @F.pandas_udf(T.StringType())
    def again(content: pd.Series, path: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([deep(c or b"", p or "", f) for c, p, f in zip(content, path, first.where(first.notna(), None), strict=True)], dtype=object)

    doubt = F.col("_first").isNull() | F.col("_first").isin("mp3", "zip", "gzip")
    looked = files.withColumn("_first", sniff(F.col("content")))
    # Content goes to Python only where it is looked at again.
    return looked.withColumn("format", F.when(doubt, again(F.when(doubt, F.col("content")), "path", "_first")).otherwise(F.col("_first"))).drop("_first")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


#: Files that a tree scan leaves out (fixed values).
JUNK = ["._*", ".ds_store", "thumbs.db", "desktop.ini"]


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files below root, junk left out."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(~name.startswith("._") & ~name.isin(*JUNK[1:]))
    return files.where(extension(F.col("path")).isin(*[e.lower() for e in extensions])) if extensions else files


def identified(files: DataFrame) -> DataFrame:
    """files with format: by magic, else by extension."""
    return files.withColumn("format", F.coalesce(sniff(F.col("content")), F.nullif(extension(F.col("path")), F.lit(""))))


def expanded(listing: DataFrame, inputs: list[str], accept: list[str] | None = None, recurse: bool = True) -> DataFrame:
    """path, named, kept for files that inputs (files and folders) name: each once, and in order of path where it matters.

    listing: path of every file there is. A file that is named itself is kept whatever its extension; one in a folder only
    if that is accepted. Without recurse a folder's own files alone count. Rows that aren't kept are those left out.
    """
    spark = listing.sparkSession
    wanted = spark.createDataFrame([(p.rstrip("/"),) for p in dict.fromkeys(inputs)], "input string")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = F.array_union(F.array(F.col("path")), above if recurse else F.array(F.regexp_replace("path", "/[^/]*$", "")))
    # The inputs are a literal list.
    met = listing.select("path", F.explode(own).alias("input")).join(F.broadcast(wanted), "input")
    out = met.groupBy("path").agg(F.bool_or(F.col("input") == F.col("path")).alias("named"))
    fits = extension(F.col("path")).isin(*[e.lower().lstrip(".") for e in accept]) if accept else F.lit(True)
    return out.withColumn("kept", F.col("named") | fits)
