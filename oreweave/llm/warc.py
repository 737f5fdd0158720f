"""WARC archives with revisit resolution: equal payloads are stored once and referred to from then on.

Headers (id, url, digest, length) are shuffled by payload digest; the record with the largest id of each digest is the
response that the others revisit. What is found goes back to the records in a join, for which payloads are moved once. A
digest shared by a third of all pages is met in many tasks (shares of a digest are salted). Each record is a gzip member of its own, as the format asks
for. Members are written by Spark's own text writer, so the archives get the commit protocol, any Hadoop file
system and retries after lost executors; what the writer puts between records is an empty gzip member whose
comment is a random mark drawn after the payloads exist. Readers of gzip skip it; Spark's reader splits large
archives between tasks by it. `parse_archive` reads any WARC file, compressed or not, without knowing the mark.

Defined cases: a null payload is empty; equal payloads shorter than `min_payload` bytes are all responses;
repeated rows of the response's id are all responses; a row with a null id never becomes the response unless
all of its group have none; a null or blank url becomes the record's own id; an empty table gives no archive
and no rows; columns besides those named are ignored.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.llm import base

#: Fixed values of RFC 4648 (base32) and of the WARC/1.1 specification.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: forty bits become eight digits, four times."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def resolve(pages: DataFrame, min_payload: int = 0, salts: int = 64) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to, refers_url."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select("page_id", "url", payload.alias("payload"))
    records = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    headers = records.select("page_id", "url", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= min_payload)
    shares = headers.withColumn("_salt", base.salt_of(F.col("page_id"), salts=salts))
    newest = F.max(F.struct("page_id", "url"))
    winners = shares.groupBy("payload_digest", "payload_bytes", "_salt").agg(newest.alias("r"), F.count("*").alias("n"))
    winners = winners.groupBy("payload_digest", "payload_bytes").agg(F.max("r").alias("r"), F.sum("n").alias("n"), F.collect_list("_salt").alias("salts")).where("n > 1")
    winners = winners.select(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"), F.col("r.page_id").alias("_id"), F.col("r.url").alias("_url"), F.explode("salts").alias("_s"))
    salted = records.withColumn("_salt", base.salt_of(F.col("page_id"), salts=salts))
    on = (salted["payload_digest"] == winners["_d"]) & (salted["payload_bytes"] == winners["_b"]) & (salted["_salt"] == winners["_s"])
    revisit = F.col("_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_id"))
    out = salted.join(winners, on, "left").withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("_id")),
        "refers_url": F.when(revisit, F.col("_url")),
    })
    return out.drop("_salt", "_d", "_b", "_id", "_url", "_s")


def _uri(url: Column, record_id: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7f<>]", "")
    return F.when(clean == "", record_id).otherwise(clean)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def _mark(name: str) -> bytes:
    """A gzip member of no data with name as its comment (RFC 1952)."""
    return b"\x1f\x8b\x08\x10\0\0\0\0\0\xff" + name.encode() + b"\0" + b"\x03\0" + bytes(8)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64).column(0)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 6, mtime=0) for x in part.to_pylist()], pa.binary())], ["member"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64).column(0)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.decompress(x) for x in part.to_pylist()], pa.binary())], ["raw"])


def write(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 0) -> str:
    """Write the archives with fresh headers; gives the mark that the splittable reader needs."""
    mark = uuid.uuid4().hex
    own = _record_id(F.col("page_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL)).cast("binary")
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.col("record_type"),
        F.lit(f"{EOL}WARC-Record-ID: <"), own, F.lit(f">{EOL}WARC-Date: {date}{EOL}WARC-Target-URI: "), _uri(F.col("url"), own),
        F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.lit(f"{EOL}WARC-Profile: {REVISIT_PROFILE}{EOL}WARC-Refers-To: <"), _record_id(F.col("refers_to")),
            F.lit(f">{EOL}WARC-Refers-To-Target-URI: "), _uri(F.col("refers_url"), _record_id(F.col("refers_to"))), F.lit(f"{EOL}WARC-Truncated: length"))),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL),
    )
    record = F.concat(head.cast("binary"), block, F.lit(EOL + EOL).cast("binary")).alias("record")
    # A binary cast to string keeps its bytes, and the text writer puts them out as they are.
    members = resolved.select(record).mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    out = members.write.option("lineSep", _mark(mark).decode("latin-1")).option("encoding", "ISO-8859-1")
    (out.option("maxRecordsPerFile", records_per_file) if records_per_file else out).text(path)
    return mark


def read(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """The records of archives that `write` made, split between tasks; bytes are cut by Content-Length."""
    raw = spark.read.option("lineSep", _mark(mark).decode("latin-1")).option("encoding", "ISO-8859-1").text(path).where("value <> ''")
    whole = raw.select(F.col("value").cast("binary").alias("member")).mapInArrow(_records, "raw binary").withColumn("value", F.col("raw").cast("string"))
    # Header lines are cut as characters, the block as bytes.
    whole = whole.withColumn("head", F.expr("substring(value, 1, instr(value, '\\r\\n\\r\\n') + 1)"))
    whole = whole.withColumn("start", F.octet_length("head") + 2)

    def field(name: str) -> Column:
        return F.regexp_extract("head", f"(?:^|\n){name}: ([^\r]*)\r", 1)

    whole = whole.withColumn("length", field("Content-Length").cast("int"))
    whole = whole.withColumn("block", F.expr("substring(raw, start + 1, length)"))
    whole = whole.withColumn("http", F.expr("substring(cast(block as string), 1, instr(cast(block as string), '\\r\\n\\r\\n') + 1)"))
    def page(name: str) -> Column:
        return F.regexp_extract("head", f"\n{name}: <urn:x-page:([^>]*)>", 1).try_cast("long")

    response = F.col("record_type") == "response"
    fields = whole.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.when(F.octet_length("block") == F.col("length"), F.expr("substring(block, octet_length(http) + 3)")).alias("payload"),
        F.regexp_extract("http", "\nContent-Length: ([0-9]+)", 1).try_cast("long").alias("payload_bytes"),
        F.regexp_extract("head", "\nWARC-Payload-Digest: sha1:([A-Z2-7]*)", 1).alias("declared"),
        page("WARC-Refers-To").alias("refers_to"),
    )
    out = fields.withColumns({
        "payload": F.when(response, F.col("payload")),
        "payload_bytes": F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")),
        "payload_digest": F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("declared")),
    })
    return out.withColumn("intact", F.col("payload_digest") == F.col("declared")).drop("declared")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length
