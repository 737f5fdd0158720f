"""Streaming queries over events, drained to their end, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.sources.package import ship
from oreweave.streaming import ops


def _events(spark, sf):
    ship(spark)
    return ops.source(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def t01_merge_batches(spark, sf):
    newest = ops.merged(_events(spark, sf).select("user_id", "event_id", "ts", "event_type"), "user_id", F.struct("ts", "event_id"))
    return newest.select("user_id", "event_id", "event_type")


def t02_prune_unseen(spark, sf):
    newest = ops.merged(_events(spark, sf).select("user_id", "event_id", "ts"), "user_id", F.struct("ts", "event_id"))
    return newest.where("event_id < 9900").select("user_id", "event_id")


def t03_running_counts(spark, sf):
    return ops.collected(_events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")), "complete")


def t04_sessions(spark, sf):
    s = ops.collected(ops.sessions(_events(spark, sf), "6 hours", "user_id"), "complete")
    return s.select("user_id", "start", "n")


def t06_carried_state(spark, sf):
    rows = ops.collected(ops.carried(_events(spark, sf), "user_id", F.get_json_object("props", "$.k")), "update")
    # Of several batches the last one of each key counts.
    return rows.groupBy(F.col("key").alias("user_id")).agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def t08_tumbling_stream(spark, sf):
    w = ops.collected(ops.tumbling(_events(spark, sf), "6 hours", ["event_type"]), "complete")
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def t08_sliding_stream(spark, sf):
    return ops.collected(ops.sliding(_events(spark, sf), "12 hours", "6 hours", ["event_type"]), "complete")


QUERIES = {f.__name__: f for f in (t01_merge_batches, t02_prune_unseen, t03_running_counts, t04_sessions, t06_carried_state, t08_tumbling_stream, t08_sliding_stream)}
_NEWEST = "SELECT user_id, arg_max(event_id, epoch_us(ts)::HUGEINT * 10000000000 + event_id) AS event_id, arg_max(event_type, epoch_us(ts)::HUGEINT * 10000000000 + event_id) AS event_type FROM events GROUP BY user_id"
ORACLE_SQL = {
    "t01_merge_batches": _NEWEST,
    "t02_prune_unseen": f"SELECT user_id, event_id FROM ({_NEWEST}) WHERE event_id < 9900",
    "t03_running_counts": "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type",
    "t04_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN ts < p + INTERVAL 6 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, g",
    "t06_carried_state": "SELECT user_id, count(*) AS n, (sum((props->>'$.k')::BIGINT) % 256)::BIGINT AS total FROM events GROUP BY user_id",
    "t08_tumbling_stream": "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "t08_sliding_stream": "SELECT time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
}
