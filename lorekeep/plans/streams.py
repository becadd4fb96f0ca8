"""Incremental and streaming plans; the event-time ones are extensions, in batch form for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.plans.registry import query, table
from lorekeep.streaming import feed


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("affected_documents", "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 50 = 0 OR source IN ('src3', 'src5')")
def affected_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a batch of changes touches, directly or through what they mention."""
    d = table(spark, sf, "documents")
    changes = d.where("doc_id % 50 = 0").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("ref")).union(spark.createDataFrame([("entity", "src3"), ("entity", "src5"), ("entity", "src3")], "kind string, ref string"))
    mentions = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("entity"))
    return feed.affected(changes, mentions).select(F.col("doc_id").cast("long").alias("doc_id"))


@query("stream_latest", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last event per user, taken in through a stream with idempotent batches."""
    schema = "user_id long, event_id long, event_type string"
    return feed.latest_by_key(spark, sf, schema, "user_id", "event_id", pattern="events.parquet")


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: six-hour windows."""
    w = feed.tumbling(_events(spark, sf), "6 hours")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("ext_sliding", "WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY start")
def ext_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: two-hour windows every hour."""
    w = _events(spark, sf).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("ext_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def ext_session(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions that six quiet hours end."""
    return feed.sessions(_events(spark, sf), "6 hours").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("ext_watermark_dedupe", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def ext_watermark_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: one row per user, type and day; on a stream a watermark bounds the state."""
    e = _events(spark, sf).withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", "2 days")
    return e.dropDuplicates(["user_id", "event_type", "day"]).select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))
