"""The change feed as a stream: micro-batches, idempotent upserts, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import shared_dir


def drain(spark: SparkSession, source: DataFrame, apply: Callable[[DataFrame, int], None], name: str) -> None:
    """Run all available changes through apply, batch by batch.

    Batches are delivered at least once; apply must be idempotent. The checkpoint lies in the shared folder, and
    one query per checkpoint is the single writer.
    """
    query = source.writeStream.foreachBatch(apply).option("checkpointLocation", f"{shared_dir(spark)}/feed/{name}").trigger(availableNow=True).start()
    query.awaitTermination()


def affected(changes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents to project again: changed ones, and those that mention a changed thing. changes: kind, ref."""
    direct = changes.where("kind = 'document'").select(F.col("ref").alias("doc_id"))
    things = changes.where("kind = 'entity'").select("ref").distinct()
    return direct.union(mentions.join(things, mentions["entity"] == things["ref"], "left_semi").select("doc_id")).distinct()


def latest_by_key(spark: SparkSession, folder: str, schema: str, key: str, order: str, pattern: str = "*.parquet", per_batch: int = 2) -> DataFrame:
    """The last version of each key of a folder of change files, taken in as a stream of micro-batches.

    Each batch keeps its own latest rows in a batch folder, overwritten when the batch is delivered again;
    the latest of all batches is read back.
    """
    out = f"{shared_dir(spark)}/feed/latest-{uuid.uuid4().hex[:12]}"
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).parquet(folder)

    def apply(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("row"))
        newest.select(key, "row.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(spark, changes, apply, uuid.uuid4().hex[:12])
    kept = spark.read.parquet(out)
    rest = [c for c in kept.columns if c not in (key, "batch")]
    return kept.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("row")).select(key, "row.*")


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with late, on a stream, rows later than that are dropped."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
