"""The search index of all documents: builds beside the live one, updates, deletions, and what readers of each state see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.plans.registry import query, table
from lorekeep.session import shared_dir
from lorekeep.sources.index import SearchIndex

_HASH = "substr(sha256(coalesce(text, '')), 1, 16)"


def _index(spark: SparkSession, model: str) -> SearchIndex:
    """An index whose vectors stand for a model's: they tell the model and the content."""
    return SearchIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}", lambda rows: rows.withColumn("embedding", F.concat(F.lit(model), F.lit(":"), "content_hash")))


@query(
    "index_versions",
    f"""WITH d AS (SELECT doc_id, {_HASH} AS h, source, doc_id % 5 = 0 AS edited, doc_id % 7 = 0 AS moved, doc_id % 11 = 0 AS gone, doc_id % 13 = 0 AS late FROM documents)
    SELECT 'built' AS view, doc_id AS id, source, concat('m1:', h) AS embedding FROM d WHERE NOT late
    UNION ALL SELECT 'updated', doc_id, CASE WHEN moved OR edited OR late THEN concat('new ', source) ELSE source END, concat('m1:', CASE WHEN edited THEN concat(h, '+') ELSE h END) FROM d WHERE NOT gone
    UNION ALL SELECT 'failed build', doc_id, CASE WHEN moved OR edited OR late THEN concat('new ', source) ELSE source END, concat('m1:', CASE WHEN edited THEN concat(h, '+') ELSE h END) FROM d WHERE NOT gone
    UNION ALL SELECT 'rebuilt', doc_id, source, concat('m2:', h) FROM d""",
)
def index_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Four readers of one index: after the first build, after updates and deletions, after a build that failed, and after the next model's build."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr("substr(sha2(coalesce(text, ''), 256), 1, 16)").alias("content_hash"), "source")
    index = _index(spark, "m1")
    index.build(d.where("id % 13 <> 0"))
    views = {"built": index.read()}
    edited = F.when(F.col("id") % 5 == 0, F.concat("content_hash", F.lit("+"))).otherwise(F.col("content_hash"))
    index.update(d.where("id % 5 = 0 or id % 7 = 0 or id % 13 = 0").select("id", edited.alias("content_hash"), F.concat(F.lit("new "), "source").alias("source")))
    index.delete(d.where("id % 11 = 0").select("id"))
    views["updated"] = index.read()
    try:
        index.build(d.union(d.where("id % 3 = 0")))
    except ValueError:
        views["failed build"] = index.read()
    index.embed = lambda rows: rows.withColumn("embedding", F.concat(F.lit("m2:"), "content_hash"))
    index.build(d)
    views["rebuilt"] = index.read()
    rows = [view.select(F.lit(name).alias("view"), "id", "source", "embedding") for name, view in views.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])
