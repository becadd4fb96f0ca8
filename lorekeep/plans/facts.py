"""Facts derived from the event log and the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import facts
from lorekeep.plans.ranking import periods_from_changes
from lorekeep.plans.registry import query, table

_PERIODS = "p AS (SELECT user_id, event_type, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"


@query("as_of_exclusive", f"WITH {_PERIODS} SELECT event_id FROM p WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def as_of_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """What was valid on a day, end dates being the first day after."""
    return facts.as_of(periods_from_changes(spark, sf), "2024-01-15", "exclusive").select("event_id")


@query("as_of_inclusive", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-03-01' AND o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1998-03-01'")
def as_of_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    """What was valid on a day, end dates being the last valid day."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_to"))
    return facts.as_of(o, "1998-03-01", "inclusive").select("o_orderkey")


@query(
    "timeline_text",
    """WITH f AS (SELECT o_custkey, o_orderkey, o_orderpriority AS value, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
    SELECT o_custkey, string_agg(concat(value, ' (', CASE WHEN b IS NULL THEN concat('since ', strftime(a, '%b %Y')) ELSE concat(strftime(a, '%b %Y'), ' - ', strftime(b, '%b %Y')) END, ')'), ' -> ' ORDER BY a, o_orderkey) AS timeline FROM f GROUP BY o_custkey HAVING count(*) >= 2""",
)
def timeline_text(spark: SparkSession, sf: str) -> DataFrame:
    """How each customer's priority went over time, in words."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders")
    f = o.select("o_custkey", F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))
    return facts.timelines(f, ["o_custkey"])


@query("timeline_consolidate")
def timeline_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each fact closed, superseded or folded."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_id") % 5 == 0, "superseded").otherwise("accepted")
    f = e.select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 20).cast("string").alias("value"), F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), status.alias("status"))
    return facts.consolidate(f)


_CLAIMS = """c AS (SELECT o_custkey AS subject, CASE o_orderkey % 4 WHEN 0 THEN 'invoice balance' WHEN 1 THEN 'price terms' WHEN 2 THEN 'known workaround' ELSE 'note' END AS predicate,
  CASE o_orderkey % 3 WHEN 0 THEN 'system_of_record' WHEN 1 THEN 'official_document' ELSE 'interview' END AS kind, o_orderpriority AS value FROM orders)"""


@query(
    "authority_pick",
    f"""WITH {_CLAIMS}, r AS (SELECT *, CASE predicate WHEN 'invoice balance' THEN CASE kind WHEN 'system_of_record' THEN 5 WHEN 'official_document' THEN 3 ELSE 1 END WHEN 'price terms' THEN CASE kind WHEN 'official_document' THEN 5 WHEN 'system_of_record' THEN 3 ELSE 1 END
      WHEN 'known workaround' THEN CASE kind WHEN 'interview' THEN 4 WHEN 'official_document' THEN 2 ELSE 1 END ELSE CASE kind WHEN 'system_of_record' THEN 4 WHEN 'official_document' THEN 3 ELSE 1 END END AS rank FROM c)
    SELECT subject, predicate, kind, value, rank FROM r QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY rank DESC, value, kind) = 1""",
)
def authority_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Of several claims the one whose source counts most for that kind of statement."""
    pick = lambda names, m: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % m + 1).cast("int"))
    claims = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), pick(("invoice balance", "price terms", "known workaround", "note"), 4).alias("predicate"), pick(("system_of_record", "official_document", "interview"), 3).alias("kind"), F.col("o_orderpriority").alias("value"))
    return facts.best_claims(claims)


@query("review_decisions", "SELECT o_orderkey AS fact_id, CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'disputed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'superseded' ELSE 'candidate' END AS status FROM orders UNION ALL SELECT o_orderkey + 10000000, 'accepted' FROM orders WHERE o_orderkey % 5 = 3")
def review_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions applied to facts; a correction supersedes the fact by a new one."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fact_id"), F.lit("candidate").alias("status"))
    action = F.element_at(F.array(*[F.lit(x) for x in ("accept", "dispute", "reject", "correct", "none")]), (F.col("fact_id") % 5 + 1).cast("int"))
    decided = o.withColumn("action", action)
    outcome = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "dispute", "disputed").when(F.col("action") == "reject", "rejected").when(F.col("action") == "correct", "superseded").otherwise(F.col("status"))
    corrected = decided.where("action = 'correct'").select((F.col("fact_id") + 10_000_000).alias("fact_id"), F.lit("accepted").alias("status"))
    return decided.select("fact_id", outcome.alias("status")).union(corrected)


@query("fact_versions", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version FROM events")
def fact_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each write of a fact numbered in order: the transaction-time log."""
    return table(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("version"))


@query(
    "incident_after_fix",
    """WITH f AS (SELECT user_id, max(ts) AS last_fix FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1) SELECT e.user_id, count(*) AS later, count(*) FILTER (WHERE value > 50) AS failures FROM events e JOIN f ON e.user_id = f.user_id AND e.ts > last_fix GROUP BY 1""",
)
def incident_after_fix(spark: SparkSession, sf: str) -> DataFrame:
    """What still happened after the last fix of each thing."""
    e = table(spark, sf, "events")
    kind = F.broadcast(e.agg(F.min("event_type").alias("fix")))
    fixes = e.join(kind, e["event_type"] == kind["fix"]).groupBy("user_id").agg(F.max("ts").alias("last_fix"))
    later = e.join(fixes, "user_id").where("ts > last_fix")
    return later.groupBy("user_id").agg(F.count("*").alias("later"), F.count_if(F.col("value") > 50).alias("failures"))


@query("temporal_questions", f"WITH {_PERIODS} SELECT event_id, make_timestamp((epoch_us(valid_from) + epoch_us(valid_to)) // 2) AS asked_at FROM p WHERE valid_to IS NOT NULL")
def temporal_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question per version, asked in the middle of its period."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    mid = F.timestamp_micros(F.shiftright(micros("valid_from") + micros("valid_to"), 1)).cast("timestamp_ntz")
    return periods_from_changes(spark, sf).where("valid_to is not null").select("event_id", mid.alias("asked_at"))
