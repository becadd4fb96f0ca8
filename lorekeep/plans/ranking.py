"""Windows, ranking and composition of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import graph
from lorekeep.plans.registry import query, table


@query("distinct_on_latest", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def distinct_on_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event per user and type: one pass of a maximum instead of a sort."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", F.negative("event_id"))).alias("event_id"))


@query("deterministic_sample", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 3")
def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Three files per source in the order of their ids' digests: the same at every run."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    return graph.top_per_group(d, ["source"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 3).select("source", "doc_id")


@query("smallest_per_bucket", "SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) <= CASE WHEN lang = 'en' THEN 2 ELSE 1 END")
def smallest_per_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest files of each bucket, two or one by kind."""
    d = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    ranked = graph.top_per_group(d, ["lang", "source"], [F.col("n_chars"), F.col("doc_id")], 2)
    return ranked.where("rn <= case when lang = 'en' then 2 else 1 end").select("lang", "source", "doc_id")


@query("total_beside_limit", "SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE n_chars > 1000 ORDER BY n_chars DESC, doc_id LIMIT 10")
def total_beside_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A page of rows with the number of all: counted apart, so that no window takes all rows."""
    d = table(spark, sf, "documents").where("n_chars > 1000").select("doc_id", "n_chars")
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(10).crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))


@query("periods_from_changes", "SELECT user_id, event_type, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events")
def periods_from_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change log as periods: the next change of the same thing ends the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query(
    "subject_chains",
    """WITH t AS (SELECT conv_id % 20 AS subject, conv_id, turn, lag(conv_id) OVER (PARTITION BY conv_id % 20, role ORDER BY conv_id, turn) AS prev FROM conversations) SELECT subject, conv_id, turn, prev IS NOT NULL AND conv_id - prev <= 60 AS linked FROM t""",
)
def subject_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours under one subject within sixty days that share a party."""
    w = Window.partitionBy(F.col("conv_id") % 20, "role").orderBy("conv_id", "turn")
    t = table(spark, sf, "conversations").withColumn("prev", F.lag("conv_id").over(w))
    return t.select((F.col("conv_id") % 20).alias("subject"), "conv_id", "turn", (F.col("prev").isNotNull() & (F.col("conv_id") - F.col("prev") <= 60)).alias("linked"))


@query("per_source_cap", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3 ORDER BY n_chars DESC, doc_id LIMIT 40")
def per_source_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked results with at most three from one source."""
    capped = graph.top_per_group(table(spark, sf, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return capped.orderBy(F.desc("n_chars"), "doc_id").limit(40).select("source", "doc_id")


@query(
    "typeahead_rank",
    """WITH q AS (SELECT 'bo' AS q), n AS (SELECT p_name AS name, count(*) AS facts, false AS alias FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(*), true FROM part GROUP BY 1),
    s AS (SELECT name, round(10 * CASE WHEN lower(name) = q THEN 4 WHEN starts_with(lower(name), q) THEN 3 WHEN regexp_matches(lower(name), concat('\\b', q)) THEN 2 ELSE 1 END + ln(1 + facts) - CASE WHEN alias THEN 0.5 ELSE 0 END, 6) AS score FROM n, q WHERE contains(lower(name), q))
    SELECT name, score FROM s ORDER BY score DESC, name LIMIT 10""",
)
def typeahead_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions: exact before prefix before word prefix before inside, then by what is known of them."""
    p, q = table(spark, sf, "part"), "bo"
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("facts")).withColumn("alias", F.lit(False))
    names = names.union(p.groupBy("p_brand").agg(F.count("*"), F.lit(True)))
    lower = F.lower("name")
    fit = F.when(lower == q, 4).when(lower.startswith(q), 3).when(lower.rlike(rf"\b{q}"), 2).otherwise(1)
    score = F.round(fit * 10 + F.log1p("facts") - F.when(F.col("alias"), 0.5).otherwise(0.0), 6)
    return names.where(F.contains(lower, F.lit(q))).select("name", score.alias("score")).orderBy(F.desc("score"), "name").limit(10)


_HITS = "hits AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'passage' WHEN 1 THEN 'fact' WHEN 2 THEN 'timeline' ELSE 'other' END AS lane, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """A ranked result list of bounded length, as retrieval hands it over."""
    d = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    lane = F.element_at(F.array(*[F.lit(x) for x in ("passage", "fact", "timeline", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", lane.alias("lane"), "source", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("pos"))


@query(
    "lane_quota",
    f"WITH {_HITS}, h AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY pos) AS k FROM hits WHERE pos <= 200) SELECT doc_id, row_number() OVER (ORDER BY k > CASE lane WHEN 'fact' THEN 3 WHEN 'passage' THEN 5 WHEN 'timeline' THEN 2 ELSE 0 END, pos) AS place FROM h",
)
def lane_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A page composed by kind: three facts, five passages, two histories, then the rest in order."""
    quota = F.when(F.col("lane") == "fact", 3).when(F.col("lane") == "passage", 5).when(F.col("lane") == "timeline", 2).otherwise(0)
    h = _hits(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("lane").orderBy("pos")))
    return h.select("doc_id", F.row_number().over(Window.orderBy(F.col("k") > quota, "pos")).alias("place"))


@query("round_robin", f"WITH {_HITS}, h AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY pos) AS i FROM hits WHERE pos <= 200) SELECT doc_id, row_number() OVER (ORDER BY i, lane) AS place FROM h")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Several result lists dealt out in turn."""
    h = _hits(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("lane").orderBy("pos")))
    return h.select("doc_id", F.row_number().over(Window.orderBy("i", "lane")).alias("place"))


@query("file_diversified", f"WITH {_HITS}, h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM hits WHERE pos <= 200) SELECT doc_id, row_number() OVER (ORDER BY rn > 1, pos) AS place FROM h")
def file_diversified(spark: SparkSession, sf: str) -> DataFrame:
    """The first hit of each file, then the others."""
    h = _hits(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("pos")))
    return h.select("doc_id", F.row_number().over(Window.orderBy(F.col("rn") > 1, "pos")).alias("place"))


@query(
    "document_reservation",
    f"""WITH {_HITS}, h AS (SELECT *, lane = 'passage' AS doc FROM hits WHERE pos <= 200), n AS (SELECT 3 - count(*) FILTER (WHERE doc) AS want FROM h WHERE pos <= 10),
    x AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM h WHERE doc AND pos > 10), n WHERE k <= want), d AS (SELECT doc_id FROM (SELECT *, row_number() OVER (ORDER BY pos DESC) AS k FROM h WHERE NOT doc AND pos <= 10) WHERE k <= (SELECT count(*) FROM x))
    SELECT doc_id FROM h WHERE pos <= 10 AND doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id FROM x""",
)
def document_reservation(spark: SparkSession, sf: str) -> DataFrame:
    """Three of ten places are kept for documents: the lowest cards give way to the best documents below."""
    h = _hits(spark, sf).withColumn("doc", F.col("lane") == "passage")
    want = h.where("pos <= 10").agg((3 - F.count_if("doc")).alias("want"))
    rise = h.where("doc and pos > 10").withColumn("k", F.row_number().over(Window.orderBy("pos"))).crossJoin(F.broadcast(want)).where("k <= want")
    fall = h.where("not doc and pos <= 10").withColumn("k", F.row_number().over(Window.orderBy(F.desc("pos")))).crossJoin(F.broadcast(rise.agg(F.count("*").alias("n")))).where("k <= n")
    return h.where("pos <= 10").join(fall.select("doc_id"), "doc_id", "left_anti").select("doc_id").union(rise.select("doc_id"))


@query("status_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 30")
def status_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the order of their states."""
    state = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    top = table(spark, sf, "orders").withColumn("s", state).orderBy("s", F.desc("o_totalprice"), "o_orderkey").limit(30)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("s", F.desc("o_totalprice"), "o_orderkey")).alias("place"))
