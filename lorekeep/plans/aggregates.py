"""Aggregations: metrics, summaries, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import graph
from lorekeep.plans.joins import EDGES_SQL, _edges
from lorekeep.plans.registry import query, table

TODAY = "1999-06-30"


@query("metric_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def metric_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and money by month."""
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("money_by_year", "SELECT o_custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def money_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Money by year of each of the first customers."""
    return table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("metric_by_nation", "SELECT n_name, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def metric_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by nation and priority."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"))


@query("top_customers_trailing_year", f"SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate > DATE '{TODAY}' - INTERVAL 365 DAY AND o_orderdate <= DATE '{TODAY}' GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 6")
def top_customers_trailing_year(spark: SparkSession, sf: str) -> DataFrame:
    """The six customers with most revenue in the year before a given day."""
    o = table(spark, sf, "orders").where(f"o_orderdate > timestamp '{TODAY}' - interval 365 days and o_orderdate <= timestamp '{TODAY}'")
    return o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(6)


@query("event_grouping_lines", "SELECT l_orderkey, round(sum(CAST(printf('%.2f', l_extendedprice) AS DOUBLE)), 2) AS amount, count(*) AS lines, min(l_shipdate) AS first_day FROM lineitem GROUP BY l_orderkey")
def event_grouping_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines folded into events: written amounts parsed and summed."""
    from lorekeep.functions import text

    amount = text.money(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(amount), 2).alias("amount"), F.count("*").alias("lines"), F.min("l_shipdate").alias("first_day"))


@query(
    "relationship_summary",
    f"""WITH {EDGES_SQL}, m AS (SELECT rel, dst, count(*) AS n FROM edges GROUP BY ALL), u AS (SELECT rel, dst FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY n DESC, dst) AS rn FROM m) WHERE rn = 1)
    SELECT rel, count(*) AS links, count(DISTINCT src) AS sources, count(DISTINCT edges.dst) AS targets, count(*) FILTER (WHERE edges.dst LIKE '%1') AS ones, any_value(u.dst) AS usual FROM edges JOIN u USING (rel) GROUP BY rel""",
)
def relationship_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Relation types with counts and the most usual target, ties broken by name."""
    e = _edges(spark, sf)
    counts = e.groupBy("rel").agg(F.count("*").alias("links"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.count_if(F.col("dst").endswith("1")).alias("ones"))
    return counts.join(graph.most_usual(e, ["rel"], "dst", "usual"), "rel")


@query("several_targets", "WITH p AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS sources, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM p HAVING count(*) >= 5")
def several_targets(spark: SparkSession, sf: str) -> DataFrame:
    """How single-valued the link from parts to suppliers is."""
    e = table(spark, sf, "lineitem").select(F.lit("supplied_by").alias("rel"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.single_valued(e, share=-1.0).select("sources", F.round("share", 6).alias("share"))


@query("degree_top", f"WITH {EDGES_SQL} SELECT x, count(*) AS degree FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY x ORDER BY degree DESC, x LIMIT 25")
def degree_top(spark: SparkSession, sf: str) -> DataFrame:
    """The most connected things."""
    return graph.degree(_edges(spark, sf)).orderBy(F.desc("degree"), "x").limit(25)


@query("business_map", f"WITH {EDGES_SQL} SELECT rel, src_type, dst_type, count(*) AS links, count(DISTINCT src) AS sources FROM edges GROUP BY ALL")
def business_map(spark: SparkSession, sf: str) -> DataFrame:
    """Links by relation and the types of both ends."""
    return _edges(spark, sf).groupBy("rel", "src_type", "dst_type").agg(F.count("*").alias("links"), F.count_distinct("src").alias("sources"))


@query(
    "address_book",
    """WITH t AS (SELECT role, conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
    SELECT role AS address, count(*) AS sent, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> role) AS replies, min(turn) AS first_turn, max(turn) AS last_turn FROM t GROUP BY role""",
)
def address_book(spark: SparkSession, sf: str) -> DataFrame:
    """Per address: what it sent, what it answered, first and last."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("prev", F.lag("role").over(w))
    return t.groupBy(F.col("role").alias("address")).agg(F.count("*").alias("sent"), F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("role"))).alias("replies"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(
    "domain_stats",
    """WITH s AS (SELECT regexp_extract(lower(url), '^https?://(?:www\\.)?([^/?#:]+)', 1) AS domain FROM pages) SELECT domain, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share, count(*) >= 0.3 * (SELECT count(*) FROM s) AS internal FROM s GROUP BY domain""",
)
def domain_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Domains with their share; one with three tenths of all counts as the company's own."""
    s = table(spark, sf, "pages").select(F.regexp_extract(F.lower("url"), r"^https?://(?:www\.)?([^/?#:]+)", 1).alias("domain"))
    total = F.broadcast(s.agg(F.count("*").alias("total")))
    counted = s.groupBy("domain").agg(F.count("*").alias("n")).crossJoin(total)
    return counted.select("domain", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") >= 0.3 * F.col("total")).alias("internal"))


@query("single_or_mixed", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, count(DISTINCT lang) > 1 AS mixed, bool_and(n_chars > 0) AS all_filled, bool_or(n_chars > 10000) AS any_long FROM documents GROUP BY source")
def single_or_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """One value where all rows agree, else null and a flag."""
    n = F.count_distinct("lang")
    return table(spark, sf, "documents").groupBy("source").agg(F.when(n == 1, F.min("lang")).alias("lang"), (n > 1).alias("mixed"), F.bool_and(F.col("n_chars") > 0).alias("all_filled"), F.bool_or(F.col("n_chars") > 10000).alias("any_long"))


@query("ordered_collections", "SELECT c_nationkey, list_slice(list_sort(list(DISTINCT c_mktsegment)), 1, 3) AS segments, list_slice(list(c_custkey ORDER BY c_acctbal DESC, c_custkey), 1, 3) AS richest FROM customer GROUP BY c_nationkey")
def ordered_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Short ordered lists per group; only what can make the list is collected."""
    c = table(spark, sf, "customer")
    segments = c.groupBy("c_nationkey").agg(F.slice(F.sort_array(F.collect_set("c_mktsegment")), 1, 3).alias("segments"))
    top = graph.top_per_group(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)
    richest = top.groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "c_custkey"))), lambda x: x["c_custkey"]).alias("richest"))
    return segments.join(richest, "c_nationkey")


@query(
    "portal_rollup",
    """SELECT n_nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(o.n, 0) AS orders, greatest(coalesce(c.best, 0), coalesce(s.best, 0)) AS best FROM nation
    LEFT JOIN (SELECT c_nationkey k, count(*) n, max(c_acctbal) best FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey k, count(*) n, max(s_acctbal) best FROM supplier GROUP BY 1) s ON s.k = n_nationkey
    LEFT JOIN (SELECT c_nationkey k, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey""",
)
def portal_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts from several tables side by side, each aggregated before it is joined."""
    c, s, o, n = (table(spark, sf, t) for t in ("customer", "supplier", "orders", "nation"))
    cs = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.max("c_acctbal").alias("cb"))
    ss = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.max("s_acctbal").alias("sb"))
    os_ = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    j = n.select("n_nationkey").join(cs, "n_nationkey", "left").join(ss, "n_nationkey", "left").join(os_, "n_nationkey", "left")
    return j.select("n_nationkey", zero("customers"), zero("suppliers"), zero("orders"), F.greatest(F.coalesce("cb", F.lit(0.0)), F.coalesce("sb", F.lit(0.0))).alias("best"))


@query("queue_health", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, min(ts) FILTER (WHERE value > 50) AS first_high, max(ts) AS last FROM events GROUP BY event_type")
def queue_health(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered counts and ages by status."""
    high = F.col("value") > 50
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.min(F.when(high, F.col("ts"))).alias("first_high"), F.max("ts").alias("last"))


@query("customer_risk", "SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue, count(*) FILTER (WHERE o_orderstatus = 'F') AS issues FROM orders GROUP BY 1 ORDER BY revenue DESC, issues DESC, o_custkey LIMIT 20")
def customer_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by revenue at stake, then by open issues."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count_if(F.col("o_orderstatus") == "F").alias("issues")).orderBy(F.desc("revenue"), F.desc("issues"), "o_custkey").limit(20)


@query("ext_cube_metrics", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Extension, not parity: all grouping sets of a metric."""
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
