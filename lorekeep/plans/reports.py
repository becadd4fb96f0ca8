"""Reports, cards, readers and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import dates
from lorekeep.operators import aliases, graph
from lorekeep.plans.registry import query, table
from lorekeep.sources import readers


@query(
    "customer_dossier",
    """SELECT c_custkey, c_mktsegment, n_name, coalesce(o.n, 0) AS orders, o.revenue, o.last_order, o.open_orders FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS revenue, max(o_orderdate) AS last_order, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def customer_dossier(spark: SparkSession, sf: str) -> DataFrame:
    """Profile, money and recent work of each customer."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.max("o_orderdate").alias("last_order"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(o, c["c_custkey"] == o["o_custkey"], "left")
    return j.select("c_custkey", "c_mktsegment", "n_name", F.coalesce("n", F.lit(0)).alias("orders"), "revenue", "last_order", "open_orders")


@query(
    "key_person_audit",
    """WITH d AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS depends FROM lineitem GROUP BY 1), s AS (SELECT s_suppkey, s_acctbal < 0 AS leaving FROM supplier) SELECT s_suppkey, leaving, depends FROM s JOIN d ON l_suppkey = s_suppkey ORDER BY leaving DESC, depends DESC, s_suppkey LIMIT 20""",
)
def key_person_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Who most depends on, the leaving ones first."""
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("depends"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") < 0).alias("leaving"))
    return s.join(d, s["s_suppkey"] == d["l_suppkey"]).select("s_suppkey", "leaving", "depends").orderBy(F.desc("leaving"), F.desc("depends"), "s_suppkey").limit(20)


@query("pricing_leakage", "SELECT l_returnflag, count(*) AS lines, round(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))), 2)::DOUBLE AS given FROM lineitem WHERE l_discount >= 0.08 AND l_returnflag <> 'R' GROUP BY 1")
def pricing_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Money given away by deep discounts, returns left out."""
    li = table(spark, sf, "lineitem").where("l_discount >= 0.08 and l_returnflag <> 'R'")
    given = F.round(F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)")), 2).cast("double")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("lines"), given.alias("given"))


@query("obsolete_knowledge", "SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1999-06-30' - INTERVAL 18 MONTH THEN 'old' WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'current' END AS state FROM orders")
def obsolete_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """What is out of date: old, draft or current."""
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderdate") < F.expr("timestamp_ntz'1999-06-30' - interval 18 months"), "old").when(F.col("o_orderstatus") == "P", "draft").otherwise("current")
    return o.select("o_orderkey", state.alias("state"))


@query("interview_questions", "SELECT c_custkey, concat('Who else knows about ', c_name, '?') AS question FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, concat('Which of ', n, ' arrangements with ', c_name, ' still hold?') FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15) ON o_custkey = c_custkey")
def interview_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions for a hand-over, from what is single-sourced and what has many arrangements."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    alone = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", F.format_string("Who else knows about %s?", "c_name").alias("question"))
    many = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")
    return alone.union(c.join(many, c["c_custkey"] == many["o_custkey"]).select("c_custkey", F.format_string("Which of %d arrangements with %s still hold?", "n", "c_name")))


@query(
    "entity_cards",
    """SELECT c_custkey, concat(c_name, chr(10), 'Customer', chr(10), 'segment: ', c_mktsegment, chr(10), 'links: ', coalesce(list_aggregate(list_slice(l, 1, 14), 'string_agg', ', '), '')) AS content FROM customer LEFT JOIN (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def entity_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A card per customer: name, type, properties and up to fourteen links."""
    o = graph.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], 14)
    links = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ", ").alias("links"))
    c = table(spark, sf, "customer")
    j = c.join(links, c["c_custkey"] == links["o_custkey"], "left")
    return j.select("c_custkey", F.concat("c_name", F.lit("\nCustomer\nsegment: "), "c_mktsegment", F.lit("\nlinks: "), F.coalesce("links", F.lit(""))).alias("content"))


@query("fact_cards", "SELECT event_id, concat('user ', user_id, ' - ', event_type, ': ', CAST(floor(value) AS BIGINT), chr(10), 'since ', strftime(ts, '%b %-d, %Y'), CASE WHEN next IS NULL THEN '' ELSE concat(chr(10), 'until ', strftime(next, '%b %-d, %Y')) END) AS content, next IS NULL AS is_current FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next FROM events)")
def fact_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A card per fact with its period and whether it still holds."""
    following = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("next", following)
    end = F.when(F.col("next").isNull(), "").otherwise(F.concat(F.lit("\nuntil "), dates.human_date(F.col("next"))))
    return e.select("event_id", F.concat(F.lit("user "), "user_id", F.lit(" - "), "event_type", F.lit(": "), F.floor("value"), F.lit("\nsince "), dates.human_date(F.col("ts")), end).alias("content"), F.col("next").isNull().alias("is_current"))


@query("mailbox_split", "SELECT conv_id, count(*) AS messages, min(concat(role, '@x.org')) AS first_sender FROM conversations GROUP BY conv_id")
def mailbox_split(spark: SparkSession, sf: str) -> DataFrame:
    """Mailboxes cut into messages, with their senders."""
    c = table(spark, sf, "conversations")
    mail = F.concat(F.lit("From x Mon\nFrom: "), "role", F.lit("@x.org\nSubject: s\n\nbody\n>From here\n"))
    boxes = c.groupBy("conv_id").agg(F.array_join(F.collect_list(mail), "").alias("box"))
    parts = boxes.select("conv_id", F.explode(readers.split_mailbox(F.col("box"))).alias("m"))
    return parts.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min(readers.mail_header(F.col("m"), "From")).alias("first_sender"))


@query("header_inference", "SELECT n_nationkey AS file, n_nationkey % 3 AS header_at FROM nation")
def header_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Where the header of each table lies under its title rows."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r"))
    cells = F.when(F.col("r") < F.col("file") % 3, F.array(F.lit("Report"), F.lit(""), F.lit(""), F.lit(""))).otherwise(F.array(*[F.lit(x) for x in ("a", "b", "c", "d")]))
    return readers.header_row(n.select("file", "r", cells.alias("cells")), "file", "r", "cells")


@query("summary_rows", "SELECT o_orderkey, o_orderkey % 7 = 0 AS summary FROM orders")
def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables that are totals."""
    first = F.when(F.col("o_orderkey") % 7 == 0, "Grand Total").otherwise("row")
    return table(spark, sf, "orders").select("o_orderkey", F.array(first, F.lit("x")).alias("cells")).select("o_orderkey", readers.summary_rows("cells").alias("summary"))


@query("date_column_inference", "SELECT 'day' AS \"column\", 1.0 AS share")
def date_column_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns that hold dates."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "M/d/yyyy").alias("day"), "o_orderpriority", F.col("o_orderkey").cast("string").alias("number"))
    return readers.date_columns(o, ["day", "o_orderpriority", "number"], dates.loose_date)


@query("alias_stated", "SELECT n_nationkey AS entity, concat('Land', n_nationkey) AS alias, 2 AS passages FROM nation")
def alias_stated(spark: SparkSession, sf: str) -> DataFrame:
    """Names that prose puts beside known ones."""
    n = table(spark, sf, "nation")
    known = n.select(F.col("n_nationkey").alias("entity"), F.concat(F.lit("Nation "), "n_nationkey").alias("name"))
    one = n.select((F.col("n_nationkey") * 2).alias("passage"), F.concat(F.lit("we met Nation "), "n_nationkey", F.lit(" (Land"), "n_nationkey", F.lit(") today")).alias("text"))
    two = n.select((F.col("n_nationkey") * 2 + 1).alias("passage"), F.concat(F.lit("so Nation "), "n_nationkey", F.lit(", also called Land"), "n_nationkey", F.lit(" agreed")).alias("text"))
    return aliases.stated_aliases(one.union(two), known)


@query("alias_short_forms", "WITH k AS (SELECT DISTINCT p_name AS name FROM part), f AS (SELECT split_part(name, ' ', 1) AS alias, name FROM k) SELECT alias, min(name) AS entity FROM f GROUP BY alias HAVING count(DISTINCT name) = 1")
def alias_short_forms(spark: SparkSession, sf: str) -> DataFrame:
    """First words that belong to one name only."""
    known = table(spark, sf, "part").select(F.col("p_name").alias("entity"), F.col("p_name").alias("name")).distinct()
    return aliases.short_forms(known)


@query(
    "alias_initialisms",
    r"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), i AS (SELECT name, array_to_string(list_transform(list_filter(regexp_split_to_array(name, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1])), '') AS alias FROM n),
    o AS (SELECT alias, min(name) AS entity FROM i WHERE length(alias) BETWEEN 2 AND 6 GROUP BY alias HAVING count(*) = 1),
    s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{2,6})\b', 1)) AS alias FROM documents)
    SELECT entity, alias, count(*) AS passages FROM s JOIN o USING (alias) GROUP BY entity, alias HAVING count(*) >= CASE WHEN length(alias) = 2 THEN 3 ELSE 2 END""",
)
def alias_initialisms(spark: SparkSession, sf: str) -> DataFrame:
    """Capital runs in texts that are one name's initials."""
    known = table(spark, sf, "part").select(F.col("p_name").alias("entity"), F.col("p_name").alias("name")).distinct()
    return aliases.initialisms(table(spark, sf, "documents").select(F.col("doc_id").alias("passage"), "text"), known)
