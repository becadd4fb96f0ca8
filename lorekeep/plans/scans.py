"""Sources, inventory and landing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.plans.registry import query, table
from lorekeep.sources import landing


@query(
    "inventory_source_summary",
    """SELECT source, count(*) AS files, sum(n_chars) AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) FILTER (WHERE n_chars > 2000) AS long_files,
       string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source""",
)
def inventory_source_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What each source holds."""
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.count_if(F.col("n_chars") > 2000).alias("long_files"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
    )


@query("inventory_duplicates", "SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE copies > 1")
def inventory_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose bytes occur again; counted by digest first, so that a large group of copies is no single task."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    again = d.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    return d.join(again, "sha").select("doc_id", "copies")


@query("extract_once_twins", "SELECT doc_id, first_id AS extracted_from FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) WHERE doc_id <> first_id")
def extract_once_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Files that take over the extraction of an equal file."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("extracted_from"))
    return d.join(first, "sha").where("doc_id <> extracted_from").select("doc_id", "extracted_from")


@query("json_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a JSON column, and whether keys are there."""
    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.variant_get(v, "$.k", "int").alias("k"), F.variant_get(v, "$.k", "string").isNotNull().alias("has_k"), F.variant_get(v, "$.zz", "string").isNotNull().alias("has_zz"))


@query(
    "html_to_text",
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM s""",
)
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Readable text of pages."""
    return table(spark, sf, "pages").select("page_id", text.strip_markup(F.col("html")).alias("content"))


@query(
    "url_identity",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '#.*$', '') AS u FROM pages),
    b AS (SELECT page_id, regexp_replace(u, '([?&])(utm_[a-z]+|fbclid|gclid|ref)=[^&]*', '\1', 'g') AS u FROM a)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '([?&])&+', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS identity FROM b""",
)
def url_identity(spark: SparkSession, sf: str) -> DataFrame:
    """One spelling per page address."""
    return table(spark, sf, "pages").select("page_id", text.url_identity(F.col("url")).alias("identity"))


@query(
    "content_dates",
    r"""SELECT doc_id, len(d) AS n_dates, list_min(d) AS first_date, list_max(d) AS last_date FROM (SELECT o_orderkey AS doc_id, regexp_extract_all(concat('ordered ', strftime(o_orderdate, '%Y-%m-%d'), ' due ', strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d'), ' no 12-34'), '\b((?:19|20)\d{2}-\d{2}-\d{2})\b', 1) AS d FROM orders)""",
)
def content_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that a text mentions, 5,000 at most."""
    line = F.concat(F.lit("ordered "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" due "), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"), F.lit(" no 12-34"))
    found = F.slice(F.regexp_extract_all(line, F.lit(r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b"), F.lit(1)), 1, 5000)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), found.alias("d")).select("doc_id", F.size("d").cast("long").alias("n_dates"), F.array_min("d").alias("first_date"), F.array_max("d").alias("last_date"))


@query(
    "format_detection",
    """SELECT kind, count(*) AS n FROM (SELECT 'html' AS kind FROM pages WHERE regexp_matches(lower(substr(ltrim(html), 1, 512)), '^<!doctype html|<html[\\s>]') UNION ALL SELECT 'text' FROM pages WHERE NOT regexp_matches(lower(substr(ltrim(html), 1, 512)), '^<!doctype html|<html[\\s>]')
       UNION ALL SELECT 'json' FROM events UNION ALL SELECT 'pdf' FROM region UNION ALL SELECT 'png' FROM nation UNION ALL SELECT 'empty' FROM region) GROUP BY kind""",
)
def format_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Formats by content, counted."""
    files = table(spark, sf, "pages").select(F.encode("html", "UTF-8").alias("body"), F.lit("page.bin").alias("name"))
    files = files.union(table(spark, sf, "events").select(F.encode("props", "UTF-8"), F.lit("props.json")))
    files = files.union(table(spark, sf, "region").select(F.encode(F.concat(F.lit("%PDF-1.7 "), "r_name"), "UTF-8"), F.lit("a.pdf")))
    files = files.union(table(spark, sf, "nation").select(F.unhex(F.lit("89504E470D0A1A0A")), F.lit("b.dat")))
    files = files.union(table(spark, sf, "region").select(F.unhex(F.lit("")), F.lit("c.dat")))
    return files.select(landing.detect_format(F.col("body"), F.col("name")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("delimiter_choice", "SELECT n_nationkey AS file, CASE n_nationkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '|' END AS delimiter FROM nation")
def delimiter_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The delimiter of each file from its first records."""
    n = table(spark, sf, "nation")
    sign = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("|")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    row = F.concat_ws("", F.lit("a"), sign, "n_name", sign, F.lit("c"), sign, F.lit("d"))
    odd = F.when(F.col("line_no") == 3, F.lit("note, one; two")).otherwise(row)
    lines = n.withColumn("line_no", F.explode(F.sequence(F.lit(0), F.lit(11)))).select(F.col("n_nationkey").alias("file"), "line_no", odd.alias("line"))
    return landing.choose_delimiter(lines, "file", "line", "line_no")


@query(
    "write_once",
    """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 1 THEN 'created' WHEN doc_id % 10 = 0 THEN 'conflict' ELSE 'exists' END AS outcome FROM documents) GROUP BY outcome""",
)
def write_once(spark: SparkSession, sf: str) -> DataFrame:
    """Objects land once: equal bytes are found again, other bytes under a used key are a conflict."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    arriving = d.withColumn("sha", F.when(F.col("doc_id") % 10 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")))
    return landing.put_if_absent(d.where("doc_id % 2 = 0"), arriving, "doc_id", "sha").groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "incremental_upsert",
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'inserted' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'kept' END AS action FROM documents) GROUP BY action""",
)
def incremental_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert that touches changed rows only, and the rows that a rebuild no longer produces."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("row_hash"))
    current = d.where("doc_id % 5 <> 0 or doc_id % 7 = 0")
    produced = d.where("doc_id % 7 <> 0").withColumn("row_hash", F.when(F.col("doc_id") % 3 == 0, F.md5(F.concat("row_hash", F.lit("!")))).otherwise(F.col("row_hash")))
    return landing.upsert_changed(current, produced, "doc_id", "row_hash").groupBy("action").agg(F.count("*").alias("n"))


@query("extraction_versions", "SELECT doc_id, version, count(*) OVER (PARTITION BY sha) AS versions FROM (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS version FROM documents)")
def extraction_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Version numbers of equal contents in order of arrival."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    w = Window.partitionBy("sha")
    return d.select("doc_id", F.row_number().over(w.orderBy("doc_id")).cast("long").alias("version"), F.count("*").over(w).alias("versions"))


@query("sensitive_columns_pruned", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sensitive_columns_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Columns whose headers name pay, bank or birth data never leave the file: decided on the plan."""
    c = table(spark, sf, "customer").withColumnRenamed("c_acctbal", "bank_balance").withColumnRenamed("c_nationkey", "tax_nation")
    import re

    return c.select(*[x for x in c.columns if not re.search(rules.SENSITIVE_COLUMN, x)])


@query("mail_profile", """SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS threads, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text)) AS chars FROM conversations GROUP BY role""")
def mail_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Senders of a mailbox with counts and spans."""
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("messages"), F.count_distinct("conv_id").alias("threads"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))
