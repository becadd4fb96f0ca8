"""Passages out of tables, texts and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import segments
from lorekeep.plans.registry import query, table


@query(
    "table_passages",
    """WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)
    SELECT o_custkey, r // 12 AS n, min(r) AS row_start, max(r) AS row_end, string_agg(concat('order ', o_orderkey), chr(10) ORDER BY r) AS content FROM l GROUP BY ALL""",
)
def table_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve-row windows of each customer's orders."""
    return segments.table_windows(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.concat(F.lit("order "), "o_orderkey"))


_GREEDY = """w AS (SELECT id, i, 0 AS n, length(p) AS open FROM l WHERE i = 1 UNION ALL SELECT l.id, l.i, CASE WHEN open + 1 + length(p) <= {limit} THEN n ELSE n + 1 END, CASE WHEN open + 1 + length(p) <= {limit} THEN open + 1 + length(p) ELSE length(p) END FROM w JOIN l ON l.id = w.id AND l.i = w.i + 1)
    SELECT id AS {key}, n, string_agg(p, chr(10) ORDER BY i) AS content FROM l JOIN w USING (id, i) GROUP BY id, n"""


@query(
    "text_passages",
    r"""WITH RECURSIVE k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
    s AS (SELECT doc_id, flatten(list_transform(lines, lambda x: CASE WHEN length(x) > 1600 THEN string_split(regexp_replace(x, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)) ELSE [x] END)) AS ps FROM k),
    l AS (SELECT doc_id AS id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM s), """
    + _GREEDY.format(limit=1000, key="doc_id"),
)
def text_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in passages of about a thousand characters."""
    return segments.text_passages(table(spark, sf, "documents"))


@query(
    "transcript_windows",
    "WITH RECURSIVE l AS (SELECT conv_id AS id, concat(role, ': ', text) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn, concat(role, ': ', text)) AS i FROM conversations), " + _GREEDY.format(limit=1600, key="conv_id"),
)
def transcript_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in windows of whole turns."""
    return segments.transcript_windows(table(spark, sf, "conversations"))


@query(
    "speech_segments",
    """WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS prev, lag(turn) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT *, CASE WHEN prev IS NULL OR prev <> role OR turn - before > 1 THEN 1 ELSE 0 END AS fresh FROM t)
    SELECT conv_id, CAST(segment AS BIGINT) AS segment, any_value(role) AS role, count(*) AS turns FROM (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM f) GROUP BY conv_id, segment""",
)
def speech_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A new segment at each change of speaker or gap: flags, then a running sum."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev, before = F.lag("role").over(w), F.lag("turn").over(w)
    t = table(spark, sf, "conversations").withColumn("fresh", F.when(prev.isNull() | (prev != F.col("role")) | (F.col("turn") - before > 1), 1).otherwise(0))
    t = t.withColumn("segment", F.sum("fresh").over(w))
    return t.groupBy("conv_id", "segment").agg(F.first("role").alias("role"), F.count("*").alias("turns"))


@query(
    "speech_overlap",
    """WITH p AS (SELECT conv_id, turn, turn * 4000 AS a, turn * 4000 + 3000 + conv_id % 3000 AS b FROM conversations), s AS (SELECT DISTINCT conv_id, k * 5000 AS a, k * 5000 + 5000 AS b FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS k))
    SELECT s.conv_id, s.a AS s_start, p.turn FROM s JOIN p ON s.conv_id = p.conv_id AND p.b > s.a AND p.a < greatest(s.b, s.a + 1)""",
)
def speech_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with the speech that falls into them."""
    c = table(spark, sf, "conversations")
    speech = c.select("conv_id", "turn", (F.col("turn") * 4000).alias("p_start"), (F.col("turn") * 4000 + 3000 + F.col("conv_id") % 3000).alias("p_end"))
    scenes = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(5000 * k).cast("long") for k in range(4)])).alias("s_start")).withColumn("s_end", F.col("s_start") + 5000)
    return segments.overlaps(scenes, speech, "conv_id", 10_000).select("conv_id", "s_start", "turn")


@query(
    "quoted_replies",
    """SELECT conv_id, turn, trim(regexp_replace(concat(text, chr(10), 'On Mon wrote:', chr(10), '> old'), '(?s)\\n?On [^\\n]* wrote:.*$', '')) AS fresh FROM conversations""",
)
def quoted_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The fresh part of a reply, without what it quotes."""
    body = F.concat("text", F.lit("\nOn Mon wrote:\n> old"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(body, r"(?s)\n?On [^\n]* wrote:.*$", "")).alias("fresh"))


@query(
    "version_families",
    r"""WITH f AS (SELECT doc_id, doc_id // 4 AS fam, doc_id % 4 AS rev FROM documents) SELECT a.doc_id, b.doc_id AS replaced_by FROM f a JOIN f b ON a.fam = b.fam AND b.rev > a.rev""",
)
def version_families(spark: SparkSession, sf: str) -> DataFrame:
    """File names taken apart into family and revision; a later revision replaces an earlier one."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("policies/Rate sheet x"), F.floor(F.col("doc_id") / 4), F.lit("y v"), F.col("doc_id") % 4, F.lit(" FINAL (2) March 2024.pdf"))
    f = d.select("doc_id", text.family_key(name).alias("family"), text.revision(name).alias("rev"))
    later = f.select(F.col("doc_id").alias("replaced_by"), "family", F.col("rev").alias("later"))
    return f.join(later, "family").where("later > rev").select("doc_id", "replaced_by")


@query(
    "delimited_records",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_custkey, n, CAST(o_orderkey AS VARCHAR) AS key, concat('status "', o_orderstatus, '", done') AS note, concat(o_orderpriority, chr(10), 'line 2') AS priority FROM o
    UNION ALL SELECT DISTINCT o_custkey, 0, 'key', 'note', 'priority' FROM o""",
)
def delimited_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as one text of comma-separated records, with quoted line ends, doubled quotes and blank lines, and its records again."""
    line = F.concat(F.lit("\r\n , \n"), "o_orderkey", F.lit(',"status ""'), "o_orderstatus", F.lit('"", done",  "'), "o_orderpriority", F.lit('\nline 2" '))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit('key,note,"priority"'), F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("\n\n"))
    found = rows.select("o_custkey", F.posexplode(text.delimited_records(body, ",")).alias("n", "r"))
    return found.select("o_custkey", F.col("n").cast("long").alias("n"), *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(("key", "note", "priority"))])
