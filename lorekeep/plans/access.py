"""Access plans over a derived world: nations and regions are groups, customers people, sources scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.operators import access, graph
from lorekeep.operators.closure import connected_components, levels
from lorekeep.plans.registry import query, table


def _member_edges(spark: SparkSession, sf: str) -> DataFrame:
    """child belongs to parent: customers to nations, nations to regions, and one region back to a nation (a cycle)."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    return c.union(n).union(spark.createDataFrame([("r0", "n3")], "child string, parent string"))


_WORLD = """members AS (SELECT concat('c', c_custkey) AS child, concat('n', c_nationkey) AS parent FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT 'r0', 'n3'),
  reach AS (SELECT concat('c', c_custkey) AS root, concat('c', c_custkey) AS node FROM customer WHERE c_custkey <= {n} UNION SELECT root, parent FROM reach JOIN members ON node = child)"""


def _principals(spark: SparkSession, sf: str, n: int) -> DataFrame:
    start = table(spark, sf, "customer").where(F.col("c_custkey") <= n).select(F.concat(F.lit("c"), "c_custkey").alias("root"))
    return access.reachable(start, _member_edges(spark, sf))


@query("group_closure", f"WITH RECURSIVE {_WORLD.format(n=100)} SELECT root, node FROM reach")
def group_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's principals through nested groups; the cycle does no harm."""
    return _principals(spark, sf, 100)


@query("group_expansion", "WITH RECURSIVE members AS (SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM nation UNION ALL SELECT 'r0', 'n3'), down AS (SELECT concat('r', r_regionkey) AS root, concat('r', r_regionkey) AS node FROM region UNION SELECT root, child FROM down JOIN members ON node = parent) SELECT root, node FROM down")
def group_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Groups opened downwards: the closure with its edges turned round."""
    e = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("c"), F.concat(F.lit("r"), "n_regionkey").alias("p")).union(spark.createDataFrame([("r0", "n3")], "c string, p string"))
    start = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return access.reachable(start, e.select(F.col("p").alias("child"), F.col("c").alias("parent")))


@query("subtree", "WITH RECURSIVE t AS (SELECT doc_id, CASE WHEN doc_id = 0 THEN NULL ELSE doc_id // 3 END AS parent FROM documents), s AS (SELECT doc_id, 0 AS depth FROM t WHERE doc_id = 2 UNION ALL SELECT t.doc_id, depth + 1 FROM t JOIN s ON t.parent = s.doc_id WHERE t.doc_id <> t.parent) SELECT doc_id, depth FROM s")
def subtree(spark: SparkSession, sf: str) -> DataFrame:
    """A container's files at any depth, level by level."""
    tree = table(spark, sf, "documents").selectExpr("doc_id", "case when doc_id = 0 then null else doc_id div 3 end as parent").where("doc_id <> parent")
    return levels(table(spark, sf, "documents").where("doc_id = 2").select(F.col("doc_id").alias("node")), tree.select("parent", F.col("doc_id").alias("child"))).select(F.col("node").alias("doc_id"), "depth")


@query("components", "WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS component FROM d QUALIFY count(*) OVER (PARTITION BY sha) > 1")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of links between equal texts, each linked to the first of them."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return connected_components(d.join(first, "sha"), "doc_id", "first").select(F.col("vertex").alias("doc_id"), "component")


_ACL = "entries AS (SELECT source AS acl_id, concat('n', doc_id % 25) AS principal FROM documents WHERE doc_id % 11 = 0 UNION SELECT source, concat('c', doc_id % 60) FROM documents WHERE doc_id % 13 = 0)"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    groups = d.where("doc_id % 11 = 0").select(F.col("source").alias("acl_id"), F.concat(F.lit("n"), F.col("doc_id") % 25).alias("principal"))
    people = d.where("doc_id % 13 = 0").select("source", F.concat(F.lit("c"), F.col("doc_id") % 60))
    return groups.union(people).distinct()


@query("readable_lists", f"WITH RECURSIVE {_WORLD.format(n=40)}, {_ACL} SELECT DISTINCT root, acl_id FROM reach JOIN entries ON node = principal")
def readable_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The access lists that each reader can read."""
    return access.readable_lists(_entries(spark, sf), _principals(spark, sf, 40))


@query("secured_documents", f"WITH RECURSIVE {_WORLD.format(n=7)}, {_ACL} SELECT doc_id FROM documents WHERE doc_id % 17 = 0 OR source IN (SELECT acl_id FROM reach JOIN entries ON node = principal WHERE root = 'c7')")
def secured_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What one reader sees: files without a list, and files whose list admits the reader."""
    mine = access.readable_lists(_entries(spark, sf), _principals(spark, sf, 7).where("root = 'c7'"))
    d = table(spark, sf, "documents").withColumn("acl", F.when(F.col("doc_id") % 17 != 0, F.col("source")))
    return access.secured(d, "acl", mine).select("doc_id")


@query(
    "readers_cover",
    f"""WITH RECURSIVE {_ACL}, members AS (SELECT concat('c', c_custkey) AS child, concat('n', c_nationkey) AS parent FROM customer), pr AS (SELECT DISTINCT principal AS root, principal AS node FROM entries UNION SELECT root, parent FROM pr JOIN members ON node = child),
    met AS (SELECT DISTINCT w.acl_id AS wide, n.acl_id AS narrow, n.principal AS who FROM entries n JOIN pr ON n.principal = root JOIN entries w ON w.principal = node)
    SELECT wide, narrow FROM met GROUP BY wide, narrow HAVING count(*) = (SELECT count(*) FROM entries e WHERE e.acl_id = narrow) AND wide <> narrow""",
)
def readers_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Lists whose readers are all readers of another list."""
    e = _entries(spark, sf)
    members = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    principals = access.reachable(e.select(F.col("principal").alias("root")).distinct(), members)
    return access.covers(e, e, principals)


@query(
    "card_variants",
    """WITH c AS (SELECT source AS card, lang AS content, count(*) AS readers FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY readers DESC, content) AS rn FROM c)
    SELECT CASE WHEN rn = 1 THEN card ELSE concat(card, '~', substr(md5(content), 1, 8)) END AS variant, content, readers FROM r""",
)
def card_variants(spark: SparkSession, sf: str) -> DataFrame:
    """One variant of a card per content; the one most readers see keeps the card's id."""
    c = table(spark, sf, "documents").groupBy(F.col("source").alias("card"), F.col("lang").alias("content")).agg(F.count("*").alias("readers"))
    ranked = c.withColumn("rn", F.row_number().over(Window.partitionBy("card").orderBy(F.desc("readers"), "content")))
    name = F.when(F.col("rn") == 1, F.col("card")).otherwise(F.concat("card", F.lit("~"), F.substring(F.md5("content"), 1, 8)))
    return ranked.select(name.alias("variant"), "content", "readers")


@query(
    "file_catalog",
    f"""WITH RECURSIVE {_WORLD.format(n=7)}, {_ACL}, mine AS (SELECT DISTINCT acl_id FROM reach JOIN entries ON node = principal WHERE root = 'c7')
    SELECT doc_id, CASE WHEN source IN (SELECT acl_id FROM mine) THEN 'openable' ELSE 'locked' END AS state, doc_id % 19 = 0 AS requested FROM documents WHERE source IN (SELECT acl_id FROM mine) OR source NOT IN ('src1', 'src2')""",
)
def file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Files as a reader may list them: openable, locked, and hidden ones left out."""
    mine = access.readable_lists(_entries(spark, sf), _principals(spark, sf, 7).where("root = 'c7'")).select(F.col("acl_id").alias("source"), F.lit(True).alias("mine"))
    d = table(spark, sf, "documents").join(mine, "source", "left").where("mine or source not in ('src1', 'src2')")
    return d.select("doc_id", F.when(F.col("mine"), "openable").otherwise("locked").alias("state"), (F.col("doc_id") % 19 == 0).alias("requested"))


@query("access_oracle_diff", "SELECT doc_id, 'too open' AS problem FROM documents WHERE false")
def access_oracle_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two derivations of what a reader sees, compared; nothing may differ."""
    one = secured_documents(spark, sf)
    mine = _entries(spark, sf)
    d = table(spark, sf, "documents").withColumn("acl", F.when(F.col("doc_id") % 17 != 0, F.col("source")))
    up = _principals(spark, sf, 7).where("root = 'c7'").select("node")
    allowed = mine.join(up, mine["principal"] == up["node"], "left_semi").select("acl_id").distinct()
    other = d.join(allowed, d["acl"] == allowed["acl_id"], "left").where("acl is null or acl_id is not null").select("doc_id")
    return one.exceptAll(other).withColumn("problem", F.lit("too open")).union(other.exceptAll(one).withColumn("problem", F.lit("too closed")))


@query("twin_access", "WITH t AS (SELECT sha256(text) AS sha, list_sort(list(DISTINCT source)) AS acls FROM documents GROUP BY 1) SELECT doc_id, acls FROM documents JOIN t ON sha = sha256(text) WHERE len(acls) > 1")
def twin_access(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a file are readable through the lists of all copies."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    lists = d.groupBy("sha").agg(F.sort_array(F.collect_set("source")).alias("acls")).where(F.size("acls") > 1)
    return d.join(lists, "sha").select("doc_id", "acls")


@query(
    "apply_access",
    """SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN concat('file:', doc_id) WHEN source IN ('src3', 'src4') THEN concat('held:', source) ELSE concat('scope:', source) END AS acl,
       CASE WHEN doc_id % 23 = 0 THEN 2 WHEN source IN ('src3', 'src4') THEN 1 ELSE 3 END AS readers FROM documents""",
)
def apply_access(spark: SparkSession, sf: str) -> DataFrame:
    """A file's list: its own grants, else the scope's grants while it is held, else audience and grants."""
    d = table(spark, sf, "documents")
    own, held = F.col("doc_id") % 23 == 0, F.col("source").isin("src3", "src4")
    acl = F.when(own, F.concat(F.lit("file:"), "doc_id")).when(held, F.concat(F.lit("held:"), "source")).otherwise(F.concat(F.lit("scope:"), "source"))
    return d.select("doc_id", acl.alias("acl"), F.when(own, 2).when(held, 1).otherwise(3).alias("readers"))


@query("access_overview", "SELECT source AS scope, count(*) AS files, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS flagged, string_agg(DISTINCT lang, ',' ORDER BY lang) AS audience FROM documents GROUP BY source")
def access_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes with their files, flags and audience."""
    flag = F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    return table(spark, sf, "documents").groupBy(F.col("source").alias("scope")).agg(F.count("*").alias("files"), F.count_if(flag).alias("flagged"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("audience"))


@query("knowledge_view", "WITH hidden AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 4) SELECT e.event_id, e.ts <= TIMESTAMP '2024-01-15' AS current_then FROM events e WHERE e.ts <= TIMESTAMP '2024-01-20' AND e.event_id NOT IN (SELECT doc_id FROM hidden)")
def knowledge_view(spark: SparkSession, sf: str) -> DataFrame:
    """What was known by a cutoff: later rows and rows from hidden files are left out."""
    hidden = table(spark, sf, "documents").where("doc_id % 9 = 4").select(F.col("doc_id").alias("event_id"))
    e = table(spark, sf, "events").where("ts <= timestamp '2024-01-20'")
    return e.join(hidden, "event_id", "left_anti").select("event_id", (F.col("ts") <= F.expr("timestamp '2024-01-15'")).alias("current_then"))


_TOP = """SELECT c_custkey, n_name, year, revenue, rn FROM (SELECT c_custkey, n_name, year, revenue, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, c_custkey) AS rn FROM (
  SELECT c_custkey, any_value(n_name) AS n_name, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate <= TIMESTAMP '1999-06-30' AND concat('r', n_regionkey) IN (SELECT node FROM reach WHERE root = 'c7') GROUP BY c_custkey, year(o_orderdate))) WHERE rn <= 6"""


@query("top_customers_secured", f"WITH RECURSIVE {_WORLD.format(n=7)} {_TOP}")
def top_customers_secured(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue per customer and year as of a day, for the regions that one reader may see, the six best of each year."""
    mine = _principals(spark, sf, 7).where("root = 'c7'").select("node")
    n = table(spark, sf, "nation").withColumn("acl", F.concat(F.lit("r"), "n_regionkey"))
    n = n.join(mine, n["acl"] == mine["node"], "left_semi")
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderdate <= timestamp '1999-06-30'")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    revenue = j.groupBy("c_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.first("n_name").alias("n_name"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return graph.top_per_group(revenue, ["year"], [F.desc("revenue"), F.col("c_custkey")], 6).select("c_custkey", "n_name", "year", "revenue", "rn")


@query("audience_resolution", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('c', c_custkey) WHEN c_custkey % 3 = 1 THEN concat('n', c_nationkey) END AS principal FROM customer")
def audience_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """References to people and groups, resolved by the first kind that fits."""
    c = table(spark, sf, "customer")
    ref = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("group "), "c_nationkey"))
    asked = c.select("c_custkey", ref.alias("ref"))
    people = c.select(F.lower("c_name").alias("ref"), F.concat(F.lit("c"), "c_custkey").alias("principal"), F.lit(1).alias("priority"))
    groups = table(spark, sf, "nation").select(F.concat(F.lit("group "), "n_nationkey").alias("ref"), F.concat(F.lit("n"), "n_nationkey").alias("principal"), F.lit(2).alias("priority"))
    found = asked.join(people.union(groups), "ref", "left")
    return found.groupBy("c_custkey").agg(F.min_by("principal", F.coalesce("priority", F.lit(9))).alias("principal"))


_HEADER = "list_transform(string_split(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))[1], '|'), lambda h: trim(h))"


@query(
    "personal_data_escalation",
    rf"""WITH d AS (SELECT doc_id, text, {_HEADER} AS header FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, 'ssn' AS kind, concat(substr(x, 1, 3), '-**-****') AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')) AS x FROM d) WHERE NOT regexp_matches(x, '^(000|666|9)|-00-|-0000$')
      UNION ALL SELECT doc_id, 'bank_account', concat(regexp_replace(x, '\d+$', ''), repeat('*', length(regexp_extract(x, '\d+$')) - 4), right(x, 4)) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{rules.BANK_NUMBER}')) AS x FROM d)
      UNION ALL SELECT doc_id, 'birth_date', regexp_replace(x, '\d', '#', 'g') FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{rules.BIRTH_DATE}')) AS x FROM d)
      UNION ALL SELECT doc_id, 'personal_pay', concat('column "', list_filter(header, lambda c: regexp_matches(c, '{rules.PAY_COLUMN}'))[1], '" next to people') FROM d WHERE len(list_filter(header, lambda c: regexp_matches(c, '{rules.PAY_COLUMN}'))) > 0 AND len(list_filter(header, lambda c: regexp_matches(c, '{rules.PERSON_COLUMN}'))) > 0)
    SELECT doc_id, list_sort(list_distinct(list(kind))) AS kinds, list_sort(list_distinct(list(masked))) AS masked FROM h GROUP BY doc_id""",
)
def personal_data_escalation(spark: SparkSession, sf: str) -> DataFrame:
    """Files with personal data: the kinds found and all findings, masked."""
    return access.personal_data(table(spark, sf, "documents"))
