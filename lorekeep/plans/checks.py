"""Guards, data checks and matching of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import checks
from lorekeep.operators.closure import connected_components
from lorekeep.plans.registry import query, table


@query("guarded_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey < 10 AND c_name <> ';' GROUP BY 1")
def guarded_sql(spark: SparkSession, sf: str) -> DataFrame:
    """A written query over secured tables."""
    return checks.guarded_sql(spark, "SELECT c_mktsegment, count(*) AS n FROM secured_customer WHERE c_name <> ';' GROUP BY 1;", {"secured_customer": table(spark, sf, "customer").where("c_nationkey < 10")})


@query("optional_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1')")
def optional_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters that are set become predicates, the others nothing."""
    return checks.optional_filter(table(spark, sf, "documents"), {"lang": "en", "doc_id": None}, {"source": "SRC1", "text": None}).select("doc_id")


@query("like_escaped", "SELECT doc_id FROM documents WHERE text LIKE '%\\%%' ESCAPE '\\'")
def like_escaped(spark: SparkSession, sf: str) -> DataFrame:
    """A search for a sign that patterns use, taken literally."""
    return table(spark, sf, "documents").where(F.contains("text", F.lit("%"))).select("doc_id")


@query("data_checks", "SELECT * FROM (VALUES ('regions', 'entity_count', true), ('first region', 'fact_value', true), ('no such nation', 'relation_exists', false), ('nation in region', 'relation_exists', true)) AS t(name, kind, passed)")
def data_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Typed assertions about the record."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    first = {"table": "region", "key": "r_regionkey", "id": 0, "column": "r_regionkey", "value": 0}
    link = {"table": "nation", "src": "n_nationkey", "dst": "in_region"}
    return checks.run_assertions(
        [checks.Assertion("regions", "entity_count", {"table": "region", "count": 5}), checks.Assertion("first region", "fact_value", first), checks.Assertion("no such nation", "relation_exists", link | {"from": 99, "to": 0}), checks.Assertion("nation in region", "relation_exists", link | {"from": 3, "to": 3})],
        {"region": r, "nation": n.withColumn("in_region", F.col("n_nationkey") % 5 + 0).unionByName(n.withColumn("in_region", F.col("n_regionkey")))},
    )


@query(
    "manager_resolution",
    """WITH p AS (SELECT c_custkey AS id, concat(chr(65 + CAST(c_custkey % 26 AS INT)), 'nn Surname', c_custkey // 2) AS name FROM customer), a AS (SELECT id, CASE WHEN id % 3 = 0 THEN name ELSE concat(substr(name, 1, 1), '. Surname', (id // 2)) END AS asked FROM p),
    u AS (SELECT concat(substr(name, 1, 1), '|', split_part(name, ' ', 2)) AS k, min(id) AS id FROM p GROUP BY 1 HAVING count(*) = 1)
    SELECT a.id, coalesce(e.id, u.id) AS manager FROM a LEFT JOIN p e ON e.name = asked LEFT JOIN u ON u.k = concat(substr(asked, 1, 1), '|', split_part(asked, ' ', 2))""",
)
def manager_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Managers named in full, or by surname and first initial where only one person fits."""
    c = table(spark, sf, "customer")
    half = F.floor(F.col("c_custkey") / 2)
    p = c.select(F.col("c_custkey").alias("id"), F.concat(F.char((65 + F.col("c_custkey") % 26).cast("int")), F.lit("nn Surname"), half).alias("name"))
    asked = p.select("id", F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.concat(F.substring("name", 1, 1), F.lit(". Surname"), F.floor(F.col("id") / 2))).alias("asked"))
    key = lambda x: F.concat(F.substring(x, 1, 1), F.lit("|"), F.split_part(x, F.lit(" "), F.lit(2)))
    exact = p.select(F.col("id").alias("exact"), F.col("name").alias("asked"))
    initial = p.groupBy(key(F.col("name")).alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("initial")).where("n = 1")
    j = asked.join(exact, "asked", "left").withColumn("k", key(F.col("asked"))).join(initial, "k", "left")
    return j.select("id", F.coalesce("exact", "initial").alias("manager"))


@query("departure_mentions", r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(concat('Ann Lee ', CASE turn % 3 WHEN 0 THEN 'has left' WHEN 1 THEN 'is here' ELSE 'retired last week' END), '\b(left|leaving|retired|resigned)\b')")
def departure_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Words of leaving within twelve words of a full name: positions of both meet by distance."""
    said = F.when(F.col("turn") % 3 == 0, "has left").when(F.col("turn") % 3 == 1, "is here").otherwise("retired last week")
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.words(F.concat(F.lit("Ann Lee "), said))).alias("at", "w"))
    names = w.where("w = 'lee'").select("conv_id", "turn", F.col("at").alias("name_at"))
    gone = w.where(F.col("w").isin("left", "leaving", "retired", "resigned"))
    return gone.join(names, ["conv_id", "turn"]).where("abs(at - name_at) <= 12").select("conv_id", "turn").distinct()


@query("topic_groups", "SELECT predicate, min(predicate) OVER () AS topic FROM (SELECT DISTINCT concat(p_name, ' agreed rate') AS predicate FROM part)")
def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates whose words overlap by three fifths form a topic; candidates share a word of their own."""
    k = table(spark, sf, "part").select(F.concat("p_name", F.lit(" agreed rate")).alias("predicate")).distinct().withColumn("w", text.words(F.col("predicate")))
    one = k.select("predicate", "w", F.explode(F.array_except("w", F.array(F.lit("agreed"), F.lit("rate")))).alias("t"))
    other = one.select(F.col("predicate").alias("p2"), F.col("w").alias("w2"), "t")
    pairs = one.join(other, "t").where("predicate < p2").where(text.jaccard(F.col("w"), F.col("w2")) >= 0.6).select("predicate", "p2").distinct()
    return connected_components(pairs, "predicate", "p2").select(F.col("vertex").alias("predicate"), F.col("component").alias("topic"))
