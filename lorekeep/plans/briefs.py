"""Reports over facts, and rates of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.operators import briefs
from lorekeep.plans.registry import query, table

_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'practice' WHEN 2 THEN 'exception' ELSE 'note' END"
_VALUE = "CASE WHEN l_orderkey % 6 = 0 THEN 'sign before you start' WHEN l_orderkey % 6 = 1 THEN 'No entry without a pass' ELSE 'as usual' END"


@query(
    "procedure_sections",
    f"""WITH f AS (SELECT l_suppkey * 10 + l_partkey % 10 AS topic, l_orderkey * 10 + l_linenumber AS fact_id, {_KIND} AS kind, {_VALUE} AS value, l_orderkey % 3 > 0 AS cur, l_orderkey % 8 = 1 AS old FROM lineitem),
    s AS (SELECT topic, fact_id, 'rules' AS section, 12 AS most FROM f WHERE cur AND (kind = 'policy' OR regexp_matches(value, '{rules.RULE_WORDS}')) UNION ALL SELECT topic, fact_id, 'practice', 10 FROM f WHERE cur AND kind = 'practice'
      UNION ALL SELECT topic, fact_id, 'exceptions', 6 FROM f WHERE cur AND kind = 'exception' UNION ALL SELECT topic, fact_id, 'outdated', 8 FROM f WHERE NOT cur OR old),
    n AS (SELECT topic, section, row_number() OVER (PARTITION BY topic, section ORDER BY fact_id) AS n, fact_id, most FROM s)
    SELECT topic, section, n, fact_id FROM n WHERE n <= most UNION ALL SELECT topic, 'gap', 1, NULL FROM (SELECT DISTINCT topic FROM f) WHERE topic NOT IN (SELECT topic FROM s WHERE section IN ('rules', 'practice'))""",
)
def procedure_sections(spark: SparkSession, sf: str) -> DataFrame:
    """What is written on each topic, as rules, practice, exceptions and outdated versions."""
    fact, k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.col("l_orderkey")
    facts = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_partkey") % 10).alias("topic"), fact.alias("fact_id"), fact.alias("at"), F.expr(_KIND).alias("kind"), F.expr(_VALUE).alias("value"), (k % 3 > 0).alias("current"), F.when(k % 8 == 1, k).alias("outdated_by")
    )
    return briefs.procedure(facts)


@query(
    "training_sections",
    """WITH f AS (SELECT l_suppkey AS role, (['safety', 'work', 'quirks', 'people'])[l_orderkey % 4 + 1] AS section, (['policy', 'practice', 'exception', 'key_person'])[l_partkey % 4 + 1] AS kind, l_orderkey * 10 + l_linenumber AS fact_id FROM lineitem WHERE l_orderkey % 3 > 0),
    t AS (SELECT * FROM (VALUES ('safety', ['policy'], 8), ('work', ['practice', 'policy'], 10), ('quirks', ['practice', 'policy', 'exception'], 8), ('people', ['key_person'], 8)) AS t(section, kinds, most)),
    n AS (SELECT role, section, row_number() OVER (PARTITION BY role, section ORDER BY fact_id) AS n, fact_id, most FROM f JOIN t USING (section) WHERE list_contains(kinds, kind))
    SELECT role, section, n, fact_id FROM n WHERE n <= most""",
)
def training_sections(spark: SparkSession, sf: str) -> DataFrame:
    """What somebody new in a role has to learn: four searches, each cut to kinds of facts."""
    fact, k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.col("l_orderkey")
    one_of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % 4 + 1).cast("int"))
    kind = one_of(["policy", "practice", "exception", "key_person"], F.col("l_partkey"))
    facts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("role"), one_of(list(rules.TRAINING_SECTIONS), k).alias("search"), kind.alias("kind"), fact.alias("fact_id"), fact.alias("at"), (k % 3 > 0).alias("current"))
    return briefs.training_plan(facts)


_TELLING = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({}), '[a-z0-9$%.]{{3,}}'), lambda w: regexp_replace(w, '\\.$', '')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in rules.FACT_STOP_WORDS) + "], w)))"


@query(
    "supporting_passages",
    f"""WITH f AS (SELECT conv_id, {_TELLING.format("array_to_string((string_split(text, chr(10)))[1:2], ' ')")} AS w FROM conversations WHERE turn = 0),
    s AS (SELECT conv_id AS fact_id, turn AS passage_id, len(list_intersect({_TELLING.format("text")}, w)) AS shared, len(w) AS size FROM conversations JOIN f USING (conv_id) WHERE turn > 0)
    SELECT fact_id, passage_id, shared, shared / size AS score FROM s WHERE shared > 0 AND shared / size >= 0.3 QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY shared / size DESC, passage_id) <= 6""",
)
def supporting_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The answers of a conversation that say what was asked first."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("fact_id"), F.col("turn").alias("passage_id"), F.col("text").alias("content"))
    return briefs.supporting_passages(c.where("passage_id = 0"), c.where("passage_id > 0"))


@query(
    "topic_history_cards",
    """WITH f AS (SELECT o_custkey AS topic, o_orderpriority AS subject, o_orderkey AS fact_id, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b, o_orderstatus AS value, CASE o_orderkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS acl FROM orders),
    l AS (SELECT topic, subject, fact_id, a, acl, concat(strftime(a, '%Y-%m-%d'), ' → ', coalesce(strftime(b, '%Y-%m-%d'), 'now'), ' · ', subject, ': ', value, CASE WHEN b IS NOT NULL THEN ' (replaced)' ELSE '' END) AS line FROM f),
    c AS (SELECT DISTINCT topic, acl FROM l WHERE acl IS NOT NULL),
    t AS (SELECT c.topic, c.acl, concat('history across ', count(DISTINCT subject), ' records:', chr(10), string_agg(line, chr(10) ORDER BY a, fact_id)) AS content FROM c JOIN l ON l.topic = c.topic AND (l.acl IS NULL OR l.acl = c.acl) GROUP BY ALL HAVING count(*) >= 2)
    SELECT topic, content, min(acl) AS acl, count(*) AS classes FROM t GROUP BY topic, content""",
)
def topic_history_cards(spark: SparkSession, sf: str) -> DataFrame:
    """How each customer's orders went over time, as each class of readers sees it."""
    later = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o, k = table(spark, sf, "orders").withColumn("valid_to", later), F.col("o_orderkey") % 3
    status = F.when(F.col("valid_to").isNotNull(), "superseded").otherwise("accepted")
    steps = o.select(F.col("o_custkey").alias("topic"), F.col("o_orderpriority").alias("subject"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("valid_from"), "valid_to", F.col("o_orderstatus").alias("value"), status.alias("status"), F.when(k == 1, "a").when(k == 2, "b").alias("acl"))
    return briefs.history_cards(steps)


@query(
    "outdated_rate",
    """WITH h AS (SELECT user_id % 3 AS category, user_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, event_id % 7 AS k FROM events),
    a AS (SELECT category, q, min(rank) FILTER (WHERE k IN (1, 2)) AS cur, min(rank) FILTER (WHERE k IN (0, 3)) AS old FROM h WHERE rank <= 10 GROUP BY ALL)
    SELECT category, count(*) AS judged, count(*) FILTER (WHERE old IS NOT NULL AND (cur IS NULL OR old < cur)) AS worse FROM a WHERE cur IS NOT NULL OR old IS NOT NULL GROUP BY category""",
)
def outdated_rate(spark: SparkSession, sf: str) -> DataFrame:
    """How often something outdated stands above what is current."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.col("event_id") % 7
    hits = table(spark, sf, "events").select((F.col("user_id") % 3).alias("category"), F.col("user_id").alias("q"), rank.alias("rank"), F.when(k.isin(1, 2), "current").when(k.isin(0, 3), "outdated").alias("state"))
    return briefs.outdated_first(hits.where("rank <= 10"))


@query(
    "robustness_outcomes",
    """WITH h AS (SELECT event_type AS style, user_id AS q, event_id % 3 AS leg, 9 * row_number() OVER (PARTITION BY event_type, user_id, event_id % 3 ORDER BY ts, event_id) - 8 AS rank, event_id % 4 = 1 AS gold FROM events),
    b AS (SELECT style, q, min(rank) FILTER (WHERE leg = 0 AND gold AND rank <= 50) AS f, min(rank) FILTER (WHERE leg > 0 AND gold AND rank <= 100) AS l FROM h GROUP BY ALL)
    SELECT style, CASE WHEN f <= 10 THEN 'found' WHEN f IS NOT NULL THEN 'ranked low' WHEN l <= 30 THEN 'dropped' WHEN l IS NOT NULL THEN 'found too deep' ELSE 'never found' END AS outcome, count(*) AS n FROM b GROUP BY ALL""",
)
def robustness_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How the phrasings of questions end, by style."""
    leg = F.when(F.col("event_id") % 3 == 0, "final").when(F.col("event_id") % 3 == 1, "keyword").otherwise("meaning")
    h = table(spark, sf, "events").select(F.col("event_type").alias("style"), F.col("user_id").alias("q"), leg.alias("leg"), "ts", "event_id")
    rank = F.row_number().over(Window.partitionBy("style", "q", "leg").orderBy("ts", "event_id"))
    return briefs.robustness(h.withColumn("rank", rank * 9 - 8).withColumn("gold", F.col("event_id") % 4 == 1))
