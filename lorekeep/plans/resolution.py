"""Entity resolution plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import candidates, repair, resolution
from lorekeep.plans.registry import query, table

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))


@query("certain_merges", f"WITH g AS (SELECT p_partkey AS entity, min(p_partkey) OVER (PARTITION BY {_NORMAL}) AS \"group\", count(*) OVER (PARTITION BY {_NORMAL}) AS n FROM part) SELECT entity, \"group\" FROM g WHERE n > 1")
def certain_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that go by one name."""
    none = spark.createDataFrame([], "entity long, identifier string")
    return resolution.certain_merges(_entities(spark, sf), none)


@query(
    "merge_apply",
    f"""WITH g AS (SELECT p_partkey AS entity, {_NORMAL} AS k, p_size AS activity FROM part), s AS (SELECT k, arg_max(entity, CAST(activity AS BIGINT) * 100000000 - entity) AS survivor FROM g GROUP BY k), m AS (SELECT entity, survivor FROM g JOIN s USING (k))
    SELECT survivor AS src, l_suppkey + 1000000000 AS dst, 'supplied_by' AS rel, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem JOIN m ON l_partkey = entity GROUP BY ALL""",
)
def merge_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Links carried over to the surviving things."""
    p = table(spark, sf, "part")
    groups = resolution.certain_merges(_entities(spark, sf), spark.createDataFrame([], "entity long, identifier string"))
    weights = p.select(F.col("p_partkey").alias("entity"), F.lit(0).alias("n_ids"), F.col("p_size").alias("activity"), F.lit(0).alias("name_length"))
    edges = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"), F.lit("supplied_by").alias("rel"))
    return resolution.repoint(edges, resolution.merge_map(groups, weights))


@query("thread_build", "SELECT min(conv_id * 100 + turn) AS thread, count(*) AS messages, min(turn) AS first, max(turn) AS last, count(*) FILTER (WHERE turn = 0 AND conv_id % 5 = 0) AS missing FROM conversations GROUP BY conv_id")
def thread_build(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations rebuilt from what each message answers."""
    c = table(spark, sf, "conversations")
    ident = F.col("conv_id") * 100 + F.col("turn")
    parent = F.when(F.col("turn") > 0, ident - 1).when(F.col("conv_id") % 5 == 0, ident - 50_000_000)
    return resolution.threads(c.select(ident.alias("id"), parent.alias("parent"), F.col("turn").alias("at")))


@query(
    "directory_merge",
    """WITH c AS (SELECT concat('person ', c_custkey) AS person, c_mktsegment AS segment, c_nationkey AS nation FROM customer), s AS (SELECT concat('person ', s_suppkey) AS person, 'SUPPLY' AS segment, s_nationkey AS nation FROM supplier)
    SELECT person, CASE WHEN c.person IS NOT NULL AND s.person IS NOT NULL THEN ['crm', 'erp'] WHEN s.person IS NULL THEN ['crm'] ELSE ['erp'] END AS systems, coalesce(s.segment, c.segment) AS segment, coalesce(s.nation, c.nation) AS nation,
      list_filter([CASE WHEN s.segment <> c.segment THEN 'segment' END, CASE WHEN s.nation <> c.nation THEN 'nation' END], lambda x: x IS NOT NULL) AS conflicts FROM c FULL JOIN s USING (person)""",
)
def directory_merge(spark: SparkSession, sf: str) -> DataFrame:
    """People of two systems as one directory."""
    c = table(spark, sf, "customer").select(F.lit("crm").alias("system"), F.lit(1).alias("authority"), F.concat(F.lit("Person "), "c_custkey").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.lit("erp").alias("system"), F.lit(2).alias("authority"), F.concat(F.lit("PERSON-"), "s_suppkey").alias("name"), F.lit("SUPPLY").alias("segment"), F.col("s_nationkey").alias("nation"))
    return resolution.merge_directory(c.union(s), ["segment", "nation"])


_CAND = r"""e AS (SELECT DISTINCT concat('p', p_partkey % 400) AS entity, CASE WHEN p_partkey % 400 < 8 THEN 'Branch' ELSE 'Thing' END AS type, CASE (p_partkey % 400) % 3 WHEN 0 THEN concat(f, ' ', chr(CAST(97 + p_partkey % 400 // 20 AS INT)), 'x', p_partkey % 20) WHEN 1 THEN concat(f, ' ', s, ' ', chr(CAST(97 + p_partkey % 400 // 20 AS INT))) ELSE concat(s, 's ', p_partkey % 400) END AS name
    FROM (SELECT *, ['north', 'valley', 'kemper', 'harbor', 'summit'][CAST(p_partkey % 5 + 1 AS INT)] AS f, ['dairy', 'molding', 'foods', 'steel'][CAST(p_partkey % 4 + 1 AS INT)] AS s FROM part)),
  n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM e),
  g AS (SELECT *, list_distinct(list_transform(range(1, length(norm) + 2), lambda i: substr(concat('  ', norm, ' '), CAST(i AS INT), 3))) AS gs, string_split(norm, ' ') AS w FROM n),
  big AS (SELECT type, count(*) AS size, min(entity) AS first FROM n GROUP BY type),
  l AS (SELECT a.entity AS a, b.entity AS b FROM g a JOIN g b ON a.type = b.type AND a.entity < b.entity WHERE a.norm = b.norm OR len(list_intersect(a.gs, b.gs)) / len(list_distinct(list_concat(a.gs, b.gs))) >= 0.5
      OR (len(a.w) <= len(b.w) AND len(list_filter(a.w, lambda s: len(list_filter(b.w, lambda x: x = s OR (length(s) >= 4 AND starts_with(x, s)))) = 0)) = 0 AND len(list_filter(a.w, lambda s: length(s) >= 4)) > 0)
      OR (len(b.w) < len(a.w) AND len(list_filter(b.w, lambda s: len(list_filter(a.w, lambda x: x = s OR (length(s) >= 4 AND starts_with(x, s)))) = 0)) = 0 AND len(list_filter(b.w, lambda s: length(s) >= 4)) > 0)
    UNION SELECT first, entity FROM n JOIN big USING (type) WHERE size <= 25 AND entity <> first),
  u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS entity, a AS spot FROM u UNION SELECT r.entity, u.b FROM r JOIN u ON u.a = r.spot),
  c AS (SELECT entity, min(spot) AS component FROM r GROUP BY 1),
  p AS (SELECT c.entity, component, (row_number() OVER (PARTITION BY component ORDER BY norm, entity) - 1) // 14 AS run FROM c JOIN n USING (entity))"""


@query("fuzzy_groups", f"""WITH RECURSIVE {_CAND} SELECT entity, concat(component, '/', run) AS "group" FROM p""")
def fuzzy_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts, branches whole, that may be one thing: groups of at most fourteen."""
    k = F.col("p_partkey")
    f = F.element_at(F.array(*map(F.lit, ("north", "valley", "kemper", "harbor", "summit"))), (k % 5 + 1).cast("int"))
    s = F.element_at(F.array(*map(F.lit, ("dairy", "molding", "foods", "steel"))), (k % 4 + 1).cast("int"))
    letter = F.char((97 + F.floor(k % 400 / 20)).cast("int"))
    name = F.when(k % 400 % 3 == 0, F.concat(f, F.lit(" "), letter, F.lit("x"), k % 20)).when(k % 400 % 3 == 1, F.concat_ws(" ", f, s, letter)).otherwise(F.concat(s, F.lit("s "), k % 400))
    e = table(spark, sf, "part").select(F.concat(F.lit("p"), k % 400).alias("entity"), F.when(k % 400 < 8, "Branch").otherwise("Thing").alias("type"), name.alias("name")).distinct()
    return candidates.fuzzy_groups(e)[0]


_LETTERS = "concat(chr(CAST(97 + {k} % 26 AS INT)), chr(CAST(97 + {k} // 26 % 26 AS INT)), chr(CAST(97 + {k} // 676 % 26 AS INT)), ' works ', {k} % 9)"
_CALLED = _LETTERS.format(k="(({k} * 7 + 3) % 17576)")
_IDS = rf"""c AS (SELECT c_custkey AS k, {_CALLED.format(k='c_custkey')} AS name, max(c_custkey) OVER () AS most FROM customer),
  rows_ AS (SELECT k AS row, CAST(k AS VARCHAR) AS ext, CASE WHEN k % 10 = 3 THEN {_CALLED.format(k='((k + 5) % (most + 1))')} WHEN k % 10 = 7 THEN concat('zzq ', k) WHEN k % 20 = 9 THEN concat('yyq ', k) ELSE name END AS rn, CASE WHEN k % 20 = 9 THEN concat('e', k) END AS uni FROM c
    UNION ALL SELECT 1000000000 + k, CAST(k AS VARCHAR), concat('vvq ', k), NULL FROM c WHERE k % 10 = 5),
  r AS (SELECT *, trim(regexp_replace(regexp_replace(lower(rn), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM rows_),
  fit AS (SELECT *, split_part(norm, ' ', 1) AS f, replace(norm, ' ', '') AS q FROM r), h AS (SELECT k, name, split_part(name, ' ', 1) AS f, replace(name, ' ', '') AS q FROM c),
  sh AS (SELECT DISTINCT a.ext FROM fit a JOIN fit b ON a.ext = b.ext AND a.norm < b.norm WHERE NOT (a.f = b.f OR regexp_matches(b.q, concat('.*', array_to_string(regexp_extract_all(a.q, '.'), '.*'), '.*')) OR regexp_matches(a.q, concat('.*', array_to_string(regexp_extract_all(b.q, '.'), '.*'), '.*')))),
  wrong AS (SELECT fit.ext, rn, norm, k AS holder FROM fit JOIN h ON ext = CAST(k AS VARCHAR) WHERE ext NOT IN (SELECT ext FROM sh) AND uni IS NULL AND NOT (fit.f = h.f OR regexp_matches(h.q, concat('.*', array_to_string(regexp_extract_all(fit.q, '.'), '.*'), '.*')) OR regexp_matches(fit.q, concat('.*', array_to_string(regexp_extract_all(h.q, '.'), '.*'), '.*')))),
  into_ AS (SELECT w.ext, w.rn, w.holder, CASE WHEN count(n.k) = 1 THEN min(n.k) END AS dest FROM wrong w LEFT JOIN c n ON n.name = w.norm AND n.k <> w.holder GROUP BY ALL)"""


@query(
    "repaired_ids",
    f"""WITH {_IDS} SELECT 'shared' AS part, ext, CAST(NULL AS VARCHAR) AS row_name, CAST(NULL AS BIGINT) AS holder, CAST(NULL AS BIGINT) AS into_entity FROM sh UNION ALL SELECT 'fix', ext, rn, holder, dest FROM into_
    UNION ALL SELECT 'id', CAST(k AS VARCHAR), NULL, NULL, coalesce(dest, k) FROM c LEFT JOIN (SELECT ext, min(dest) AS dest FROM into_ GROUP BY ext) i ON i.ext = CAST(k AS VARCHAR) WHERE CAST(k AS VARCHAR) NOT IN (SELECT ext FROM sh)""",
)
def repaired_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A list whose rows in part name other customers than their id does: ids that go to the one customer of that name, that wait for a person, or that are nobody's."""
    called = lambda k: F.concat(*[F.char((97 + F.floor((k * 7 + 3) % 17576 / d) % 26).cast("int")) for d in (1, 26, 676)], F.lit(" works "), (k * 7 + 3) % 17576 % 9)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    most = c.agg(F.max("k").alias("most"))
    k = F.col("k")
    name = F.when(k % 10 == 3, called((k + 5) % (F.col("most") + 1))).when(k % 10 == 7, F.concat(F.lit("zzq "), k)).when(k % 20 == 9, F.concat(F.lit("yyq "), k)).otherwise(called(k))
    row = [F.lit("Customer").alias("type"), F.lit("crm").alias("system"), k.cast("string").alias("ext")]
    rows = c.crossJoin(F.broadcast(most)).select(k.alias("row"), *row, name.alias("row_name"), F.when(k % 20 == 9, F.array(F.concat(F.lit("e"), k))).alias("universal"))
    rows = rows.union(c.where("k % 10 = 5").select(k + 1_000_000_000, *row, F.concat(F.lit("vvq "), k), F.lit(None).cast("array<string>")))
    names = c.select(k.alias("entity"), F.lit("Customer").alias("type"), called(k).alias("name"))
    ids = c.select(k.alias("entity"), F.lit("Customer").alias("type"), F.lit("crm").alias("system"), k.cast("string").alias("value"))
    ids = ids.union(c.select("k", F.lit("Customer"), F.lit("Email"), F.concat(F.lit("e"), k)))
    none = spark.createDataFrame([], "relationship string, source long, target long")
    out = repair.repair_ids(rows, names, ids, none, spark.createDataFrame([], "row long, relationship string, target long"))
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return (
        out.shared.select(F.lit("shared").alias("part"), "ext", empty("string", "row_name"), empty("long", "holder"), empty("long", "into_entity"))
        .union(out.fixes.select(F.lit("fix"), "ext", "row_name", "holder", "into"))
        .union(out.identifiers.where("system = 'crm'").select(F.lit("id"), "value", empty("string", "row_name"), empty("long", "holder"), "entity"))
    )
