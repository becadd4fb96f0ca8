"""Joins: chains, ranges, bands, prefixes, overlaps, paths over edges, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import graph, resolution
from lorekeep.plans.registry import query, table
from lorekeep.session import dealt


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.business_edges(table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "nation"))


EDGES_SQL = """edges AS (SELECT concat('o:', o_orderkey) AS src, concat('c:', o_custkey) AS dst, 'for_customer' AS rel, 'order' AS src_type, 'customer' AS dst_type FROM orders
  UNION ALL SELECT concat('c:', c_custkey), concat('n:', c_nationkey), 'located_in', 'customer', 'nation' FROM customer
  UNION ALL SELECT concat('n:', n_nationkey), concat('r:', n_regionkey), 'belongs_to', 'nation', 'region' FROM nation)"""


@query("join_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def join_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chained lookups, the last one optional."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    r = table(spark, sf, "region").where("r_name <> 'ASIA'")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"], "left")
    return joined.select("o_orderkey", "c_name", "n_name", "r_name")


@query("roles_permissions", "SELECT r_name AS role, n_name AS permission FROM region CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 5)")
def roles_permissions(spark: SparkSession, sf: str) -> DataFrame:
    """The product of two small fixed tables."""
    return table(spark, sf, "region").select(F.col("r_name").alias("role")).crossJoin(F.broadcast(table(spark, sf, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("permission"))))


@query("lateral_latest", "SELECT c_custkey, arg_max(o_orderkey, o_orderdate * 0 + o_orderkey) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey".replace("arg_max(o_orderkey, o_orderdate * 0 + o_orderkey) AS x", "(SELECT o_orderkey FROM orders o2 WHERE o2.o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest"))
def lateral_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order beside each customer, if there is one."""
    latest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(latest, c["c_custkey"] == latest["o_custkey"], "left").select("c_custkey", "latest")


@query("lateral_top_n", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 6")
def lateral_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The six largest orders per customer."""
    return graph.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 6).select("o_custkey", "o_orderkey", "rn")


@query(
    "range_join_row_chunks",
    """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS r FROM lineitem),
    chunks AS (SELECT l_suppkey AS s, r // 40 AS chunk, min(r) AS row_start, max(r) AS row_end FROM l GROUP BY ALL)
    SELECT s, chunk, count(*) AS n_rows FROM l JOIN chunks ON l_suppkey = s AND r BETWEEN row_start AND row_end GROUP BY s, chunk""",
)
def range_join_row_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows meet the 40-row unit that covers them: an equi-join on the unit's number instead of a range scan."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("r") / 40))
    chunks = rows.groupBy(F.col("l_suppkey").alias("s"), F.col("chunk").alias("c")).agg(F.min("r").alias("row_start"), F.max("r").alias("row_end"))
    joined = rows.join(chunks, (rows["l_suppkey"] == chunks["s"]) & (rows["chunk"] == chunks["c"])).where("r between row_start and row_end")
    return joined.groupBy("s", "chunk").agg(F.count("*").alias("n_rows"))


@query("neighbour_band", "SELECT a.conv_id, a.turn, b.turn AS near FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 WHERE a.role = 'user'")
def neighbour_band(spark: SparkSession, sf: str) -> DataFrame:
    """A unit with its neighbours: the band becomes three equal keys."""
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn"), F.col("turn") + 1)).alias("near"))
    return asked.join(c.select("conv_id", F.col("turn").alias("near")), ["conv_id", "near"]).select("conv_id", "turn", "near")


@query("undirected_edges", f"WITH {EDGES_SQL} SELECT dst AS x, src AS other, rel FROM edges WHERE dst LIKE 'n:%' UNION ALL SELECT src, dst, rel FROM edges WHERE src LIKE 'n:%'")
def undirected_edges(spark: SparkSession, sf: str) -> DataFrame:
    """What a thing is linked to, whichever end it is."""
    return graph.both_ways(_edges(spark, sf)).where(F.col("x").startswith("n:")).select("x", "other", "rel")


@query(
    "prefix_rule_match",
    """WITH p AS (SELECT page_id, regexp_replace(lower(url), '^https?://', '') AS path FROM pages),
    r AS (SELECT DISTINCT regexp_extract(path, '^[^/]+', 0) AS prefix, 'host' AS rule FROM p UNION SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/?#]+', 0), 'section' FROM p WHERE page_id % 2 = 0)
    SELECT page_id, arg_max(prefix, length(prefix)) AS prefix, arg_max(rule, length(prefix)) AS rule FROM p JOIN r ON prefix <> '' AND (path = prefix OR starts_with(path, concat(prefix, '/'))) GROUP BY page_id""",
)
def prefix_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    """The longest rule prefix of each path: paths are taken apart into prefixes, which join by equality."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.lower("url"), "^https?://", "").alias("path"))
    host = p.select(F.regexp_extract("path", "^[^/]+", 0).alias("prefix"), F.lit("host").alias("rule"))
    section = p.where("page_id % 2 = 0").select(F.regexp_extract("path", "^[^/]+/[^/?#]+", 0).alias("prefix"), F.lit("section").alias("rule"))
    rules_ = host.union(section).where("prefix <> ''").distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return p.select("page_id", F.explode(prefixes).alias("prefix")).join(rules_, "prefix").groupBy("page_id").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"), F.max_by("rule", F.length("prefix")).alias("rule"))


@query(
    "array_overlap_join",
    """WITH a AS (SELECT DISTINCT o_custkey AS id, l_partkey AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 50 = 1), b AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS e FROM lineitem WHERE l_suppkey % 10 = 1)
    SELECT DISTINCT a.id AS cust, b.id AS supp FROM a JOIN b USING (e)""",
)
def array_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose arrays share an element: both sides exploded, joined by the element, made distinct."""
    o, li = table(spark, sf, "orders").where("o_custkey % 50 = 1"), table(spark, sf, "lineitem")
    a = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy(F.col("o_custkey").alias("cust")).agg(F.collect_set("l_partkey").alias("parts"))
    b = li.where("l_suppkey % 10 = 1").groupBy(F.col("l_suppkey").alias("supp")).agg(F.collect_set("l_partkey").alias("parts"))
    return a.select("cust", F.explode("parts").alias("e")).join(b.select("supp", F.explode("parts").alias("e")), "e").select("cust", "supp").distinct()


@query(
    "two_hop_via_events",
    """WITH e AS (SELECT o_custkey, l_suppkey, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_custkey, l_suppkey, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) AS rn FROM e) WHERE rn <= 6""",
)
def two_hop_via_events(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers that meet in orders, the six closest of each."""
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.count()
    met = dealt(o, rows, "o_orderkey").join(dealt(li, rows, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey", "o_orderkey")
    pairs = dealt(met, rows, "o_custkey", "l_suppkey").distinct().groupBy("o_custkey", "l_suppkey").agg(F.count("o_orderkey").alias("n"))
    return graph.top_per_group(dealt(pairs, rows, "o_custkey"), ["o_custkey"], [F.desc("n"), F.col("l_suppkey")], 6)


@query(
    "colocation_pairs",
    """WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), o AS (SELECT DISTINCT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT l_suppkey AS supp, c_nationkey AS place, count(*) AS n FROM e JOIN o ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey GROUP BY ALL HAVING count(*) >= 3""",
)
def colocation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose orders go to places of their own nation, three times or more."""
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    o, c, s = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    placed = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey")
    met = e.join(placed, e["l_orderkey"] == placed["o_orderkey"]).join(s, (F.col("l_suppkey") == s["s_suppkey"]) & (F.col("c_nationkey") == s["s_nationkey"]))
    return met.groupBy(F.col("l_suppkey").alias("supp"), F.col("c_nationkey").alias("place")).agg(F.count("*").alias("n")).where("n >= 3")


@query(
    "triangles",
    """WITH t AS (SELECT o_custkey, c_nationkey AS direct, s_nationkey AS through FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)
    SELECT o_custkey, count(*) AS paths, count(*) FILTER (WHERE direct = through) AS agree FROM t GROUP BY o_custkey HAVING count(*) FILTER (WHERE direct <> through) > 0""",
)
def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose own nation and that of their suppliers disagree, with how often they agree."""
    o, c, li, s = (table(spark, sf, t) for t in ("orders", "customer", "lineitem", "supplier"))
    paths = o.join(c, o["o_custkey"] == c["c_custkey"]).join(li, o["o_orderkey"] == li["l_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    agree = F.count_if(F.col("c_nationkey") == F.col("s_nationkey"))
    return paths.groupBy("o_custkey").agg(F.count("*").alias("paths"), agree.alias("agree")).where("agree < paths")


_TRI = "list_distinct(list_transform(range(1, length(concat('  ', p, ' ')) - 1), lambda i: substr(concat('  ', p, ' '), i, 3)))"


@query(
    "trigram_jaccard_pairs",
    f"""WITH n AS (SELECT DISTINCT p_name AS p FROM part), t AS (SELECT p, {_TRI} AS g FROM n)
    SELECT a.p AS a, b.p AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM t a JOIN t b ON a.p < b.p WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.5""",
)
def trigram_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar names: candidates share a trigram, similarity follows from counts of shared ones."""
    t = table(spark, sf, "part").select(F.col("p_name").alias("p")).distinct().withColumn("g", text.name_trigrams(F.col("p")))
    one = t.select("p", F.size("g").alias("n"), F.explode("g").alias("t"))
    # at 0.5 and more, the rarest half of either name's trigrams (and one) holds a common one: only those meet
    held = one.join(one.groupBy("t").agg(F.count("*").alias("seen")), "t").withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy("seen", "t")))
    rare = held.where("place <= n - ceil(n / 2) + 1").select("p", "n", "t")
    pairs = rare.select(F.col("p").alias("a"), F.col("n").alias("na"), "t").join(rare.select(F.col("p").alias("b"), F.col("n").alias("nb"), "t"), "t").where("a < b and 2 * least(na, nb) >= greatest(na, nb)")
    side = lambda s: t.select(F.col("p").alias(s), F.col("g").alias(f"g{s}"))
    whole = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").withColumn("similarity", F.round(text.jaccard(F.col("ga"), F.col("gb")), 6))
    return whole.where("similarity >= 0.5").select("a", "b", "similarity")


@query(
    "name_containment",
    """WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS short FROM part) SELECT DISTINCT short, name, length(short) >= 4 AS fits FROM n""",
)
def name_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a short name is contained in a longer one."""
    n = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("short"), F.col("p_name").alias("name")).distinct()
    return n.select("short", "name", text.contains_name(F.col("short"), F.col("name")).alias("fits"))


@query("letters_in_order", "SELECT DISTINCT p_name AS name, concat(substr(p_name, 1, 1), right(p_name, 1)) AS code, true AS fits FROM part")
def letters_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a code's letters occur in a name in that order."""
    n = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.concat(F.substring("p_name", 1, 1), F.substring("p_name", -1, 1)).alias("code")).distinct()
    return n.select("name", "code", text.in_order(F.col("code"), F.col("name")).alias("fits"))


@query(
    "identifier_index",
    "WITH k AS (SELECT split_part(p_name, ' ', 1) AS word, p_brand FROM part) SELECT word, count(DISTINCT p_brand) AS holders, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS only FROM k GROUP BY word",
)
def identifier_index(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with the one entity that they name; ambiguous keys name none."""
    k = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), "p_brand")
    found = k.groupBy("word").agg(F.count_distinct("p_brand").alias("holders"), F.min("p_brand").alias("first"))
    return found.select("word", "holders", F.when(F.col("holders") == 1, F.col("first")).alias("only"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr(concat('  ', x, ' '), CAST(i AS INT), 3)))))"


@query(
    "fuzzy_lookup",
    f"""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part), a AS (SELECT concat(two, ' ', one) AS alias, name FROM n),
    q AS (SELECT DISTINCT unnest([upper(name), concat(name, 's'), concat(two, ' ', one), one]) AS q FROM n),
    t AS (SELECT q, {_GRAMS.format("q")} AS g FROM q), u AS (SELECT name, {_GRAMS.format("name")} AS g FROM n),
    f AS (SELECT one, min(name) AS name FROM n GROUP BY one HAVING count(*) = 1),
    s AS (SELECT q, 1 AS leg, name, 1.0::DOUBLE AS score FROM q JOIN n ON lower(q) = lower(name) UNION ALL SELECT q, 2, name, 0.95 FROM q JOIN a ON lower(alias) = lower(q)
      UNION ALL SELECT q, 3, name, len(list_intersect(t.g, u.g)) / len(list_distinct(list_concat(t.g, u.g))) AS score FROM t JOIN u ON len(list_intersect(t.g, u.g)) / len(list_distinct(list_concat(t.g, u.g))) > 0.6
      UNION ALL SELECT q, 4, name, 0.5 FROM q JOIN f ON lower(one) = lower(q))
    SELECT q, leg, name, score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY leg, score DESC, name) = 1""",
)
def fuzzy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A cascade of lookups for altered names: exact in other case, alias, similar, first word alone."""
    word = lambda k: F.split_part("name", F.lit(" "), F.lit(k))
    n = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    turned = F.concat_ws(" ", word(2), word(1))
    q = n.select(F.explode(F.array(F.upper("name"), F.concat("name", F.lit("s")), turned, word(1))).alias("q")).distinct()
    return resolution.lookup_cascade(q, n, n.select(turned.alias("alias"), "name"))


@query("null_safe_changes", "SELECT a.c_custkey, a.m AS was, b.m AS now FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS m FROM customer) a JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS m FROM customer) b USING (c_custkey) WHERE a.m IS DISTINCT FROM b.m")
def null_safe_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ, nulls counted as values."""
    c = table(spark, sf, "customer")
    a = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("was"))
    b = c.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("now"))
    return a.join(b, "c_custkey").where(~F.col("was").eqNullSafe(F.col("now")))


@query("anti_stale", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that nothing produces any more."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(
    "dictionary_link",
    f"""WITH k AS (SELECT unnest([1, 2, 3]) AS n), b AS (SELECT {_WORDS} AS w FROM benchmark), f AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS phrase FROM b, k WHERE length(array_to_string(w[1:n], ' ')) > 3),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(range(len(w))) AS pos, w FROM d), c AS (SELECT doc_id, pos, n, array_to_string(w[pos + 1:pos + n], ' ') AS phrase FROM g, k WHERE pos + n <= len(w)),
    s AS (SELECT doc_id, pos, max(n) AS n, arg_max(phrase, n) AS phrase FROM c SEMI JOIN f USING (phrase) GROUP BY doc_id, pos),
    t AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM s)
    SELECT phrase, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM t WHERE covered IS NULL OR pos >= covered GROUP BY phrase""",
)
def dictionary_link(spark: SparkSession, sf: str) -> DataFrame:
    """Longest dictionary phrases in texts: word n-grams join the dictionary, nested matches give way."""
    phrases = table(spark, sf, "benchmark").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice(text.words(F.col("text")), 1, n), " "))).alias("phrase")).where(F.length("phrase") > 3).distinct()
    tokens = table(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    grams = tokens.select("doc_id", F.posexplode("w").alias("at", "first"), "w").select("doc_id", "at", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"), "w").where("at + n <= size(w)")
    spans = grams.select("doc_id", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("phrase")).join(phrases, "phrase")
    longest = graph.top_per_group(spans, ["doc_id", "at"], [F.desc("n")], 1)
    before = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return longest.withColumn("covered", before).where("covered is null or at >= covered").groupBy("phrase").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))
