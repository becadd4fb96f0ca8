"""What readers and searches get: derived visibility, scopes of files, names that resolve, results that are cleaned up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import graph
from lorekeep.operators.access import reachable
from lorekeep.plans.registry import query, table

_READABLE = "r_regionkey IN (0, 2, 3)"


@query(
    "derived_visibility",
    f"""WITH c AS (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE {_READABLE}),
    o AS (SELECT o_orderkey FROM orders JOIN c ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'F')), l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN o ON o_orderkey = l_orderkey)
    SELECT 'customer' AS kind, count(*) AS visible FROM c UNION ALL SELECT 'order', count(*) FROM o UNION ALL SELECT 'line', count(*) FROM l UNION ALL SELECT 'part', count(*) FROM part WHERE EXISTS (SELECT 1 FROM l WHERE l_partkey = p_partkey)""",
)
def derived_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are visible as what they hang on: live orders as their customer, lines as their order, parts as any of their lines."""
    c, n, o, li, p = (table(spark, sf, t) for t in ("customer", "nation", "orders", "lineitem", "part"))
    regions = table(spark, sf, "region").where(_READABLE)
    n = n.join(regions, n["n_regionkey"] == regions["r_regionkey"], "left_semi")
    c = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_semi")
    o = o.where(F.col("o_orderstatus").isin("O", "F")).join(c, o["o_custkey"] == c["c_custkey"], "left_semi")
    li = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_semi")
    p = p.join(li, p["p_partkey"] == li["l_partkey"], "left_semi")
    parts = [df.agg(F.count("*").alias("visible")).select(F.lit(kind).alias("kind"), "visible") for kind, df in (("customer", c), ("order", o), ("line", li), ("part", p))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_THREADS = "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn > 1 THEN 'b' WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN 'c' ELSE 'a' END AS acl FROM conversations"


@query(
    "thread_visibility",
    f"""WITH m AS ({_THREADS}), t AS (SELECT conv_id, count(DISTINCT coalesce(acl, '')) > 1 AS mixed, CASE WHEN count(DISTINCT coalesce(acl, '')) = 1 THEN min(acl) END AS acl FROM m GROUP BY conv_id),
    v AS (SELECT m.conv_id, m.turn, m.acl IS NULL OR m.acl IN ('a', 'b') AS message, (t.acl IS NULL OR t.acl IN ('a', 'b')) AND NOT mixed AS thread FROM m JOIN t USING (conv_id))
    SELECT conv_id, bool_or(thread) AS thread, count(*) FILTER (WHERE message) AS messages, count(*) FILTER (WHERE message AND thread) AS members FROM v GROUP BY conv_id""",
)
def thread_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Threads of one list are read by that list, mixed ones by managers only; their messages are read one by one."""
    acl = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") > 1), "b").when(F.col("conv_id") % 4 == 0, None).when(F.col("conv_id") % 3 == 0, "c").otherwise("a")
    readable = lambda c: c.isNull() | c.isin("a", "b")
    kinds = F.collect_set(F.coalesce("acl", F.lit("")))
    m = table(spark, sf, "conversations").select("conv_id", "turn", acl.alias("acl"))
    t = m.groupBy("conv_id").agg(F.size(kinds).alias("kinds"), F.min("acl").alias("one"), F.count_if(readable(F.col("acl"))).alias("messages"))
    seen = (F.col("kinds") == 1) & readable(F.col("one"))
    return t.select("conv_id", seen.alias("thread"), "messages", F.when(seen, F.col("messages")).otherwise(0).cast("long").alias("members"))


@query(
    "scope_visibility",
    """WITH s AS (SELECT DISTINCT source AS scope, CAST(substr(source, 4) AS INT) % 3 = 0 AS hidden FROM documents), r AS (SELECT unnest(['manager', 'reader', 'guest']) AS who)
    SELECT who, scope FROM r CROSS JOIN s WHERE who = 'manager' OR NOT hidden OR (who = 'reader' AND scope IN ('src0', 'src3'))""",
)
def scope_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes that each role sees: managers all, others those that aren't hidden or that they may read."""
    scopes = table(spark, sf, "documents").select(F.col("source").alias("scope")).distinct().withColumn("hidden", F.substring("scope", 4, 9).cast("int") % 3 == 0)
    roles = F.array(F.lit("manager"), F.lit("reader"), F.lit("guest"))
    seen = (F.col("who") == "manager") | ~F.col("hidden") | ((F.col("who") == "reader") & F.col("scope").isin("src0", "src3"))
    return scopes.withColumn("who", F.explode(roles)).where(seen).select("who", "scope")


_SITE = "split_part(regexp_replace(url, '^https?://', ''), '?', 1)"


@query(
    "scope_assignment",
    f"""WITH f AS (SELECT page_id, {_SITE} AS path FROM pages), h AS (SELECT DISTINCT split_part(path, '/', 1) AS host FROM f),
    s AS (SELECT DISTINCT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS prefix FROM f WHERE length(split_part(path, '/', 2)) > 4),
    r AS (SELECT host AS prefix, concat('host ', host) AS scope FROM h WHERE length(host) % 2 = 0 UNION ALL SELECT prefix, concat('section ', prefix) FROM s),
    m AS (SELECT page_id, scope, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS rn FROM f JOIN r ON path = prefix OR starts_with(path, concat(prefix, '/')))
    SELECT f.page_id, CASE WHEN f.page_id % 11 = 0 THEN 'kept by hand' ELSE coalesce(scope, 'everyone') END AS scope, CASE WHEN f.page_id % 11 = 0 THEN 'human' WHEN scope IS NULL THEN 'default' ELSE 'rule' END AS origin
    FROM f LEFT JOIN m ON m.page_id = f.page_id AND rn = 1""",
)
def scope_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's scope: a person's choice stays, else the rule of the longest folder over it, else the default."""
    f = table(spark, sf, "pages").select("page_id", F.expr(_SITE).alias("path"))
    part = lambda k: F.split_part("path", F.lit("/"), F.lit(k))
    hosts = f.select(part(1).alias("prefix")).distinct().where("length(prefix) % 2 = 0").withColumn("scope", F.concat(F.lit("host "), "prefix"))
    sections = f.where(F.length(part(2)) > 4).select(F.concat(part(1), F.lit("/"), part(2)).alias("prefix")).distinct().withColumn("scope", F.concat(F.lit("section "), "prefix"))
    steps = F.split("path", "/")
    over = f.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("prefix"))
    ruled = over.join(hosts.union(sections), "prefix").groupBy("page_id").agg(F.max_by("scope", F.length("prefix")).alias("scope"))
    by_hand = F.col("page_id") % 11 == 0
    return f.join(ruled, "page_id", "left").select(
        "page_id",
        F.when(by_hand, "kept by hand").otherwise(F.coalesce("scope", F.lit("everyone"))).alias("scope"),
        F.when(by_hand, "human").when(F.col("scope").isNull(), "default").otherwise("rule").alias("origin"),
    )


@query(
    "moved_subtree",
    """WITH RECURSIVE n AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, CASE WHEN turn > 0 THEN conv_id * 100 + (turn - 1) // 2 END AS parent FROM conversations),
    t AS (SELECT id FROM n WHERE turn = 1 AND conv_id % 3 = 0 UNION SELECT n.id FROM n JOIN t ON n.parent = t.id)
    SELECT n.id, CASE WHEN t.id IS NOT NULL THEN 'moved' ELSE concat('scope ', conv_id % 4) END AS scope, CASE WHEN t.id IS NOT NULL THEN 'human' ELSE 'ai' END AS origin FROM n LEFT JOIN t USING (id)""",
)
def moved_subtree(spark: SparkSession, sf: str) -> DataFrame:
    """Files moved by a person take everything inside them along, at any depth."""
    node = lambda t: F.col("conv_id") * 100 + t
    n = table(spark, sf, "conversations").select(node(F.col("turn")).alias("id"), "conv_id", "turn", F.when(F.col("turn") > 0, node(F.floor((F.col("turn") - 1) / 2))).alias("parent"))
    moved = reachable(n.where("turn = 1 and conv_id % 3 = 0").select(F.col("id").alias("root")), n.where("parent is not null").select(F.col("parent").alias("child"), F.col("id").alias("parent")))
    moved = moved.select(F.col("node").alias("id")).distinct().withColumn("moved", F.lit(True))
    own = F.concat(F.lit("scope "), (F.col("conv_id") % 4).cast("string"))
    return n.join(moved, "id", "left").select("id", F.when(F.col("moved"), "moved").otherwise(own).alias("scope"), F.when(F.col("moved"), "human").otherwise("ai").alias("origin"))


@query(
    "visible_cards",
    """WITH c AS (SELECT concat('e:', o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN concat('~', o_orderkey % 3) ELSE '' END) AS id, concat('r', o_orderkey % 4) AS acl FROM orders)
    SELECT DISTINCT split_part(id, '~', 1) AS id FROM c WHERE acl IN ('r1', 'r3')""",
)
def visible_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of which the reader may see any variant."""
    variant = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("~"), (F.col("o_orderkey") % 3).cast("string"))).otherwise("")
    cards = table(spark, sf, "orders").select(F.concat(F.lit("e:"), F.col("o_custkey").cast("string"), variant).alias("id"), F.concat(F.lit("r"), (F.col("o_orderkey") % 4).cast("string")).alias("acl"))
    return cards.where(F.col("acl").isin("r1", "r3")).select(F.split_part("id", F.lit("~"), F.lit(1)).alias("id")).distinct()


@query(
    "label_narrowing",
    r"""WITH p AS (SELECT concat('u', c_custkey) AS who, c_nationkey AS area, c_mktsegment AS label FROM customer),
    l AS (SELECT doc_id, unnest(string_split(concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'for | building' WHEN 2 THEN 'a | b | MACHINERY' ELSE '' END), chr(10))) AS line FROM documents),
    m AS (SELECT DISTINCT doc_id, label FROM l JOIN (SELECT DISTINCT label FROM p) ON lower(trim(split_part(line, '|', -1))) = lower(label) WHERE len(string_split(line, '|')) <= 2)
    SELECT d.doc_id, count(who) AS readers FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN p ON p.area = d.doc_id % 25 AND (m.label IS NULL OR p.label = m.label) GROUP BY d.doc_id""",
)
def label_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    """Readers of each file: the people of its area, and where a line of at most two cells names a label, only those who hold it too."""
    people = table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("who"), F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("label"))
    k = F.col("doc_id") % 4
    d = table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit("\n"), F.when(k == 0, "AUTOMOBILE").when(k == 1, "for | building").when(k == 2, "a | b | MACHINERY").otherwise("")))
    cells = F.split("line", r"\|")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.size(cells) <= 2).select("doc_id", F.lower(F.trim(F.element_at(cells, -1))).alias("mark"))
    marked = lines.join(people.select("label", F.lower("label").alias("mark")).distinct(), "mark").select("doc_id", "label").distinct()
    sizes = people.groupBy("area", "label").agg(F.count("*").alias("n"))
    areas = sizes.groupBy("area").agg(F.sum("n").alias("of_area"))
    area = (F.col("doc_id") % 25).alias("area")
    narrowed = marked.select("doc_id", "label", area).join(sizes, ["area", "label"], "left").groupBy("doc_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("of_label"))
    out = d.select("doc_id", area).join(narrowed, "doc_id", "left").join(areas, "area", "left")
    return out.select("doc_id", F.coalesce("of_label", "of_area", F.lit(0)).alias("readers"))


@query(
    "resolved_references",
    """WITH e AS (SELECT concat('s', s_suppkey) AS id, s_name AS name, 'Supplier' AS type FROM supplier UNION ALL SELECT concat('t', s_suppkey), concat('our ', s_suppkey), 'Term' FROM supplier),
    x AS (SELECT l_suppkey, count(*) AS links FROM lineitem GROUP BY l_suppkey),
    a AS (SELECT concat('s', s_suppkey) AS id, concat('#', s_suppkey % 7) AS alias FROM supplier),
    r AS (SELECT unnest([id, upper(name)]) AS ref FROM e UNION SELECT alias FROM a UNION SELECT 'nobody'),
    h AS (SELECT ref, e.id, name, type, lower(name) = lower(ref) AS exact FROM r JOIN e ON e.id = ref OR lower(name) = lower(ref) UNION SELECT ref, e.id, name, type, false FROM r JOIN a ON alias = lower(trim(ref)) JOIN e ON e.id = a.id),
    b AS (SELECT ref, h.id, type, row_number() OVER (PARTITION BY ref ORDER BY type <> 'Term' DESC, exact DESC, coalesce(links, 0) DESC, h.id) AS rn FROM h LEFT JOIN x ON h.id = concat('s', l_suppkey))
    SELECT r.ref, CASE WHEN type = 'Term' THEN concat('s', substr(id, 2)) ELSE id END AS id FROM r LEFT JOIN b ON b.ref = r.ref AND rn = 1""",
)
def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """The one entity that an id, a name or an alias means: things before terms, exact names first, then the most connected; a term stands for its thing."""
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    things = s.select(F.concat(F.lit("s"), key).alias("id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("type"))
    e = things.union(s.select(F.concat(F.lit("t"), key), F.concat(F.lit("our "), key), F.lit("Term")))
    aliases = s.select(F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("#"), (F.col("s_suppkey") % 7).cast("string")).alias("alias"))
    links = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id")).agg(F.count("*").alias("links"))
    refs = e.select(F.explode(F.array("id", F.upper("name"))).alias("ref")).union(aliases.select("alias")).union(spark.range(1).select(F.lit("nobody"))).distinct()
    forms = e.select(F.col("id").alias("form"), "id", F.lit(False).alias("exact")).union(e.select(F.lower("name"), "id", F.lit(True))).union(aliases.select("alias", "id", F.lit(False)))
    asked = refs.select("ref", F.explode(F.array_distinct(F.array("ref", F.lower(F.trim("ref"))))).alias("form"))
    hits = asked.join(forms, "form").join(e.select("id", "type"), "id").join(links, "id", "left")
    best = graph.top_per_group(hits, ["ref"], [F.col("type") == "Term", F.desc("exact"), F.desc(F.coalesce("links", F.lit(0))), F.col("id")], 1)
    meant = F.when(F.col("type") == "Term", F.concat(F.lit("s"), F.substring("id", 2, 40))).otherwise(F.col("id"))
    return refs.join(best.select("ref", meant.alias("id")), "ref", "left")


@query(
    "merge_queue",
    """WITH d AS (SELECT p_partkey, p_name, p_brand, count(l_orderkey) AS links FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
    n AS (SELECT *, lead(p_partkey) OVER w AS other, lead(links) OVER w AS other_links FROM d WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY p_partkey))
    SELECT p_partkey AS a, other AS b, links AS a_links, other_links AS b_links, CASE WHEN links >= other_links THEN p_partkey ELSE other END AS survivor FROM n WHERE other IS NOT NULL""",
)
def merge_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that may be one thing, with their links; the more connected one would survive."""
    links = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf, "part").join(links, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("links", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    pairs = p.withColumn("b", F.lead("p_partkey").over(w)).withColumn("b_links", F.lead("links").over(w)).where("b is not null")
    return pairs.select(F.col("p_partkey").alias("a"), "b", F.col("links").alias("a_links"), "b_links", F.when(F.col("links") >= F.col("b_links"), F.col("p_partkey")).otherwise(F.col("b")).alias("survivor"))


@query(
    "knowledge_overview",
    """SELECT 'customer' AS kind, c_mktsegment AS word, count(*) AS things, count(DISTINCT c_nationkey) AS places FROM customer GROUP BY 2
    UNION ALL SELECT 'part', p_brand, count(*), count(DISTINCT p_type) FROM part GROUP BY 2 UNION ALL SELECT 'order', o_orderpriority, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 2""",
)
def knowledge_overview(spark: SparkSession, sf: str) -> DataFrame:
    """What the record knows of: things per word of its vocabulary, and how widely they spread."""
    count = lambda name, kind, word, place: table(spark, sf, name).groupBy(F.lit(kind).alias("kind"), F.col(word).alias("word")).agg(F.count("*").alias("things"), F.count_distinct(place).alias("places"))
    return count("customer", "customer", "c_mktsegment", "c_nationkey").union(count("part", "part", "p_brand", "p_type")).union(count("orders", "order", "o_orderpriority", "o_custkey"))


@query(
    "collapsed_legs",
    """WITH h AS (SELECT user_id AS q, event_type AS leg, event_id, CAST(props->>'k' AS INT) % 5 AS key, value FROM events),
    c AS (SELECT *, row_number() OVER (PARTITION BY q, leg, key ORDER BY value DESC, event_id) AS rn FROM h)
    SELECT q, leg, event_id, row_number() OVER (PARTITION BY q, leg ORDER BY value DESC, event_id) AS rank FROM c WHERE rn = 1""",
)
def collapsed_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Results of each leg of a search, the best one per card or message, ranked anew."""
    h = table(spark, sf, "events").select(F.col("user_id").alias("q"), F.col("event_type").alias("leg"), "event_id", (F.get_json_object("props", "$.k").cast("int") % 5).alias("key"), "value")
    best = graph.top_per_group(h, ["q", "leg", "key"], [F.desc("value"), F.col("event_id")], 1)
    rank = F.row_number().over(Window.partitionBy("q", "leg").orderBy(F.desc("value"), "event_id"))
    return best.select("q", "leg", "event_id", rank.alias("rank"))


@query(
    "outdated_hits",
    """WITH h AS (SELECT user_id AS q, event_id, event_id % 4 = 0 AS fact, event_type AS title, event_id % 3 = 0 AS current FROM events),
    c AS (SELECT DISTINCT q, title FROM h WHERE fact AND current)
    SELECT h.q, event_id, NOT fact AS passage, NOT fact AND NOT current AND c.q IS NOT NULL AS outdated FROM h LEFT JOIN c ON c.q = h.q AND c.title = h.title WHERE NOT (fact AND NOT current AND c.q IS NOT NULL)""",
)
def outdated_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Results without facts whose replacement is among them; passages of replaced facts are marked, but only beside the replacement."""
    k = F.col("event_id")
    h = table(spark, sf, "events").select(F.col("user_id").alias("q"), k, (k % 4 == 0).alias("fact"), F.col("event_type").alias("title"), (k % 3 == 0).alias("current"))
    replaced = ~F.col("current") & F.bool_or(F.col("fact") & F.col("current")).over(Window.partitionBy("q", "title"))
    return h.withColumn("replaced", replaced).where("not (fact and replaced)").select("q", "event_id", (~F.col("fact")).alias("passage"), (~F.col("fact") & F.col("replaced")).alias("outdated"))


@query(
    "name_dictionary",
    r"""WITH s AS (SELECT concat('p', p_partkey) AS id, unnest([p_name, concat(p_name, ' ', p_brand), split_part(p_type, ' ', 1), 'Co.']) AS phrase FROM part UNION ALL SELECT concat('n', n_nationkey), unnest([n_name, concat('the ', n_name, '''s')]) FROM nation),
    n AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(phrase), '[’'']s\b', '', 'g'), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM s)
    SELECT phrase, count(DISTINCT id) AS things, min(id) AS first FROM n WHERE len(string_split(phrase, ' ')) <= 8 AND (phrase LIKE '% %' OR length(phrase) >= 3 OR regexp_matches(phrase, '^[a-z]{1,6} ?\d+[a-z]?$')) GROUP BY phrase""",
)
def name_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The linker's dictionary: names and aliases of all things as it compares them; short words only where they are codes."""
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    phrases = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.explode(F.array("p_name", F.concat_ws(" ", "p_name", "p_brand"), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("Co."))).alias("phrase"))
    phrases = phrases.union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.explode(F.array("n_name", F.concat(F.lit("the "), "n_name", F.lit("'s"))))))
    normal = phrases.select("id", text.normalize_phrase(F.col("phrase")).alias("phrase"))
    fits = (F.size(F.split("phrase", " ")) <= 8) & (F.col("phrase").contains(" ") | (F.length("phrase") >= 3) | F.col("phrase").rlike(r"^[a-z]{1,6} ?\d+[a-z]?$"))
    return normal.where(fits).groupBy("phrase").agg(F.count_distinct("id").alias("things"), F.min("id").alias("first"))


@query(
    "directory_entries",
    """WITH w AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    a AS (SELECT c_custkey, unnest([concat('C', c_custkey), lower(c_name), concat(c_mktsegment, ' ', c_nationkey)]) AS alias FROM customer)
    SELECT c.c_custkey, c_name, string_agg(DISTINCT alias, ' | ' ORDER BY alias) AS aliases, coalesce(any_value(n), 0) AS weight FROM customer c JOIN a ON a.c_custkey = c.c_custkey AND lower(alias) <> lower(c_name) LEFT JOIN w ON o_custkey = c.c_custkey GROUP BY ALL""",
)
def directory_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Things with the other names that they go by, weighed by what is known of them."""
    w = table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf, "customer").join(w, F.col("c_custkey") == F.col("o_custkey"), "left")
    aliases = F.array(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.lower("c_name"), F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")))
    others = F.array_sort(F.array_distinct(F.filter(aliases, lambda x: F.lower(x) != F.lower("c_name"))))
    return c.select("c_custkey", "c_name", F.array_join(others, " | ").alias("aliases"), F.coalesce("n", F.lit(0)).alias("weight"))


_KIND = "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'email_body' WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE 'ocr' END"


@query(
    "evidence_passages",
    rf"""WITH e AS (SELECT doc_id, text, {_KIND} AS kind FROM documents),
    t AS (SELECT doc_id, kind, unnest(range(0, CAST(ceil(len(string_split(text, chr(10))) / 12) AS BIGINT))) AS part, string_split(text, chr(10)) AS lines FROM e WHERE kind = 'table')
    SELECT doc_id, kind, concat('p:', doc_id, ':', part) AS id, CAST(NULL AS VARCHAR) AS dedupe_key, md5(array_to_string(lines[part * 12 + 1:part * 12 + 12], chr(10))) AS content FROM t
    UNION ALL SELECT doc_id, kind, concat('p:', doc_id, ':0'), CASE WHEN kind = 'email_body' THEN concat('msg:', md5(text)) END, md5(text) FROM e WHERE kind <> 'table'""",
)
def evidence_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages by kind of evidence: tables in windows of 12 rows, mails as one that copies share, pictures as one each."""
    e = table(spark, sf, "documents").select("doc_id", "text", F.expr(_KIND).alias("kind"))
    lines = F.split("text", "\n")
    windows = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lines) / 12).cast("int") - 1), lambda k: F.array_join(F.slice(lines, k * 12 + 1, 12), "\n"))
    cut = e.select("doc_id", "kind", F.posexplode(F.when(F.col("kind") == "table", windows).otherwise(F.array("text"))).alias("part", "body"))
    key = F.when(F.col("kind") == "email_body", F.concat(F.lit("msg:"), F.md5("body")))
    return cut.select("doc_id", "kind", F.concat(F.lit("p:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("part").cast("string")).alias("id"), key.alias("dedupe_key"), F.md5("body").alias("content"))
