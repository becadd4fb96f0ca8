"""Names, questions, citations and dates as the record words them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.operators.load import name_fits
from lorekeep.plans.registry import query, table


@query("alias_keys", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS alias FROM documents")
def alias_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases as they are compared: lower case, single blanks."""
    return table(spark, sf, "documents").select("doc_id", text.squeeze(F.lower("text")).alias("alias"))


_NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT concat(substr(p_name, 1, 1), ' ', split_part(p_name, ' ', 2)) FROM part UNION SELECT DISTINCT concat(substr(p_name, 1, 1), substr(split_part(p_name, ' ', 2), 1, 1)) FROM part"


@query(
    "name_fits",
    rf"""WITH n AS ({_NAMES}), s AS (SELECT name, replace(name, ' ', '') AS q, split_part(name, ' ', 1) AS f FROM n)
    SELECT a.name AS a, b.name AS b, (length(a.f) >= 2 AND a.f = b.f) OR regexp_matches(b.q, concat('.*', array_to_string(regexp_extract_all(a.q, '.'), '.*'), '.*'))
      OR regexp_matches(a.q, concat('.*', array_to_string(regexp_extract_all(b.q, '.'), '.*'), '.*'))
      OR (a.name LIKE '% %' AND split_part(a.name, ' ', -1) = split_part(b.name, ' ', -1) AND substr(a.name, 1, 1) = substr(b.name, 1, 1)) AS fits
    FROM s a JOIN s b ON substr(a.name, 1, 1) = substr(b.name, 1, 1) AND a.name < b.name""",
)
def fitting_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names, initials and short forms that begin alike, and whether they could name one person."""
    n = _names(table(spark, sf, "part"))
    pairs = n.select(F.col("name").alias("a"), F.substring("name", 1, 1).alias("k")).join(n.select(F.col("name").alias("b"), F.substring("name", 1, 1).alias("k")), "k").where("a < b")
    return pairs.select("a", "b", name_fits(F.col("a"), F.col("b"), person=True).alias("fits"))


def _names(part: DataFrame) -> DataFrame:
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    forms = F.array("p_name", F.concat(F.substring("p_name", 1, 1), F.lit(" "), second), F.concat(F.substring("p_name", 1, 1), F.substring(second, 1, 1)))
    return part.select(F.explode(forms).alias("name")).distinct()


@query(
    "trigram_similarity",
    r"""WITH w AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS noun FROM part UNION SELECT DISTINCT concat(p_name, 's'), split_part(p_name, ' ', 2) FROM part),
    t AS (SELECT name, noun, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr(concat('  ', x, ' '), CAST(i AS INT), 3))))) AS g FROM w)
    SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity
    FROM t a JOIN t b ON a.noun = b.noun AND a.name < b.name WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.3""",
)
def trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one noun by the share of common trigrams of their words, 0.3 and more."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    forms = table(spark, sf, "part").select(F.explode(F.array("p_name", F.concat("p_name", F.lit("s")))).alias("name"), noun.alias("noun")).distinct().withColumn("g", text.word_trigrams(F.col("name")))
    side = lambda s: forms.select("noun", F.col("name").alias(s), F.col("g").alias(f"g{s}"))
    pairs = side("a").join(side("b"), "noun").where("a < b").withColumn("similarity", F.round(text.jaccard(F.col("ga"), F.col("gb")), 6))
    return pairs.where("similarity >= 0.3").select("a", "b", "similarity")


_OPENERS = rf"({rules.QUESTION_OPENERS})"
_ASKED = "concat(text, CASE turn % 3 WHEN 0 THEN '? Who signs it' WHEN 1 THEN ', and what are their terms' ELSE '; then we stop' END, '?')"


def question_parts(c: Column) -> Column:
    """The questions of a compound one, three at most; parts under three words don't count, and one part is none."""
    cut = F.regexp_replace(c, r"\?\s+(\S)", "\u0001$1")
    cut = F.regexp_replace(F.regexp_replace(cut, r";\s+", "\u0001"), rf"(?i),?\s+(?:{rules.QUESTION_JOINERS})\s+({rules.QUESTION_OPENERS})\b", "\u0001$1")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), lambda p: F.regexp_replace(F.trim(p), r"\?$", "")), lambda p: F.size(F.split(p, r"\s+")) >= 3)
    return F.when(F.size(parts) < 2, F.array(c)).otherwise(F.transform(F.slice(parts, 1, 3), lambda p: F.concat(p, F.lit("?"))))


@query(
    "question_parts",
    rf"""WITH q AS (SELECT conv_id, turn, {_ASKED} AS q FROM conversations WHERE role = 'user'),
    c AS (SELECT conv_id, turn, q, regexp_replace(regexp_replace(regexp_replace(q, '\?\s+(\S)', concat(chr(1), '\1'), 'g'), ';\s+', chr(1), 'g'), '(?i),?\s+(?:{rules.QUESTION_JOINERS})\s+{_OPENERS}\b', concat(chr(1), '\1'), 'g') AS cut FROM q),
    p AS (SELECT conv_id, turn, q, list_filter(list_transform(string_split(cut, chr(1)), lambda p: regexp_replace(trim(p), '\?$', '')), lambda p: len(regexp_split_to_array(p, '\s+')) >= 3) AS parts FROM c)
    SELECT conv_id, turn, CASE WHEN len(parts) < 2 THEN [q] ELSE list_transform(parts[1:3], lambda p: concat(p, '?')) END AS parts FROM p""",
)
def compound_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Users' questions, cut where a second one begins."""
    q = table(spark, sf, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", question_parts(F.expr(_ASKED)).alias("parts"))


@query("mail_bodies", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE concat('Fro: x', chr(10), chr(10), text) END AS body FROM conversations")
def mail_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Mail texts without the header block that lists everyone."""
    head = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("From: "), "role", F.lit("\nTo: all\n\n"))).otherwise(F.lit("Fro: x\n\n"))
    mail = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("content"))
    body = F.when(F.col("content").startswith("From: "), F.expr("substr(content, locate('\n\n', content) + 2)")).otherwise(F.col("content"))
    return mail.select("conv_id", "turn", body.alias("body"))


@query(
    "citations",
    """SELECT l_orderkey, l_linenumber, concat('orders/', l_orderkey, '.csv', CASE WHEN l_linenumber % 2 = 0 THEN concat(', p. ', l_linenumber) ELSE '' END, CASE WHEN l_returnflag = 'R' THEN ', sheet "Returns"' ELSE '' END,
      ', rows ', l_linenumber, '–', l_linenumber + 11, CASE WHEN l_linestatus = 'O' THEN ', § Open > Lines' ELSE '' END,
      CASE WHEN l_linenumber % 3 = 0 THEN concat(', ', l_linenumber, ':05', CASE WHEN l_linenumber % 2 = 0 THEN concat('–', l_linenumber + 1, ':05') ELSE '' END) ELSE '' END,
      CASE WHEN l_returnflag = 'A' THEN concat(', sent ', strftime(l_shipdate, '%Y-%m-%d')) ELSE '' END) AS cite FROM lineitem""",
)
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Where evidence stands, in one line: file, page, sheet, rows, section, time span, day sent."""
    n = F.col("l_linenumber")
    clock = lambda ms: F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad(F.floor(ms / 1000 % 60).cast("string"), 2, "0"))
    e = table(spark, sf, "lineitem").select(
        "l_orderkey", n,
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".csv")).alias("path"),
        F.when(n % 2 == 0, n).alias("page"),
        F.when(F.col("l_returnflag") == "R", "Returns").otherwise("CSV").alias("sheet"),
        F.when(F.col("l_linestatus") == "O", F.array(F.lit("Open"), F.lit("Lines"))).otherwise(F.array().cast("array<string>")).alias("section"),
        F.when(n % 3 == 0, n * 60000 + 5000).alias("from"),
        F.when(n % 6 == 0, (n + 1) * 60000 + 5999).alias("to"),
        F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("sent"),
    )
    parts = [
        F.col("path"), F.concat(F.lit("p. "), F.col("page").cast("string")), F.when(F.col("sheet") != "CSV", F.concat(F.lit('sheet "'), "sheet", F.lit('"'))),
        F.concat(F.lit("rows "), n.cast("string"), F.lit("–"), (n + 11).cast("string")), F.when(F.size("section") > 0, F.concat(F.lit("§ "), F.array_join("section", " > "))),
        F.concat_ws("–", clock(F.col("from")), clock(F.col("to"))), F.concat(F.lit("sent "), F.date_format("sent", "yyyy-MM-dd")),
    ]
    named = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return e.select("l_orderkey", "l_linenumber", F.array_join(named, ", ").alias("cite"))


def message_line(header: Column, row: Column) -> Column:
    """A row of a message log as "time sender: text"; null where the header is none of a log."""
    names = F.transform(F.split(header, r" \| "), lambda c: F.lower(F.trim(c)))
    cells = F.split(row, r" \| ")
    at = lambda pattern: F.array_position(F.transform(names, lambda c: c.rlike(pattern)), F.lit(True)).cast("int")
    body, who, when = at(rules.LOG_TEXT), at(rules.LOG_SENDER), at(rules.LOG_TIME)
    cell = lambda k: F.trim(F.coalesce(F.try_element_at(cells, F.when(k > 0, k)), F.lit("")))
    return F.when((body > 0) & (who > 0) & (when > 0), F.trim(F.concat(F.substring(cell(when), 1, 16), F.lit(" "), cell(who), F.lit(": "), cell(body))))


@query(
    "message_log",
    r"""SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN trim(concat('2024-03-0', 1 + turn % 9, ' 08:10 ', role, ': ', trim(regexp_replace(text, '[|\s]+', ' ', 'g')))) END AS line FROM conversations""",
)
def message_log(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of exported chats in any order of columns."""
    t, day = F.trim(F.regexp_replace("text", r"[|\s]+", " ")), F.concat(F.lit("2024-03-0"), (1 + F.col("turn") % 9).cast("string"), F.lit(" 08:10:59"))
    kind = F.col("turn") % 3
    header = F.when(kind == 0, "Date Sent | Sender_Name | Message Text").when(kind == 1, " body | From | x | Timestamp").otherwise("Sender | Amount | Date")
    row = F.when(kind == 0, F.concat_ws(" | ", day, "role", t)).when(kind == 1, F.concat_ws(" | ", t, "role", F.lit("-"), day)).otherwise(F.concat_ws(" | ", "role", t, day))
    return table(spark, sf, "conversations").select("conv_id", "turn", message_line(header, row).alias("line"))


@query(
    "asked_stems",
    rf"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark)
    SELECT item_id, list_sort(list(DISTINCT substr(regexp_replace(lower(w), '[^a-z0-9]', '', 'g'), 1, 5))) AS stems FROM w
    WHERE length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) >= 4 AND regexp_replace(lower(w), '[^a-z]', '', 'g') NOT IN ({", ".join(f"'{x}'" for x in rules.ASKING_STOP_WORDS)}) GROUP BY item_id""",
)
def asked_stems(spark: SparkSession, sf: str) -> DataFrame:
    """What a question asks for: stems of its telling words."""
    words = F.filter(F.split("text", r"\s+"), lambda w: (F.length(F.regexp_replace(w, "[^A-Za-z0-9]", "")) >= 4) & ~F.regexp_replace(F.lower(w), "[^a-z]", "").isin(rules.ASKING_STOP_WORDS))
    stems = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(F.regexp_replace(F.lower(w), "[^a-z0-9]", ""), 1, 5))))
    return table(spark, sf, "benchmark").select("item_id", stems.alias("stems")).where(F.size("stems") > 0)


@query(
    "abbreviations",
    "SELECT DISTINCT concat(p_name, CASE p_size % 4 WHEN 0 THEN ' OT' WHEN 1 THEN ' - QC' WHEN 2 THEN ' WO' ELSE '' END) AS name, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' overtime' WHEN 1 THEN ' quality control' WHEN 2 THEN ' work order' ELSE '' END) AS phrase FROM part",
)
def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases with their abbreviations written out."""
    tail = F.when(F.col("p_size") % 4 == 0, " OT").when(F.col("p_size") % 4 == 1, " - QC").when(F.col("p_size") % 4 == 2, " WO").otherwise("")
    known = F.create_map(*(F.lit(x) for pair in rules.ABBREVIATIONS.items() for x in pair))
    n = table(spark, sf, "part").select(F.concat("p_name", tail).alias("name")).distinct()
    spelled = F.transform(F.split(text.normalize_phrase(F.col("name")), " "), lambda t: F.coalesce(F.try_element_at(known, t), t))
    return n.select("name", F.array_join(spelled, " ").alias("phrase"))


@query("event_date_layouts", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS day FROM events")
def event_date_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Days of events that systems write in three layouts; anything else is none."""
    layout = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "M/d/yyyy")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "M/d/yy")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    e = table(spark, sf, "events").select("event_id", layout.alias("d"))
    day = F.when(F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.substring("d", 1, 10))).when(F.col("d").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.to_date("d", "M/d/yyyy")).when(F.col("d").rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.to_date("d", "M/d/yy"))
    return e.select("event_id", day.alias("day"))


@query("partial_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Years and months as their first day."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MMM yyyy")).alias("d"))
    whole = F.concat("d", F.substring(F.lit("-01-01"), 1, 10))
    return said.select("o_orderkey", F.when(F.col("d").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.when(F.length("d") == 4, whole).when(F.length("d") == 7, F.concat("d", F.lit("-01"))).otherwise(F.col("d"))).alias("day"))


@query(
    "client_now",
    """SELECT greatest(TIMESTAMP '1998-06-01 00:00:00', (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '1999-06-01 00:00:00'), (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01 00:00:00')) AS now""",
)
def client_now(spark: SparkSession, sf: str, now: str = "1998-06-01 00:00:00") -> DataFrame:
    """The client's present: the clock, or the latest evidence and fact of up to a year ahead of it."""
    clock = F.to_timestamp(F.lit(now))
    latest = lambda name, c: table(spark, sf, name).where(F.col(c) < clock + F.expr("INTERVAL 1 YEAR")).agg(F.max(c).alias(c))
    both = latest("events", "ts").crossJoin(latest("orders", "o_orderdate"))  # one row each
    return both.select(F.greatest(clock, F.col("ts").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("now"))


@query(
    "anchor_dates",
    """WITH f AS (SELECT o_custkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey, CAST(o_orderdate AS DATE) - CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS as_of FROM customer LEFT JOIN f ON o_custkey = c_custkey AND rn = 1 AND o_orderpriority = CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END""",
)
def anchor_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The day that "before X" or "after X" means: X is dated by the latest fact of its subject that states it; before is a day less."""
    facts = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey", F.col("o_orderpriority").alias("event")).agg(F.max("o_orderdate").alias("at"))
    asked = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").otherwise("2-HIGH").alias("event"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0).alias("back"))
    dated = asked.join(facts, (F.col("c_custkey") == F.col("o_custkey")) & (asked["event"] == facts["event"]), "left")
    return dated.select("c_custkey", F.date_sub(F.to_date("at"), F.col("back")).alias("as_of"))


@query(
    "property_merge",
    """WITH p AS (SELECT c_nationkey AS g, c_custkey, unnest(['segment', 'name', concat('k', c_custkey % 3)]) AS k, unnest([c_mktsegment, c_name, c_name]) AS v FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY c_custkey) AS rn FROM p)
    SELECT g, string_agg(concat(k, '=', v), ';' ORDER BY k) AS properties FROM r WHERE rn = 1 GROUP BY g""",
)
def property_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of merged entities: the survivor's own value wins, then the others' in order."""
    own = F.map_from_arrays(F.array(F.lit("segment"), F.lit("name"), F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string"))), F.array("c_mktsegment", "c_name", "c_name"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey", F.explode(own).alias("k", "v"))
    first = rows.groupBy("g", "k").agg(F.min_by("v", "c_custkey").alias("v"))  # the survivor has the smallest key
    merged = first.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p"))
    return merged.select("g", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["k"], x["v"])), ";").alias("properties"))


@query("json_merge", """SELECT event_id, CAST(props->>'k' AS INT) AS k, event_type AS t, CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'early' END AS s FROM events""")
def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two JSON objects as one, the right one's values last."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    right = F.to_json(F.struct(F.col("event_type").alias("t"), F.when(F.col("event_id") % 2 == 0, F.lit("late")).alias("s")))
    left = F.to_json(F.map_from_entries(F.concat(F.map_entries(as_map("props")), F.map_entries(F.create_map(F.lit("s"), F.lit("early"))))))
    kept = F.map_filter(as_map(left), lambda k, v: ~F.array_contains(F.map_keys(as_map(right)), k))
    both = table(spark, sf, "events").select("event_id", F.map_concat(kept, as_map(right)).alias("m"))
    return both.select("event_id", F.col("m")["k"].cast("int").alias("k"), F.col("m")["t"].alias("t"), F.col("m")["s"].alias("s"))


@query(
    "text_blocks",
    r"""SELECT conv_id, turn, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS text, concat('Talk ', conv_id, ' > Turn ', turn, CASE WHEN turn % 2 = 1 THEN ' > Note' ELSE '' END) AS path FROM (SELECT conv_id, turn, regexp_replace(text, '[\s#]+', ' ', 'g') AS text FROM conversations) WHERE trim(text) <> ''""",
)
def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of marked-down texts with the headings over them; a heading ends those of its level and below."""
    body = F.regexp_replace("text", r"[\s#]+", " ")
    part = F.concat(F.lit("\n\n## Turn "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 1, "\r\n\r\n#### Note").otherwise(""), F.lit("\n \n"), body)
    turns = table(spark, sf, "conversations").withColumn("part", F.struct("turn", part.alias("md")))
    files = turns.groupBy("conv_id").agg(F.concat(F.lit("# Talk "), F.col("conv_id").cast("string"), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["md"]), "")).alias("md"))
    blocks = files.select("conv_id", F.posexplode(F.split(F.replace("md", F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")).alias("at", "raw")).withColumn("t", F.trim("raw")).where("t <> ''")
    level = F.when(~F.col("t").contains("\n"), F.length(F.regexp_extract("t", r"^(#{1,6})\s+\S", 1))).otherwise(0)
    marked = blocks.withColumn("level", level).withColumn("head", F.regexp_extract("t", r"^#{1,6}\s+(.+)$", 1))
    order = Window.partitionBy("conv_id").orderBy("at")
    last = lambda test, c: F.last(F.when(test, F.col(c)), ignorenulls=True).over(order)
    for k in range(1, 7):
        marked = marked.withColumn(f"h{k}", last(F.col("level") == k, "head")).withColumn(f"p{k}", last(F.col("level") == k, "at")).withColumn(f"above{k}", last((F.col("level") > 0) & (F.col("level") < k), "at"))
    path = F.concat_ws(" > ", *(F.when(F.col(f"above{k}").isNull() | (F.col(f"p{k}") > F.col(f"above{k}")), F.col(f"h{k}")) for k in range(1, 7)))
    named = marked.where("level = 0").select("conv_id", F.regexp_extract(path, r"> Turn (\d+)", 1).cast("long").alias("turn"), F.col("t").alias("text"), path.alias("path"))
    return named
