"""Landed files: paths, shapes, dates, routes, folder trees and how far their processing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.operators.closure import top_ancestors
from lorekeep.plans.registry import query, table

_PATH = r"CASE page_id % 3 WHEN 0 THEN replace(url, '/', chr(92)) WHEN 1 THEN concat('./', url, '/.') ELSE CASE WHEN page_id % 7 = 0 THEN concat('../', url) ELSE url END END"


def normal_path(c: Column) -> Column:
    """Slashes one way, empty and '.' segments dropped; null where nothing is left or '..' occurs."""
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


@query(
    "object_paths",
    rf"""WITH p AS (SELECT page_id, list_filter(string_split(replace({_PATH}, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.') AS parts FROM pages)
    SELECT page_id, CASE WHEN len(parts) > 0 AND NOT list_contains(parts, '..') THEN array_to_string(parts, '/') END AS path FROM p""",
)
def object_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Object keys from delivered paths; paths that climb are refused."""
    return table(spark, sf, "pages").select("page_id", normal_path(F.expr(_PATH)).alias("path"))


def delimiter_of(text: Column) -> Column:
    """The delimiter of the first 20 filled lines: as often outside quotes in 80 % of them as in the first; null for prose."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"\S")), 1, 20)
    bare = F.transform(lines, lambda x: F.regexp_replace(x, '"[^"]*("|$)', ""))

    def fits(d: str) -> Column:
        counts = F.transform(bare, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        first = F.element_at(counts, 1)
        return (first >= 1) & (F.size(F.filter(counts, lambda n: n == first)) >= F.ceil(F.size(lines) * 0.8))

    found = F.coalesce(*(F.when(fits(d), F.lit(d)) for d in rules.DELIMITERS))
    return F.when(F.size(lines) >= 2, found)


_ROW = "concat('\"a,b\"', d, l_partkey, CASE WHEN l_linenumber = 6 THEN '' ELSE concat(d, l_suppkey) END)"
_DELIMITER = "CASE l_orderkey % 5 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' WHEN 3 THEN '|' ELSE ' ' END"


@query(
    "delimited_texts",
    rf"""WITH f AS (SELECT l_orderkey, string_agg({_ROW}, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM (SELECT *, {_DELIMITER} AS d FROM lineitem) GROUP BY l_orderkey),
    l AS (SELECT l_orderkey, list_slice(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '\S')), 1, 20) AS lines FROM f),
    d AS (SELECT l_orderkey, len(lines) AS n, unnest([',', chr(9), ';', '|']) AS d, unnest([1, 2, 3, 4]) AS o, lines FROM l),
    c AS (SELECT l_orderkey, n, d, o, list_transform(lines, lambda x: length(regexp_replace(x, '"[^"]*("|$)', '', 'g')) - length(replace(regexp_replace(x, '"[^"]*("|$)', '', 'g'), d, ''))) AS k FROM d WHERE n >= 2)
    SELECT l_orderkey, arg_min(d, o) AS delimiter FROM c WHERE k[1] >= 1 AND len(list_filter(k, lambda v: v = k[1])) >= ceil(n * 0.8) GROUP BY l_orderkey""",
)
def delimited_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose lines are delimited rows, with the delimiter; quoted delimiters don't count, ragged rows may be a fifth."""
    rows = table(spark, sf, "lineitem").withColumn("d", F.expr(_DELIMITER)).withColumn("row", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(_ROW).alias("line")))
    files = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), "\n").alias("text"))
    return files.select("l_orderkey", delimiter_of(F.col("text")).alias("delimiter")).where("delimiter is not null")


@query("calendar_profile", "SELECT user_id, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY user_id")
def calendar_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of calendar files and the days that they begin on; one file per user is written first and read back as text."""
    entry = F.concat(F.lit("BEGIN:VEVENT\r\nDTSTART;VALUE=DATE:"), F.date_format("ts", "yyyyMMdd"), F.lit("T000000Z\r\nEND:VEVENT\r\n"))
    files = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.collect_list(entry), "").alias("ics"))
    days = F.transform(F.regexp_extract_all("ics", F.lit(r"DTSTART[^:\r\n]*:(\d{8})"), 1), lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))
    return files.select("user_id", F.regexp_count("ics", F.lit("BEGIN:VEVENT")).cast("long").alias("n_events"), F.array_min(days).alias("first_day"), F.array_max(days).alias("last_day"))


_FILE = """o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'landed 2024-02-03' WHEN o_orderkey % 5 = 1 THEN 'first' END AS batch,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('scans/', substr(CAST(o_orderdate AS string), 1, 10), '/', o_orderpriority) WHEN o_orderkey % 3 = 1 THEN 'notes/2031-1-2.txt' ELSE 'a.txt' END AS path,
    CASE WHEN o_orderkey % 2 = 0 THEN concat(substr(CAST(o_orderdate AS string), 1, 10), 'T08:00:00Z') END AS captured, CASE WHEN o_custkey % 4 > 0 THEN '2019-05-06 10:00' END AS modified"""


@query(
    "availability_dates",
    rf"""WITH f AS (SELECT {_FILE} FROM orders)
    SELECT o_orderkey, coalesce(nullif(regexp_extract(batch, '(20\d\d-\d\d-\d\d)', 1), ''), nullif(regexp_extract(path, '(20\d\d-\d\d-\d\d)', 1), ''), substr(captured, 1, 10), substr(modified, 1, 10)) AS available FROM f""",
)
def availability_dates(spark: SparkSession, sf: str) -> DataFrame:
    """When a file became available: its batch's date, else the one in its path, else its capture, else its change."""
    day = lambda c: F.when(F.col(c).rlike(rules.DAY_IN_PATH), F.regexp_extract(c, rules.DAY_IN_PATH, 1))
    files = table(spark, sf, "orders").selectExpr(*_split(_FILE))
    return files.select("o_orderkey", F.coalesce(day("batch"), day("path"), F.substring("captured", 1, 10), F.substring("modified", 1, 10)).alias("available"))


def _split(columns: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


@query(
    "top_ancestors",
    """WITH RECURSIVE n AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 AND turn % 4 > 0 THEN conv_id * 100 + turn - 1 END AS parent FROM conversations),
    up AS (SELECT id, id AS cur, 0 AS hops FROM n UNION ALL SELECT up.id, n.parent, hops + 1 FROM up JOIN n ON n.id = up.cur WHERE n.parent IN (SELECT id FROM n) AND hops < 10)
    SELECT id, arg_max(cur, hops) AS top FROM up GROUP BY id""",
)
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Each unpacked file's top-level file, whose path and date it takes over."""
    node = F.col("conv_id") * 100 + F.col("turn")
    files = table(spark, sf, "conversations").select(node.alias("id"), F.when((F.col("turn") > 0) & (F.col("turn") % 4 > 0), node - 1).alias("parent"))
    return top_ancestors(files, "id", "parent")


@query(
    "folder_tree",
    """WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages)
    SELECT split_part(path, '/', 1) AS top, CASE WHEN path LIKE '%/%/%' THEN split_part(path, '/', 2) END AS sub, count(*) AS files FROM p GROUP BY 1, 2""",
)
def folder_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Files per folder, two levels deep."""
    p = table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    part = lambda k: F.split_part("path", F.lit("/"), F.lit(k))
    return p.groupBy(part(1).alias("top"), F.when(F.col("path").like("%/%/%"), part(2)).alias("sub")).agg(F.count("*").alias("files"))


@query(
    "extraction_routes",
    """SELECT page_id, CASE WHEN e IN ('pdf', 'docx', 'pptx') THEN 'document' WHEN e IN ('csv', 'xlsx') THEN 'table' WHEN e IN ('text', 'markdown', 'html', 'rtf', 'ics') THEN 'text' WHEN e = 'mbox' THEN 'mailbox' WHEN e = 'eml' THEN 'email'
      WHEN e IN ('jpeg', 'png', 'gif', 'heic') THEN 'image' WHEN e IN ('mp3', 'wav') THEN 'audio' WHEN e IN ('mp4', 'quicktime') THEN CASE WHEN page_id % 2 = 0 THEN 'audio' ELSE 'video' END END AS route
    FROM (SELECT page_id, ['pdf', 'csv', 'html', 'mbox', 'eml', 'heic', 'wav', 'mp4', 'zip', 'quicktime', 'rtf'][CAST(page_id % 11 AS INT) + 1] AS e FROM pages)""",
)
def extraction_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Which reader a file's format goes to; media files of sound alone go to the sound reader, archives and unknown ones to none."""
    kinds = F.array(*map(F.lit, ["pdf", "csv", "html", "mbox", "eml", "heic", "wav", "mp4", "zip", "quicktime", "rtf"]))
    files = table(spark, sf, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % 11 + 1).cast("int")).alias("format"), F.when(F.col("page_id") % 2 == 0, "audio").otherwise("video").alias("category"))
    known = F.create_map(*(F.lit(x) for route, formats in rules.ROUTES.items() for f in formats for x in (f, route)))
    route = F.try_element_at(known, F.col("format"))
    return files.select("page_id", F.when((route == "video") & (F.col("category") == "audio"), "audio").otherwise(route).alias("route"))


@query(
    "run_progress",
    """SELECT o_orderkey AS run, count(l_orderkey) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS done, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
      count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) AS pending FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of each run by state; runs without steps stay."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    state = F.col("l_returnflag")
    steps = li.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(state == "A").alias("done"), F.count_if(state == "R").alias("failed"), F.count_if(~state.isin("A", "R")).alias("pending"))
    joined = o.join(steps, o["o_orderkey"] == steps["l_orderkey"], "left")
    return joined.select(F.col("o_orderkey").alias("run"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "done", "failed", "pending")))


@query(
    "extraction_status",
    """SELECT count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) AS extracted,
      count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) AS skipped,
      count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS waiting FROM customer""",
)
def extraction_status(spark: SparkSession, sf: str) -> DataFrame:
    """Files by what their versions have come to; a file may count under several."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.agg(F.count("*").alias("total"), F.count_if("f").alias("extracted"), F.count_if("p").alias("skipped"), F.count_if(F.col("o_custkey").isNull()).alias("waiting"))


@query(
    "workflow_stages",
    """SELECT 'landed' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(DISTINCT d.doc_id) FROM documents d JOIN labels USING (doc_id)
    UNION ALL SELECT 'good', count(DISTINCT d.doc_id) FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND coalesce(toxic, 0) = 0""",
)
def workflow_stages(spark: SparkSession, sf: str) -> DataFrame:
    """How many files each stage of the work has."""
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    marks = lab.groupBy("doc_id").agg(F.bool_or((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    row = d.join(marks.withColumn("labelled", F.lit(True)), "doc_id", "left").agg(
        F.count("*").alias("landed"), F.count_distinct(F.when(F.col("labelled"), F.col("doc_id"))).alias("labelled"), F.count_distinct(F.when(F.col("good"), F.col("doc_id"))).alias("good")
    )
    return row.unpivot([], ["landed", "labelled", "good"], "stage", "n")


@query("keyset_page", "SELECT doc_id, source FROM documents WHERE doc_id > 300 ORDER BY doc_id LIMIT 256")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The next page behind a key: the filter reaches the scan, and only a page is sorted out of each task."""
    return table(spark, sf, "documents").where("doc_id > 300").orderBy("doc_id").limit(256).select("doc_id", "source")


@query(
    "touch_or_embed",
    """WITH old AS (SELECT doc_id, md5(text) AS content, source AS acl FROM documents WHERE doc_id % 5 > 0),
    new AS (SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN concat(text, '!') ELSE text END) AS content, CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS acl FROM documents WHERE doc_id % 7 > 0)
    SELECT doc_id, CASE WHEN new.content IS NULL THEN 'delete' WHEN old.content IS NULL OR old.content <> new.content THEN 'embed' WHEN old.acl <> new.acl THEN 'touch' ELSE 'keep' END AS action
    FROM old FULL JOIN new USING (doc_id)""",
)
def touch_or_embed(spark: SparkSession, sf: str) -> DataFrame:
    """What a refresh does to each indexed row: new content is embedded, a new reader list only touched."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 5 > 0").select("doc_id", F.md5("text").alias("was"), F.col("source").alias("acl_was"))
    new = d.where("doc_id % 7 > 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"), F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")).alias("acl_now"))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "embed").when(F.col("acl_was") != F.col("acl_now"), "touch").otherwise("keep")
    return old.join(new, "doc_id", "full").select("doc_id", action.alias("action"))
