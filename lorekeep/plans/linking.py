"""Known things in all documents: a phrase index out of the benchmark texts, passages with their mentions, facts, versions and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.functions import text
from lorekeep.operators import briefs, linking, retrieval, segments
from lorekeep.plans.registry import query, table
from lorekeep.plans.retrieval import _BM25


def things(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, refers_to): every benchmark text is a thing, called by its first words; later words are its aliases."""
    b = table(spark, sf, "benchmark").where("text is not null").withColumn("w", F.split("text", " "))
    some = lambda start, n: F.array_join(F.slice(F.col("w"), start, n), " ")
    entity = F.concat(F.lit("b"), "item_id")
    kind = F.element_at(F.array(*map(F.lit, ("Customer", "Person", "Term", "Asset", "Vehicle"))), (F.col("item_id") % 5 + 1).cast("int"))
    tail = F.when(F.col("item_id") % 4 == 0, " Inc.").otherwise("")
    entities = b.select(entity.alias("entity"), F.concat(some(F.lit(1), (1 + F.col("item_id") % 3).cast("int")), tail).alias("name"), kind.alias("type"))
    aliases = b.select(entity.alias("entity"), some(F.lit(6), (1 + F.col("item_id") % 9).cast("int")).alias("alias"), F.when(F.col("item_id") % 2 == 0, "nickname").otherwise("spelling").alias("kind"))
    refers = b.where("item_id % 10 = 2").select(entity.alias("term"), F.concat(F.lit("b"), F.col("item_id") - 2).alias("target"))
    return entities, aliases, refers


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[’'']s\b', '', 'g'), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SHORT = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ABBREVIATIONS.items()) + " END"
_EVERYDAY = f"len(list_filter(string_split(phrase, ' '), lambda x: NOT list_contains({_list(rules.EVERYDAY_WORDS)}, x))) = 0"
_CODE = f"regexp_matches(phrase, '{rules.CODE_PHRASE}')"
_INDEX = rf"""b AS (SELECT item_id, concat('b', item_id) AS entity, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
  ent AS (SELECT item_id, entity, concat(array_to_string(w[1:CAST(1 + item_id % 3 AS INT)], ' '), CASE WHEN item_id % 4 = 0 THEN ' Inc.' ELSE '' END) AS name, ['Customer', 'Person', 'Term', 'Asset', 'Vehicle'][CAST(item_id % 5 + 1 AS INT)] AS type FROM b),
  ali AS (SELECT entity, array_to_string(w[6:CAST(6 + item_id % 9 AS INT)], ' ') AS alias, item_id % 2 = 0 AS nick FROM b),
  known AS (SELECT *, CASE WHEN item_id % 10 = 2 THEN concat('b', item_id - 2) END AS target FROM ent WHERE type NOT IN ({str(rules.UNLINKED_TYPES)[1:-1]})),
  nw AS (SELECT *, string_split({_norm('name')}, ' ') AS ws FROM known),
  bare AS (SELECT *, trim(regexp_replace(trim(regexp_replace(name, '\b(llc|inc|co|corp|ltd|company)\.?$', '', 'i')), '[,.]\s*$', '')) AS bare FROM known),
  raw AS (SELECT {_norm('name')} AS phrase, coalesce(target, entity) AS entity, type, target IS NULL AS is_name, type = 'Term' AS is_set, target IS NOT NULL AS strong FROM known
    UNION ALL SELECT {_norm('alias')}, coalesce(target, entity), type, false, type = 'Term' OR nick, target IS NOT NULL OR nick FROM ali JOIN known USING (entity)
    UNION ALL SELECT array_to_string(list_transform(ws, lambda w: coalesce({_SHORT}, w)), ' '), entity, type, false, false, false FROM nw WHERE len(list_filter(ws, lambda w: {_SHORT} IS NOT NULL)) > 0
    UNION ALL SELECT unnest(list_filter(list_transform(ws, lambda w: {_SHORT}), lambda x: x IS NOT NULL)), entity, type, false, false, false FROM nw WHERE len(ws) > 1
    UNION ALL SELECT {_norm('bare')}, entity, type, true, false, false FROM bare WHERE bare <> name),
  fit AS (SELECT *, len(string_split(phrase, ' ')) AS n FROM raw WHERE phrase <> ''),
  held AS (SELECT phrase, n, f.entity, bool_or(strong) AS strong, coalesce(any_value(k.type) <> 'Term', true) AS real FROM fit f LEFT JOIN known k ON k.entity = f.entity
    WHERE n <= {rules.LONGEST_PHRASE} AND (n > 1 OR {_CODE} OR (length(phrase) >= 3 AND NOT {_EVERYDAY})) AND (NOT {_EVERYDAY} OR (is_set AND n > 1)) AND (f.type <> 'Asset' OR NOT is_name OR {_CODE}) GROUP BY ALL),
  decided AS (SELECT phrase, n, CASE WHEN count(*) = 1 THEN min(entity) WHEN count(*) FILTER (WHERE real) = 1 THEN min(entity) FILTER (WHERE real) WHEN count(*) FILTER (WHERE real AND strong) = 1 THEN min(entity) FILTER (WHERE real AND strong) END AS entity FROM held GROUP BY ALL),
  inner_words AS (SELECT unnest(string_split({_norm('name')}, ' ')[2:]) AS phrase FROM ent),
  begins AS (SELECT ws[1] AS phrase, type = 'Person' AS person, count(DISTINCT entity) AS c, min(entity) AS entity FROM nw WHERE type IN ('Person', 'Customer') AND len(ws) > 1 AND NOT list_contains({_list(rules.EVERYDAY_WORDS)}, ws[1]) AND NOT regexp_matches(ws[1], '[0-9]')
    AND length(ws[1]) >= CASE WHEN type = 'Person' THEN 3 ELSE 5 END GROUP BY ALL),
  alone AS (SELECT phrase, max_by(entity, person) AS entity FROM begins WHERE c = 1 AND phrase NOT IN (SELECT phrase FROM inner_words) AND phrase NOT IN (SELECT phrase FROM decided) GROUP BY phrase),
  idx AS (SELECT phrase, n, CASE WHEN entity IN (SELECT entity FROM known) THEN entity END AS entity FROM (SELECT * FROM decided UNION ALL SELECT phrase, 1, entity FROM alone))"""  # fmt: skip


@query("phrase_index", f"WITH {_INDEX} SELECT * FROM idx")
def phrase_index(spark: SparkSession, sf: str) -> DataFrame:
    """What each name, alias, abbreviation and short form means; ambiguous ones mean nothing."""
    return linking.phrase_index(*things(spark, sf)).select("phrase", F.col("n").cast("long").alias("n"), "entity")


_SAID = r"""k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
  s AS (SELECT doc_id, flatten(list_transform(lines, lambda x: CASE WHEN length(x) > 1600 THEN string_split(regexp_replace(x, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)) ELSE [x] END)) AS ps FROM k),
  l AS (SELECT doc_id AS id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM s),
  g AS (SELECT id, i, 0 AS n, length(p) AS open FROM l WHERE i = 1 UNION ALL SELECT l.id, l.i, CASE WHEN open + 1 + length(p) <= 1000 THEN n ELSE n + 1 END, CASE WHEN open + 1 + length(p) <= 1000 THEN open + 1 + length(p) ELSE length(p) END FROM g JOIN l ON l.id = g.id AND l.i = g.i + 1),
  pas AS (SELECT id AS doc_id, n, string_agg(p, chr(10) ORDER BY i) AS content FROM l JOIN g USING (id, i) GROUP BY ALL)"""


@query(
    "passage_projection",
    f"""WITH RECURSIVE {_INDEX}, {_SAID}, tok AS (SELECT doc_id, n, list_filter(string_split({_norm("concat('sheet ', doc_id // 4, chr(10), content)")}, ' '), lambda w: w <> '') AS ws FROM pas),
    pos AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) + 1)) AS spot FROM tok), heads AS (SELECT DISTINCT split_part(phrase, ' ', 1) AS head, n AS size FROM idx),
    cand AS (SELECT doc_id, p.n, spot, size, array_to_string(ws[spot:spot + size - 1], ' ') AS phrase FROM pos p JOIN heads ON head = ws[spot] WHERE spot + size - 1 <= len(ws)),
    hit AS (SELECT doc_id, c.n, spot, max(size) AS size, arg_max(coalesce(entity, ''), size) AS entity FROM cand c JOIN idx USING (phrase) GROUP BY ALL),
    fold AS (SELECT doc_id, n, list_reduce(list(struct_pack(spot := spot, e := spot + size, ids := CASE WHEN entity = '' THEN CAST([] AS VARCHAR[]) ELSE [entity] END) ORDER BY spot),
      lambda a, x: CASE WHEN x.spot >= a.e THEN struct_pack(spot := x.spot, e := x.e, ids := list_concat(a.ids, list_filter(x.ids, lambda y: NOT list_contains(a.ids, y)))) ELSE a END).ids AS ids FROM hit GROUP BY ALL),
    f AS (SELECT doc_id, doc_id // 4 AS fam, doc_id % 4 AS rev, concat('a', doc_id % 5) AS acl, text, doc_id % 7 = 3 AS labelled FROM documents),
    tw AS (SELECT text, list_sort(list(DISTINCT acl)) AS lists FROM f WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1),
    nv AS (SELECT a.doc_id, list(b.doc_id ORDER BY b.doc_id) AS newer FROM f a JOIN (SELECT fam, rev, text, min(doc_id) AS doc_id FROM f WHERE text IS NOT NULL GROUP BY ALL) b ON a.fam = b.fam AND b.rev > a.rev AND b.text <> a.text GROUP BY a.doc_id)
    SELECT p.doc_id, p.n, coalesce(array_to_string(ids, ','), '') AS entity_ids, CASE WHEN p.doc_id % 3 = 0 THEN array_to_string(list_sort(list_distinct([concat('f', p.doc_id % 7), concat('f', p.doc_id % 11)])), ',') ELSE '' END AS facts,
      coalesce(array_to_string(newer, ','), '') AS replaced_by, newer IS NULL AS is_current, CASE WHEN labelled OR lists IS NULL THEN acl ELSE array_to_string(lists, ',') END AS acl_ids
    FROM pas p JOIN f USING (doc_id) LEFT JOIN fold ON fold.doc_id = p.doc_id AND fold.n = p.n LEFT JOIN tw ON tw.text = f.text LEFT JOIN nv ON nv.doc_id = p.doc_id""",
)
def passage_projection(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in passages with what they mention, the facts they carry, newer versions, and who may read them or a copy."""
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("policies/Rate sheet x"), F.floor(F.col("doc_id") / 4), F.lit("y v"), F.col("doc_id") % 4, F.lit(" FINAL (2) March 2024.pdf"))
    files = d.select(F.col("doc_id").alias("file"), path.alias("path"), F.sha2("text", 256).alias("digest"), F.concat(F.lit("a"), F.col("doc_id") % 5).alias("acl"), (F.col("doc_id") % 7 == 3).alias("labelled"))
    facts = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("file"), F.explode(F.array(F.concat(F.lit("f"), F.col("doc_id") % 7), F.concat(F.lit("f"), F.col("doc_id") % 11))).alias("fact"))
    passages = segments.text_passages(d).select(F.col("doc_id").alias("file"), "n", F.concat(F.lit("sheet "), F.floor(F.col("doc_id") / 4)).alias("title"), "content")
    out = linking.project_passages(passages, files, facts, linking.phrase_index(*things(spark, sf)))
    newer = F.array_join(F.transform(F.array_sort(F.transform("replaced_by", lambda f: f.cast("long"))), lambda f: f.cast("string")), ",")
    joined = [F.array_join(c, ",").alias(c) for c in ("entity_ids", "facts")]
    return out.select(F.col("file").alias("doc_id"), "n", *joined, newer.alias("replaced_by"), "is_current", F.array_join("acl_ids", ",").alias("acl_ids"))


_TODAY = "1998-06-01"
_PACK = f"""asked AS (SELECT item_id AS query_id, list_filter(string_split({_norm('text')}, ' '), lambda w: w <> '') AS ws FROM benchmark), qpos AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS spot FROM asked),
  qc AS (SELECT query_id, spot, n, array_to_string(ws[spot:spot + n - 1], ' ') AS phrase FROM qpos JOIN (SELECT DISTINCT split_part(phrase, ' ', 1) AS head, n FROM idx) ON head = ws[spot] WHERE spot + n - 1 <= len(ws)),
  qh AS (SELECT query_id, spot, max(idx.n) AS size, arg_max(coalesce(entity, ''), idx.n) AS entity FROM qc JOIN idx USING (phrase) GROUP BY ALL),
  qf AS (SELECT query_id, list_reduce(list(struct_pack(e := spot + size, spot := spot, ids := CASE WHEN entity = '' THEN CAST([] AS VARCHAR[]) ELSE [entity] END) ORDER BY spot),
    lambda a, x: CASE WHEN x.spot >= a.e THEN struct_pack(e := x.e, spot := x.spot, ids := list_concat(a.ids, list_filter(x.ids, lambda y: NOT list_contains(a.ids, y)))) ELSE a END).ids AS ids FROM qh GROUP BY ALL),
  qn AS (SELECT query_id, unnest(ids) AS entity, unnest(range(1, len(ids) + 1)) AS nth FROM qf), meant AS (SELECT query_id, entity, name, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS nth FROM qn JOIN known USING (entity) WHERE type <> 'Term' QUALIFY nth IS NOT NULL AND row_number() OVER (PARTITION BY query_id ORDER BY qn.nth) <= 3),
  fc AS (SELECT concat('b', o_custkey % 40) AS entity, concat('order ', o_orderkey) AS fact, CAST(o_orderdate AS DATE) AS since, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS until, o_orderkey % 17 = 0 AS disputed FROM orders),
  cur AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY since DESC, fact) AS k FROM fc WHERE until IS NULL OR until >= DATE '{_TODAY}'), old AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY until DESC, fact) AS k FROM fc WHERE until < DATE '{_TODAY}'),
  hit AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 12),
  src AS (SELECT query_id, rank, CASE WHEN doc_id % 3 = 0 THEN concat('Timeline: ', doc_id % 5, ' then ', doc_id % 7, chr(10), text) ELSE text END AS content, concat('sheet ', doc_id // 4) AS title, source AS place, doc_id % 4 = 0 AS fact, doc_id % 6 <> 0 AS is_current, doc_id % 8 = 0 AS disputed FROM hit JOIN documents USING (doc_id))"""


@query(
    "context_pack",
    f"""WITH {_INDEX}, {_BM25}, {_PACK} SELECT query_id, 'source' AS part, rank AS n, concat('[', rank, '] ', title, ' · ', place, ' (', CASE WHEN NOT fact THEN 'Supports' WHEN disputed THEN 'Disputed' WHEN is_current THEN 'Current' ELSE 'Outdated' END, ')', chr(10), substr(content, 1, 900)) AS line FROM src
    UNION ALL SELECT query_id, 'change', min(rank), line FROM (SELECT query_id, rank, concat(title, ': ', substr(string_split(content, chr(10))[1], 11)) AS line FROM src WHERE starts_with(content, 'Timeline: ')) GROUP BY ALL
    UNION ALL SELECT query_id, 'current', nth * 100 + k, concat(name, ': ', fact, ' (since ', strftime(since, '%b %-d, %Y'), ')', CASE WHEN disputed THEN ' [DISPUTED]' ELSE '' END) FROM meant JOIN cur USING (entity) WHERE k <= 25
    UNION ALL SELECT query_id, 'earlier', nth * 100 + k, concat(name, ': ', fact, ' (', strftime(since, '%b %-d, %Y'), ' to ', strftime(until, '%b %-d, %Y'), ')') FROM meant JOIN old USING (entity) WHERE k <= 15""",
)
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    """What an answer to each benchmark question may rest on: its best documents, their timelines, and the facts of the things it names."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    words = asked.select("query_id", F.explode(text.words(F.col("question"))).alias("term")).distinct()
    d = table(spark, sf, "documents")
    found = retrieval.ranked(retrieval.bm25(d, words, "doc_id"), "doc_id", 12)
    k = F.col("doc_id")
    line = F.concat(F.lit("Timeline: "), k % 5, F.lit(" then "), k % 7, F.lit("\n"), "text")
    hits = found.join(d, "doc_id").select("query_id", "rank", F.when(k % 4 == 0, "fact").otherwise("passage").alias("doc_type"), F.concat(F.lit("sheet "), F.floor(k / 4)).alias("title"), F.col("source").alias("place"), (k % 6 != 0).alias("is_current"), (k % 8 == 0).alias("disputed"), F.when(k % 3 == 0, line).otherwise(F.col("text")).alias("content"))
    entities, aliases, refers = things(spark, sf)
    linked = linking.link_phrases(asked, ["query_id"], "question", linking.phrase_index(entities, aliases, refers))
    named = linked.select("query_id", F.posexplode("entity_ids").alias("nth", "entity")).join(entities, "entity")
    o = F.col("o_orderkey")
    since = F.col("o_orderdate").cast("date")
    facts = table(spark, sf, "orders").select(F.concat(F.lit("b"), F.col("o_custkey") % 40).alias("entity"), F.concat(F.lit("order "), o).alias("fact"), since.alias("since"), F.when(F.col("o_orderstatus") == "F", F.date_add(since, (o % 900).cast("int"))).alias("until"), (o % 17 == 0).alias("disputed"))
    return briefs.context_pack(asked, hits, named, facts, _TODAY)
