"""Retrieval plans; questions are the benchmark rows, all answered by one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import retrieval
from lorekeep.plans.registry import query, table
from lorekeep.session import staged

_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
_POSTINGS = f"""w AS (SELECT doc_id, {_WORDS.format(c="text")} AS ws FROM documents), post AS (SELECT doc_id, len(ws) AS length, t.term, count(*) AS tf FROM w, unnest(ws) AS t(term) GROUP BY ALL),
  q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, {_WORDS.format(c="text")} AS ws FROM benchmark), unnest(ws) AS t(term))"""
_BM25 = f"""{_POSTINGS}, sizes AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM (SELECT DISTINCT doc_id, length FROM post)), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM post JOIN q USING (term) JOIN df USING (term), sizes GROUP BY ALL)"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The words of every question: all benchmark rows, whole."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.words(F.col("text")).alias("w"))
    return asked.select("query_id", F.explode("w").alias("term")).distinct()


@query(
    "fulltext_all_then_any",
    f"""WITH {_POSTINGS}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), h AS (SELECT query_id, doc_id, count(*) AS hits FROM q JOIN post USING (term) GROUP BY ALL), f AS (SELECT *, hits = n AS every FROM h JOIN n USING (query_id)), a AS (SELECT query_id, bool_or(every) AS any_all FROM f GROUP BY 1)
    SELECT query_id, CASE WHEN any_all THEN 'all_words' ELSE 'any_word' END AS matched, count(*) AS total FROM f JOIN a USING (query_id) WHERE every OR NOT any_all GROUP BY ALL""",
)
def fulltext_all_then_any(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all words of a question; with any of them where none has all."""
    asked = _questions(spark, sf)
    q = staged(asked.join(asked.groupBy("query_id").agg(F.count("*").alias("n")), "query_id"), "asked")
    hits = retrieval.postings(table(spark, sf, "documents"), "doc_id", q).join(q, "term").groupBy("query_id", "n", "doc_id").agg(F.count("*").alias("hits"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("some"), F.count_if(F.col("hits") == F.col("n")).alias("every"))
    whole = F.col("every") > 0
    return found.select("query_id", F.when(whole, "all_words").otherwise("any_word").alias("matched"), F.when(whole, F.col("every")).otherwise(F.col("some")).alias("total"))


@query("phrase_match", f"WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS ws FROM documents), p AS (SELECT doc_id, generate_subscripts(ws, 1) AS at, unnest(ws) AS term FROM w) SELECT a.doc_id, a.at FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.at - a.at BETWEEN 1 AND 4 WHERE a.term = 'the' AND b.term = 'that' GROUP BY ALL")
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    """Two words near each other: positional postings meet by document and distance."""
    w = table(spark, sf, "documents").select("doc_id", F.posexplode(text.words(F.col("text"))).alias("p", "term")).select("doc_id", (F.col("p") + 1).cast("long").alias("at"), "term")
    a = w.where("term = 'the'").select("doc_id", "at", F.explode(F.array(*[F.col("at") + k for k in range(1, 5)])).alias("near"))
    return a.join(w.where("term = 'that'").select("doc_id", F.col("at").alias("near")), ["doc_id", "near"]).select("doc_id", "at").distinct()


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents per question by BM25."""
    scores = retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf), "doc_id")
    return retrieval.ranked(scores, "doc_id", 10)


_KNN = "k AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(CAST(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS DOUBLE), 5) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that are asked: the rows whose id is divisible by 100."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")
    return e, e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


def _knn(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return retrieval.nearest(*_vectors(spark, sf), n).select("query_id", "doc_id", "score", "rank")


@query("knn_topk", f"WITH {_KNN} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k) WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of each question, exactly."""
    return _knn(spark, sf, 10)


@query(
    "rrf_hybrid",
    f"""WITH {_BM25}, {_KNN}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
)
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Both legs fused by reciprocal ranks."""
    words = retrieval.ranked(retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf), "doc_id"), "doc_id", 100)
    return retrieval.ranked(retrieval.fuse([words, _knn(spark, sf, 100)], "doc_id"), "doc_id", 10)


@query(
    "era_rerank",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.3 WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-15' AND CAST(ts AS DATE) + 10 >= DATE '2024-01-15' THEN 1.6 ELSE 0.45 END ELSE 1.1 END
      WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 1.6 WHEN event_id % 2 = 0 THEN 1.3 ELSE 1.0 END ELSE CASE WHEN event_id % 2 = 1 THEN 1.0 WHEN event_id % 7 = 0 THEN 1.25 ELSE 0.4 END END AS factor FROM events""",
)
def era_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Factors by how a hit's time fits the question's."""
    i, day = F.col("event_id"), F.to_date("ts")
    is_fact = i % 2 == 0
    none = F.lit(None).cast("date")
    factor = retrieval.era_factor(
        F.when(is_fact, "fact").otherwise("passage"), i % 11 == 0, F.when(is_fact, day), F.when(is_fact, F.date_add(day, 10)), day, i % 7 == 0,
        F.when(i % 3 == 0, F.lit("2024-01-15").cast("date")).otherwise(none), i % 3 == 1, F.when(i % 3 == 2, "current"), i % 5 == 0,
    )
    return table(spark, sf, "events").select("event_id", factor.alias("factor"))


@query(
    "retrieval_metrics",
    f"""WITH {_KNN}, r AS (SELECT k.query_id, row_number() OVER (PARTITION BY k.query_id ORDER BY score DESC, k.doc_id) AS rank, a.label = b.label AS good FROM k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.doc_id),
    f AS (SELECT query_id, min(rank) FILTER (WHERE good) AS first, count(*) FILTER (WHERE good AND rank <= 10) AS at10 FROM r GROUP BY 1)
    SELECT count(*) AS questions, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(at10 / 10.0), 6) AS precision_at_10, list_sort(list(first))[CAST(floor(0.5 * count(*)) AS INT) + 1] AS p50 FROM f""",
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reciprocal rank, precision at ten and the middle rank of the first good hit."""
    f = retrieval.first_good(*_vectors(spark, sf), 10)
    middle = F.element_at(F.sort_array(F.collect_list("first")), (F.floor(F.count("*") * 0.5) + 1).cast("int"))
    return f.agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("at") / 10), 6).alias("precision_at_10"), middle.alias("p50"))


@query("restricted_notice", f"WITH {_BM25} SELECT query_id, count(*) FILTER (WHERE locked) AS locked, coalesce(max(score) FILTER (WHERE locked), 0) >= coalesce(max(score) FILTER (WHERE NOT locked), 0) + 1 AS withheld FROM (SELECT s.*, source IN ('src0', 'src1', 'src2') AS locked FROM s JOIN documents USING (doc_id)) GROUP BY query_id")
def restricted_notice(spark: SparkSession, sf: str) -> DataFrame:
    """How many matches a reader may not see, and whether one of them is clearly the best."""
    scores = retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf), "doc_id")
    s = scores.join(table(spark, sf, "documents").select("doc_id", F.col("source").isin("src0", "src1", "src2").alias("locked")), "doc_id")
    best = lambda c: F.coalesce(F.max(F.when(c, F.col("score"))), F.lit(0.0))
    return s.groupBy("query_id").agg(F.count_if("locked").alias("locked"), (best(F.col("locked")) >= best(~F.col("locked")) + 1).alias("withheld"))


_MISSPELT = "list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w, i: CASE WHEN length(w) >= 6 AND i % 3 = 0 THEN concat(substr(w, 1, 2), substr(w, 4)) ELSE w END)"
_FIELD = """{f}_d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({f}), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM doc), {f}_p AS (SELECT doc_id, len(ws) AS length, t.term, count(*) AS tf FROM {f}_d, unnest(ws) AS t(term) GROUP BY ALL),
  {f}_s AS (SELECT doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS score FROM {f}_p JOIN (SELECT term, count(*) AS df FROM {f}_p GROUP BY term) USING (term), (SELECT count(*) AS n_docs, avg(len(ws)) AS mean_length FROM {f}_d WHERE len(ws) > 0)),
  {f}_e AS (SELECT query_id, doc_id, sum(score) AS score FROM q JOIN {f}_s USING (term) GROUP BY ALL)"""
_FUZZY = """{f}_n AS (SELECT a.term AS asked, v.term, 1 - levenshtein(a.term, v.term) / least(length(a.term), length(v.term)) AS weight FROM (SELECT DISTINCT term FROM q) a JOIN (SELECT DISTINCT term FROM {f}_p) v ON left(a.term, 1) = left(v.term, 1) AND abs(length(a.term) - length(v.term)) <= 2
    AND levenshtein(a.term, v.term) <= CASE WHEN length(a.term) < 3 THEN 0 WHEN length(a.term) < 6 THEN 1 ELSE 2 END),
  {f}_z AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, asked, doc_id, max(s.score * weight) AS score FROM q JOIN {f}_n ON asked = q.term JOIN {f}_s s ON s.term = {f}_n.term GROUP BY ALL) GROUP BY ALL)"""


@query(
    "bm25_fields",
    f"""WITH doc AS (SELECT doc_id, text AS content, array_to_string(string_split(text, ' ')[1:5], ' ') AS title, concat(source, '/', lang, '/sheet ', doc_id % 50) AS path FROM documents),
    q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, {_MISSPELT} AS ws FROM benchmark), unnest(ws) AS t(term)), {", ".join(_FIELD.format(f=f) for f in ("title", "content", "path"))}, {", ".join(_FUZZY.format(f=f) for f in ("title", "content"))},
    x AS (SELECT query_id, doc_id, max(score) + 0.3 * (sum(score) - max(score)) AS score FROM (SELECT query_id, doc_id, 2 * score AS score FROM title_e UNION ALL SELECT * FROM content_e UNION ALL SELECT query_id, doc_id, 0.5 * score FROM path_e) GROUP BY ALL),
    z AS (SELECT query_id, doc_id, 0.3 * max(score) AS score FROM (SELECT * FROM title_z UNION ALL SELECT * FROM content_z) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM z) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def bm25_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents per misspelt question over title, text and path: the best field counts most, near words a little."""
    title = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), title.alias("title"), F.concat("source", F.lit("/"), "lang", F.lit("/sheet "), F.col("doc_id") % 50).alias("path"))
    misspelt = F.transform(text.words(F.col("text")), lambda w, i: F.when((F.length(w) >= 6) & ((i + 1) % 3 == 0), F.concat(F.substring(w, 1, 2), F.substring(w, 4, 1 << 20))).otherwise(w))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(misspelt).alias("term"))
    found = retrieval.field_search(d, asked, "doc_id", {"title": 2.0, "content": 1.0, "path": 0.5}, ["title", "content"])
    return retrieval.ranked(found, "doc_id", 10).withColumn("score", F.round("score", 4))
