"""Steps whose work must grow with their input, on inputs where it once grew with its square."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import aliases, facts, grants, linking, reading, retrieval


def test_best_window_of_a_long_text(spark):
    asked = ["the", "that", "with", "der", "une"]
    words = [("the", "x", "that ", "öder", "with", "une\n", "z" * 39)[i * i % 7 if i % 11 else i % 7] for i in range(160_000)]
    long = " ".join(words)
    texts = [long, "", "short that", "İ" * 300 + " the", "z" * 250 + "that with" + "y" * 200, None]
    start = time.time()
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r["k"]: r["w"] for r in df.select("k", text.best_window(F.col("text"), F.array(*map(F.lit, asked))).alias("w")).collect()}
    assert time.time() - start < 60

    def plain(t: str) -> str:
        low = t.lower()
        starts = range(0, max(len(t), 1), 40)
        best = max(starts, key=lambda i: (sum(w in low[i : i + 260] for w in asked), -i))
        return t[best : best + 260]

    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_leaks_by_classes_of_readers(spark):
    facts, readers = spark.range(20_000).select(F.col("id").alias("fact")), spark.range(20_000).select(F.col("id").alias("reader"))
    memberships = readers.select("reader", F.explode(F.array(F.lit("all"), F.concat(F.lit("n"), F.col("reader") % 4), F.when(F.col("reader") < 6, "few"))).alias("acl")).where("acl is not null")
    evidence = facts.where("fact > 0").select("fact", F.when(F.col("fact") == 7, F.array(F.lit("n1"))).otherwise(F.array(F.lit("all"))).alias("lists"))
    granted = facts.select("fact", F.lit("all").alias("acl")).where("fact <> 7").union(facts.where("fact in (0, 7)").select("fact", F.lit("few").alias("acl")))
    start = time.time()
    assert sorted(map(tuple, reading.leaks(granted, memberships, evidence).collect())) == [(7, r) for r in (0, 2, 3, 4)]
    assert time.time() - start < 60


def test_lists_against_an_index(spark):
    files = spark.createDataFrame([("f1", "a"), ("f2", "a"), ("f3", "b"), ("f4", None)], "file string, acl string")
    members = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "acl string, person string")
    indexed = spark.createDataFrame([("f1", "a"), ("f2", "x"), ("f5", "b")], "file string, acl string")
    held = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("x", "p1"), ("x", "g"), ("b", "p3")], "acl string, person string")
    got = grants.compare_lists(files, members, indexed, held)
    assert sorted(map(tuple, got.collect())) == [("f2", 1, 1), ("f3", 0, 1), ("f5", 1, 0)]
    by_person = grants.compare_readers(files.join(members, "acl").select("file", "person"), indexed.join(held, "acl").select("file", "person"))
    assert sorted(map(tuple, by_person.collect())) == sorted(map(tuple, got.collect()))


def test_initials_end_at_other_letters(spark):
    known = spark.createDataFrame([("e", "large anvil")], "entity string, name string")
    passages = spark.createDataFrame([(i, t) for i, t in enumerate(["ÉLA so", "LA.", "(LA)", "LAé", "LA_", "x LA", "LAX"])], "passage long, text string")
    assert [tuple(r) for r in aliases.initialisms(passages, known).collect()] == [("e", "LA", 5)]


def test_no_pair_of_question_and_text_is_shuffled(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "d")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (9, "x")], "query_id long, term string")
    found = retrieval.bm25(d, q, "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id" not in plan
    assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == [(7, 1), (7, 2), (8, 2)]


def test_nearest_by_blocks_keeps_ties_nulls_and_late_labels(spark, monkeypatch):
    rows = [(i, [float(i % 5), 1.0], i % 3) for i in range(60)] + [(60, [None, 1.0], 0), (61, None, 1), (62, [1.0], 2), (100, [4.0, -3.0], 9), (200, [9.0, 1.0], 2), (300, [-9.0, 0.0], 9), (400, [1.0, 1.0], None)]
    asked = [r for r in rows if r[0] % 100 == 0]
    kind = "id long, v array<float>, label int"
    vectors = spark.createDataFrame(rows, kind).withColumnRenamed("id", "doc_id")
    questions = spark.createDataFrame(asked, kind).withColumnRenamed("id", "query_id")

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        return round(sum(x * y for x, y in zip(a, b, strict=True)), 5)

    for block in (1 << 14, 2):
        monkeypatch.setattr(retrieval, "ASKED_BLOCK", block)
        want, firsts = [], []
        for q, v, label in asked:
            ranked = sorted(((score(v, c), d, x) for d, c, x in rows if d != q), key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
            want += [(q, d, s, i, None if label is None or x is None else x == label) for i, (s, d, x) in enumerate(ranked[:10], 1)]
            good = [i for i, (_, _, x) in enumerate(ranked, 1) if x is not None and x == label]
            firsts.append((q, good[0] if good else None, sum(i <= 10 for i in good)))
        got = retrieval.nearest(vectors, questions, 10).select("query_id", "doc_id", "score", "rank", "good").collect()
        assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == sorted((q, i, d, s) for q, d, s, i, _ in want)
        assert sorted(map(tuple, retrieval.first_good(vectors, questions, 10).select("query_id", "first", "at").collect()), key=lambda r: r[0]) == sorted(firsts, key=lambda r: r[0])


def test_consolidate_many_versions_of_one_fact(spark):
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias("fact_id"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.col("id").cast("string").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("accepted").alias("status"))
    start = time.time()
    got = facts.consolidate(rows).groupBy("status", "action").count().collect()
    assert time.time() - start < 20
    assert sorted(map(tuple, got)) == [("accepted", "", 1), ("superseded", "closed superseded", n - 1)]


def test_tasks_of_two_hops_grow_in_number_not_in_size(spark, monkeypatch):
    from lorekeep import session
    from lorekeep.plans import catalogue

    sf = "/root/testdata/sf0.001"
    query = catalogue.QUERIES["two_hop_via_events"]
    want = sorted(map(tuple, query(spark, sf).collect()))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    got = query(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {-(-rows // 100)}), REPARTITION_BY_NUM") >= 4
    assert sorted(map(tuple, got.collect())) == want


def test_linking_cuts_a_passage_once(spark):
    df = spark.createDataFrame([(1, "the big dairy co of acme"), (2, ""), (3, None), (4, "acme big")], "doc long, text string")
    phrases = spark.createDataFrame([("big dairy", 2, "b"), ("big dairy co", 3, None), ("acme", 1, "a"), ("big", 1, "g"), ("acme big dairy", 3, "x")], "phrase string, n int, entity string")
    found = linking.link_phrases(df, ["doc"], "text", phrases)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [doc") == 1
    assert sorted(map(tuple, found.collect())) == [(1, ["a"]), (4, ["a", "g"])]


def test_scores_of_fields_meet_by_numbers(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "gamma alpha alpha"), (2, "beta", "alphas delta"), (3, None, "x")], "id long, title string, content string")
    asked = spark.createDataFrame([(7, "alpha"), (7, "alpha"), (8, "beta"), (8, "gamma")], "query_id long, term string")
    found = retrieval.field_search(docs, asked, "id", {"title": 2.0, "content": 1.0}, ["content"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Aggregate [" in line and "asked" in line]
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "term" in line and "asked" in line]
    assert plan.count("Aggregate [") == 2 and "bround" not in plan and "round(" not in plan
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(7, 1), (7, 2), (8, 1), (8, 2)}
