"""Hand-checked rows and metamorphic checks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import dates, text
from lorekeep.operators import access, facts, graph, resolution, segments
from lorekeep.operators.closure import connected_components
from lorekeep.sources import landing


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_names(spark):
    assert one(spark, text.normalize_name(F.lit("The Kemper Molding Co., Inc."))) == "kemper molding"
    assert one(spark, text.normalize_subject(F.lit("RE: Fwd: [EXT] Kemper pricing "))) == "kemper pricing"
    assert one(spark, text.normalize_phrase(F.lit("Big Blue's terms"))) == "big blue terms"
    assert one(spark, text.split_multi(F.lit("x"), F.lit("PRESS-106, PRESS-71"))) == ["PRESS-106", "PRESS-71"]
    assert one(spark, text.split_multi(F.lit("x"), F.lit("Smith, John"))) == ["Smith, John"]
    assert one(spark, text.split_multi(F.lit("x"), F.lit("HO/MKH"))) == ["HO", "MKH"]
    assert one(spark, text.split_multi(F.lit("x"), F.lit("UNASSIGNED; 50433"))) == ["50433"]


def test_similarity_definitions_differ(spark):
    a, b = F.lit("red bolt"), F.lit("bolt red")
    whole = one(spark, text.jaccard(text.name_trigrams(a), text.name_trigrams(b)))
    words = one(spark, text.jaccard(text.word_trigrams(a), text.word_trigrams(b)))
    assert words == 1.0 and whole < 1.0


def test_dates(spark):
    assert one(spark, dates.loose_date(F.lit("3/4/21"))) == datetime.date(2021, 3, 4)
    assert one(spark, dates.loose_date(F.lit("Mar 4, 2021"))) == datetime.date(2021, 3, 4)
    assert one(spark, dates.loose_date(F.lit("1/1/1850"))) is None


def test_family(spark):
    assert one(spark, text.family_key(F.lit("a/b/FINAL pricing v2 (1) March 2025.xlsx"))) == "pricing"
    assert one(spark, text.revision(F.lit("plan rev C.pdf"))) == 3


def test_rules():
    changed = rules.merge(rules.DEFAULTS, {"resolution": {"max_fuzzy": 10}})
    assert rules.diff(rules.DEFAULTS, changed) == {"resolution": {"max_fuzzy": 10}}
    assert rules.problems({"a": {"p": "(", "n": -1}}) and not rules.problems(rules.DEFAULTS)


def test_components_with_cycles_and_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[102] == 100
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_closure_cycle_changes_nothing(spark):
    edges = [("a", "g1"), ("g1", "g2"), ("g2", "g3")]
    start = spark.createDataFrame([("a",)], "root string")
    plain = access.reachable(start, spark.createDataFrame(edges, "child string, parent string"))
    cyclic = access.reachable(start, spark.createDataFrame([*edges, ("g3", "g1")], "child string, parent string"))
    assert sorted(r["node"] for r in plain.collect()) == sorted(r["node"] for r in cyclic.collect()) == ["a", "g1", "g2", "g3"]


def test_secured_null_list_is_open(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id long, acl string")
    seen = access.secured(df, "acl", spark.createDataFrame([("x",)], "acl_id string"))
    assert sorted(r["id"] for r in seen.collect()) == [1, 2]


def test_covers(spark):
    lists = spark.createDataFrame([("wide", "g"), ("narrow", "p1"), ("narrow", "p2"), ("other", "p3")], "acl_id string, principal string")
    principals = spark.createDataFrame([("p1", "p1"), ("p1", "g"), ("p2", "p2"), ("p2", "g"), ("p3", "p3"), ("g", "g")], "root string, node string")
    assert {(r["wide"], r["narrow"]) for r in access.covers(lists, lists, principals).collect()} == {("wide", "narrow")}


def test_interval_ends(spark):
    df = spark.createDataFrame([(1, None, "2024-01-15"), (2, "2024-01-15", None), (3, None, None)], "id long, valid_from string, valid_to string").selectExpr("id", "cast(valid_from as timestamp) valid_from", "cast(valid_to as timestamp) valid_to")
    assert sorted(r["id"] for r in facts.as_of(df, "2024-01-15", "exclusive").collect()) == [2, 3]
    assert sorted(r["id"] for r in facts.as_of(df, "2024-01-15", "inclusive").collect()) == [1, 2, 3]


def test_consolidate(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "s", "p", "a", t(1), None, "accepted"), (2, "s", "p", "b", t(5), None, "accepted"), (3, "s", "p", "b", t(9), None, "superseded")]
    df = spark.createDataFrame(rows, "fact_id long, subject string, predicate string, value string, valid_from timestamp, valid_to timestamp, status string")
    out = {r["fact_id"]: (r["valid_to"], r["status"]) for r in facts.consolidate(df).collect()}
    assert out[1] == (t(5), "superseded") and out[3][1] == "rejected" and out[2] == (None, "accepted")


def test_greedy(spark):
    assert one(spark, segments.greedy(F.array(*[F.lit(x) for x in ("aaaa", "bbb", "cc", "ddddddddd")]), 8, " ")) == ["aaaa bbb", "cc", "ddddddddd"]


def test_merge(spark):
    entities = spark.createDataFrame([(1, "Acme Inc"), (2, "ACME, LLC"), (3, "Other"), (4, "Zed")], "entity long, name string")
    ids = spark.createDataFrame([(3, "SN-12345"), (4, "SN-12345")], "entity long, identifier string")
    groups = resolution.certain_merges(entities, ids)
    assert {(r["entity"], r["group"]) for r in groups.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    edges = spark.createDataFrame([(10, 1, 2, "x"), (11, 1, 3, "y"), (12, 2, 3, "y")], "id long, src long, dst long, rel string")
    mapping = spark.createDataFrame([(2, 1)], "entity long, survivor long")
    assert [tuple(r) for r in resolution.repoint(edges, mapping).select("id", "src", "dst").collect()] == [(11, 1, 3)]


def test_detect_format(spark):
    files = [(b"", "a", "empty"), (b"%PDF-1.4", "a", "pdf"), (b"PK\x03\x04", "a", "zip"), (b"<!DOCTYPE html><p>", "a", "html"), (b"From: a\nTo: b\n\nhi", "m.eml", "eml"), (b"\x00\x01\x02\x03", "a", "unknown"), (b"hello", "x.md", "markdown")]
    df = spark.createDataFrame([(bytearray(b), n, k) for b, n, k in files], "body binary, name string, kind string")
    assert all(r["kind"] == r["got"] for r in df.select("kind", landing.detect_format(F.col("body"), F.col("name")).alias("got")).collect())


def test_single_valued(spark):
    rows = [("r", i, i) for i in range(9)] + [("r", 0, 5)]
    found = graph.single_valued(spark.createDataFrame(rows, "rel string, src long, dst long")).first()
    assert found["sources"] == 9 and round(found["share"], 4) == round(8 / 9, 4)


def test_personal_data(spark):
    made = [
        (1, "SSN 123-45-6789 only"), (2, "date of birth 1/2/1980"), (3, "order 123456 of 000-12-3456"), (4, "mail a@b.org"), (5, None),
        (6, "intro\nEmployee | Dept | Hourly Rate\nx | y | 3"), (7, "item | Rate"), (8, "x\ny\n" + " ".join(f"account no: {10000000 + i}" for i in range(7))), (9, "DOB: 1980-02-01, aba # 123456789"), (9, "078-05-1120"),
    ]
    got = {r["doc_id"]: (r["kinds"], r["masked"]) for r in access.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {
        1: (["ssn"], ["123-**-****"]),
        2: (["birth_date"], ["date of birth #/#/####"]),
        6: (["personal_pay"], ['column "Hourly Rate" next to people']),
        8: (["bank_account"], [f"account no: ****{i:04d}" for i in range(7)]),
        9: (["bank_account", "birth_date", "ssn"], ["078-**-****", "DOB: ####-##-##", "aba # *****6789"]),
    }


def test_guarded_sql_judges_the_plan(spark):
    views = {"t": spark.createDataFrame([(1, "a;b", 2)], "id int, name string, `set` int")}
    from lorekeep.operators import checks

    for fine in ("SELECT `set` AS load, id AS add FROM t", "SELECT 1 -- it's fine; drop table t", "/* ' */ SELECT * FROM t WHERE name = 'a;b' AND 'insert' <> 'delete'", "WITH x AS (SELECT id FROM t) SELECT * FROM x WHERE id IN (SELECT id FROM t)", "FROM t SELECT id", "SELECT * FROM t;"):
        assert checks.guarded_sql(spark, fine, views).count() == 1
    assert "t" not in {v.name for v in spark.catalog.listTables()}
    refused = ["DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1, 'x', 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SET spark.sql.ansi.enabled=false", "SELECT * FROM other", "SELECT * FROM parquet.`/etc`", "SELECT id FROM t WHERE id IN (SELECT id FROM secret)", "SELECT reflect('java.lang.System', 'exit', 1)", "CACHE TABLE t", "", "CREATE VIEW v AS SELECT 1"]
    for statement in refused:
        try:
            checks.guarded_sql(spark, statement, views)
        except ValueError:
            continue
        raise AssertionError(statement)


def test_levels_with_cycles(spark):
    from lorekeep.operators.closure import levels

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (9, 8), (None, 1)], "parent long, child long")
    got = {r["node"]: r["depth"] for r in levels(spark.createDataFrame([(1,)], "node long"), edges).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def brute_records(text, delimiter):
    records, record, field, quoted, i = [], [], "", False, 0
    while i <= len(text):
        c = text[i : i + 1]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted and c:
            field += c
        elif c == delimiter:
            record.append(field.strip())
            field = ""
        elif c in ("\n", "\r", ""):
            records.append([*record, field.strip()])
            record, field = [], ""
        else:
            field += c
        i += 1
    return [r for r in records if any(r)]


def test_delimited_records(spark):
    import random

    rng = random.Random(4)
    texts = ["", "\n\n", 'a,b\n"c,d","e\nf"', '"say ""hi""",x\r\n , \n"",""\n""""', 'open "quote, to\nthe end', " a ; b |c", '"a""";b', "," * 5, 'x"y"z,1', '"' * 4 + "," + '"' * 6]
    texts += ["".join(rng.choice('ab",\n\r;| "') for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts.append('"' + "long\n" * 50_000 + '",' + "a,b\n" * 50_000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for delimiter in (",", "|"):
        got = {r["i"]: r["r"] for r in df.select("i", text.delimited_records(F.col("t"), delimiter).alias("r")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == brute_records(t, delimiter), repr(t)[:200]
