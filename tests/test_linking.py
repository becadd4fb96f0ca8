"""The phrase index and linking on hand-made names."""

from __future__ import annotations

from lorekeep.operators import linking

ENTITIES = [
    ("c1", "Blue Ridge Food Processing LLC", "Customer"), ("c2", "Kemper Molding", "Customer"), ("c3", "Kemper Supply", "Customer"), ("p1", "Dave Miller", "Person"), ("p2", "Sarah Ostrander", "Person"), ("p3", "Sarah Blue", "Person"),
    ("t1", "Big Blue", "Term"), ("t2", "the cage", "Term"), ("t3", "policy", "Term"), ("a1", "TP-17", "Asset"), ("a2", "Goulds pump", "Asset"), ("a3", "PUMP-17", "Asset"), ("v1", "Red Truck", "Vehicle"), ("s1", "Service Labor - OT", "Labor"), ("n1", "Northgate Dairy", "Site"),
]
ALIASES = [("a1", "Pump 17", "nickname"), ("a3", "Pump 17", "spelling"), ("c2", "KM", "spelling"), ("c1", "one two three four five six seven eight nine", "spelling"), ("p1", "Mike H", "nickname"), ("p2", "Mike H", "nickname")]


def index(spark, entities=ENTITIES, aliases=ALIASES):
    return linking.phrase_index(spark.createDataFrame(entities, "entity string, name string, type string"), spark.createDataFrame(aliases, "entity string, alias string, kind string"), spark.createDataFrame([("t1", "c1")], "term string, target string"))


def test_phrase_index(spark):
    got = {r["phrase"]: r["entity"] for r in index(spark).collect()}
    assert got["big blue"] == "c1" and got["blue ridge food processing"] == "c1" and got["blue ridge food processing llc"] == "c1"  # a term lends its words; legal endings go
    assert got["the cage"] == "t2" and "policy" not in got  # a set phrase of everyday words, but no single one
    assert got["pump 17"] == "a1" and got["mike h"] is None  # the nickname wins; ambiguous ones mean nothing
    assert got["tp 17"] == "a1" and "goulds pump" not in got and "red truck" not in got
    assert got["service labor overtime"] == "s1" and got["overtime"] == "s1"
    assert got["dave"] == "p1" and "sarah" not in got and "kemper" not in got and got["northgate"] == "n1" and "blue" not in got
    assert "km" not in got and not any(len(p.split()) > 8 for p in got)


def test_linking(spark):
    texts = [
        (1, "What does Big Blue's contract say? Dave (Miller) knows; DAVE MILLER signed for TP-17."),
        (2, "Kemper Molding and Kemper supply met Mike H at Northgate Dairy, not at Blue Ridge."),
        (3, "nothing here"), (4, ""), (5, None), (6, "dave dave Dave Miller " + "northgate " * 500),
    ]
    df = spark.createDataFrame(texts, "doc long, text string").selectExpr("*", "1 AS n", "'x' AS entity", "2 AS phrase").repartition(3)
    got = {r["doc"]: r["entity_ids"] for r in linking.link_phrases(df, ["doc"], "text", index(spark)).collect()}
    assert got == {1: ["c1", "p1", "a1"], 2: ["c2", "c3", "n1"], 6: ["p1", "n1"]}
    empty = index(spark).limit(0)
    assert linking.link_phrases(df, ["doc"], "text", empty).count() == 0


def test_projection(spark):
    files = spark.createDataFrame(
        [(1, "x/Price list v1.pdf", "d1", "a", False), (2, "x/Price list v2 FINAL.pdf", "d2", "b", False), (3, "y/Price list v2.pdf", "d2", "c", True), (4, "other.txt", "d4", None, False)], "file long, path string, digest string, acl string, labelled boolean"
    )
    passages = spark.createDataFrame([(f, 0, "list", "Dave knows") for f in (1, 2, 3, 4)], "file long, n int, title string, content string")
    facts = spark.createDataFrame([(1, "f2"), (1, "f1"), (1, "f1")], "file long, fact string")
    got = {r["file"]: r for r in linking.project_passages(passages, files, facts, index(spark)).collect()}
    assert got[1]["facts"] == ["f1", "f2"] and got[1]["replaced_by"] == ["2"] and not got[1]["is_current"] and got[1]["acl_ids"] == ["a"]
    assert got[2]["acl_ids"] == ["b", "c"] and got[3]["acl_ids"] == ["c"] and got[2]["is_current"]  # a marked copy keeps its own readers
    assert got[4]["acl_ids"] == [] and all(r["entity_ids"] == ["p1"] for r in got.values())


def test_many_phrases_need_no_broadcast(spark):
    """A hundred thousand phrases meet the texts by equality on words and phrases."""
    many = spark.range(100_000).selectExpr("concat('name', id, ' of ', id % 97) AS phrase", "3 AS n", "concat('e', id) AS entity")
    texts = spark.createDataFrame([(1, "so name77 of 77 met name500 of 15 and name501 of 1")], "doc long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = linking.link_phrases(texts, ["doc"], "text", many)
        plan = linked._jdf.queryExecution().toString()
        assert "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert linked.collect()[0]["entity_ids"] == ["e77", "e500"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
