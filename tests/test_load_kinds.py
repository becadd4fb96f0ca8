"""Structured load searches only tables that may hold what it looks for."""

from __future__ import annotations

from lorekeep.operators import load


def test_lookup_without_tables_of_the_kind_joins_nothing(spark):
    known = load._Known(spark)
    known.add("ids", spark.createDataFrame([("A", "s", "x", "e1")], "type string, system string, value string, entity string"), "A")
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "row string, v string")
    other = load._find(rows, "v", "B", "s", "id", known, "e")
    assert "Join" not in other._jdf.queryExecution().optimizedPlan().toString()
    assert [r["e"] for r in other.collect()] == [None, None]
    assert {r["v"]: r["e"] for r in load._find(rows, "v", "A", "s", "id", known, "e").collect()} == {"x": "e1", "y": None}


def test_steps_write_few_tables_and_links_are_distinct(spark, monkeypatch):
    written = []
    staged = load.staged
    monkeypatch.setattr(load, "staged", lambda df, name: written.append(name) or staged(df, name))
    things = spark.createDataFrame([(1, 5, "Pump"), (2, 6, "Fan")], "line int, tag int, label string")
    jobs = spark.createDataFrame([(1, "a", 5, 2.5), (2, "A", 6, 1.0), (2, "a", 5, 4.0), (3, None, 6, None), (4, None, 6, 3.0)], "line int, job string, tag int, paid double")
    link = load.Link("tag", "on", "Thing", "s")
    mappings = [load.Mapping("things", "entities", "Thing", "s", "line", "tag", "label"), load.Mapping("jobs", "events", "Job", "j", "line", "job", None, (), (link,), None, "paid")]
    g = load.load_structured(spark, {"things": things, "jobs": jobs}, mappings)
    names = {r["entity"]: (r["name"], r["properties"].get("amount")) for r in g.entities.collect()}
    # "a" and "A" are one event, whose last properties are those of "A" or "a"; rows without an id are events of their own
    assert sorted(n for n, _ in names.values()) in (sorted(["Pump", "Fan", "Job", "Job", j]) for j in ("Job a", "Job A"))
    assert sorted((names[r["source"]][0].upper(), names[r["target"]][0]) for r in g.links.collect()) == [("JOB", "Fan"), ("JOB", "Fan"), ("JOB A", "Fan"), ("JOB A", "Pump")]
    assert sorted((r["system"], r["value"]) for r in g.identifiers.collect()) == [("j", "A"), ("j", "a"), ("s", "5"), ("s", "6")]
    assert len(written) <= 8
