"""Structured load on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.load import Link, Mapping, load_structured
from lorekeep.plans import load as plan

PEOPLE = Mapping("staff", "entities", "Person", "hr", "line", "no", "full", ("mail",))
CUSTOMERS = Mapping("customers", "entities", "Customer", "books", "line", "cust", "name", ("city",))
ASSETS = Mapping("assets", "entities", "Asset", "dispatch", "line", "tag", "label", ("type", "model", "Serial #"), (Link("site", "located_at", "Site", "dispatch"), Link("cust", "owned_by", "Customer", "books"), Link("tech", "kept_by", "Person", None, "name")))
LEGACY = Mapping("legacy", "entities", "Customer", "old", "line", None, "client", ("phone",))
JOBS = Mapping("jobs", "events", "Job", "dispatch", "line", "job", None, ("state",), (Link("Customer ID", "for", "Customer", "books"), Link("Asset(s)", "on", "Asset", "dispatch")), "day", "amount")


@pytest.fixture(scope="module")
def tables(spark):
    def frame(columns, rows):
        return spark.createDataFrame(rows, ", ".join(f"`{c}` {'int' if c == 'line' else 'string'}" for c in columns))

    return {
        "staff": frame(["line", "no", "full", "First Name", "Last Name", "mail"], [(1, "7", "x@y.z", "Henry", "Ostrander", "ho@x.z"), (2, "8", None, "Gina", "Small", None), (3, "DH", "Dwayne Hatcher", None, None, None), (4, "DH", "Darnell Hughes", None, None, None)]),
        "customers": frame(["line", "cust", "name", "city"], [(1, "40", "Kemper Molding Co.", "Erie"), (2, "41", "Big Dairy", None), (3, "42", "Big Dairy", "Troy"), (4, "43", "N/A", None), (5, None, " - ", None), (6, "40", "Kemper Molding Co.", "Rome")]),
        "assets": frame(["line", "tag", "label", "type", "model", "Serial #", "site", "cust", "tech"], [
            (1, "TP-17", "Pump 17", "Pump", "G2", "S100", "S1", "40", "Henry Ostrander"), (2, "TP-18", None, "Pump", "G2", None, "S1", "99", "UNASSIGNED"),
            (3, None, "Old boiler", None, None, "S100", "S2; S3", None, "Gina Small"), (4, "TP-17", "Pump 17", "Pump", "G3", None, None, "40", None), (5, None, None, "Fan", None, None, None, None, None)]),
        "legacy": frame(["line", "client", "phone"], [(1, "The KEMPER Molding Company", "555"), (2, "Nobody Knows", None), (3, "nobody knows, Inc.", "1")]),
        "jobs": frame(["line", "job", "day", "amount", "state", "Customer ID", "Customer", "Asset(s)"], [
            (1, "J1", "2024-01-02", "$1,000.50", "open", "40", "Kemper", "TP-17, TP-18"), (2, "J1", "2024-01-03", "9.5", "done", "40", "Kemper", "TP-17"),
            (3, "Total", "", "1010", None, None, None, None), (4, None, "2024-02-01", None, None, "77", "Fresh Fish Inc", None), (5, None, None, None, None, "78", "Fresh Fish", "CV-03")]),
    }


def test_structured_load(spark, tables):
    g = load_structured(spark, tables, [JOBS, LEGACY, PEOPLE, CUSTOMERS, ASSETS])
    entities = {r["entity"]: r for r in g.entities.collect()}
    by_name = {(r["type"], r["name"]): r["entity"] for r in entities.values()}
    assert len(by_name) == len(entities)
    name = lambda e: entities[e]["name"]
    ids = {(r["system"], r["value"]): name(r["entity"]) for r in g.identifiers.collect()}
    links = {(r["relationship"], name(r["source"]), name(r["target"])) for r in g.links.collect()}
    aliases = {(name(r["entity"]), r["alias"]) for r in g.aliases.collect()}
    # people: the parts of a name instead of a mail address; an id of two names is none
    assert {n for t, n in by_name if t == "Person"} == {"Henry Ostrander", "Gina Small", "Dwayne Hatcher", "Darnell Hughes"}
    assert ids["hr", "7"] == "Henry Ostrander" and ("hr", "DH") not in ids
    # customers: names of several rows are told apart, a row known by its id only says so, one without both goes
    assert ids["books", "40"] == "Kemper Molding Co. · 40" and ids["books", "41"] == "Big Dairy · 41" and ids["books", "43"] == "43"
    assert entities[by_name["Customer", "43"]]["properties"]["Description"] == 'Known only as "43" in books'
    assert entities[by_name["Customer", "Kemper Molding Co. · 40"]]["properties"]["city"] == "Rome"  # the last row's
    # assets: one per tag; a serial number is an id as well; what isn't named is described
    assert ids["dispatch", "TP-17"] == "Pump 17 · TP-17" and ids["dispatch", "TP-18"] == "Pump G2 · TP-18"
    assert ids["Serial", "S100"] in ("Pump 17 · TP-17", "Old boiler") and ("Asset", "Fan") not in by_name
    assert {("located_at", "Old boiler", "S2"), ("located_at", "Old boiler", "S3"), ("located_at", "Pump G2 · TP-18", "S1")} <= links
    assert ("kept_by", "Pump 17 · TP-17", "Henry Ostrander") in links and not any(t == "UNASSIGNED" for _, _, t in links)
    assert ("owned_by", "Pump G2 · TP-18", "99") in links and entities[by_name["Customer", "99"]]["origin"] == "link"
    # a list without ids: two spellings are one
    assert {n for t, n in by_name if t == "Customer" and "obody" in n.lower()} == {"Nobody Knows"} and ("Nobody Knows", "nobody knows, Inc.") in aliases
    # events: rows of one id, banners left out, amounts summed, the first row's properties
    job = entities[by_name["Job", "Job J1"]]["properties"]
    assert job == {"source_system": "dispatch", "date": "2024-01-02", "amount": "1010.00", "lines": "2", "state": "open"}
    assert {t for r, s, t in links if r == "on" and s == "Job J1"} == {"Pump 17 · TP-17", "Pump G2 · TP-18"}
    # a target that nobody knows is called by the name beside its id, once for both ids
    assert {t for r, _, t in links if r == "for"} == {"Kemper Molding Co. · 40", "Fresh Fish Inc"} and ids["books", "77"] == ids["books", "78"] == "Fresh Fish Inc"
    assert ("on", "Job", "CV-03") in links
    assert {r["source_table"] for r in g.evidence.collect()} == {"staff", "customers", "assets", "legacy"}


def test_second_load_changes_nothing(spark, tables):
    mappings = [PEOPLE, CUSTOMERS, ASSETS, LEGACY, JOBS]
    first = load_structured(spark, tables, mappings)
    second = load_structured(spark, tables, mappings, first)
    a, b = ({tuple(r) for r in plan.rows_of(g).collect()} for g in (first, second))
    assert a == b


def test_empty_tables_and_promoted_links(spark, tables):
    empty = {k: t.limit(0) for k, t in tables.items()}
    assert plan.rows_of(load_structured(spark, empty, [PEOPLE, CUSTOMERS, ASSETS, LEGACY, JOBS])).count() == 0
    # a customer that a job names first becomes the list's once the list comes
    jobs = load_structured(spark, tables, [JOBS])
    both = load_structured(spark, tables, [CUSTOMERS], jobs)
    row = both.entities.where("type = 'Customer' and name like 'Kemper%'").first()
    assert row["origin"] == "structured" and row["name"] == "Kemper Molding Co. · 40"
    assert both.identifiers.where(F.col("value") == "40").count() == 1


def test_long_cells_stay_whole(spark):
    name, note, job = "Pump " + "x" * 400, "n" * 700, "J" + "1" * 350
    things = spark.createDataFrame([(1, "T1", name, note)], "line int, tag string, label string, note string")
    jobs = spark.createDataFrame([(1, job, note, name + " twin")], "line int, job string, note string, thing string")
    mappings = [Mapping("things", "entities", "Thing", "s", "line", "tag", "label", ("note",)), Mapping("jobs", "events", "Job", "s", "line", "job", None, ("note",), (Link("thing", "on", "Thing", None, "name"),))]
    g = load_structured(spark, {"things": things, "jobs": jobs}, mappings)
    found = {r["name"]: r["properties"].get("note") for r in g.entities.collect()}
    assert found == {name: note, f"Job {job}": note, name + " twin": None}
    assert [r["quote"] for r in g.evidence.collect()] == [f"1 | T1 | {name} | {note}"]
