"""Repair of ids across systems on hand-made lists."""

from __future__ import annotations

from lorekeep.operators.repair import repair_ids

ROWS = [
    (1, "Customer", "crm", "40", "Kemper Molding", []),  # fits
    (2, "Customer", "crm", "41", "Blue Ridge Foods", []),  # hangs on Northgate; one thing of that name
    (3, "Customer", "crm", "42", "Nobody Knows", []),  # hangs on Kemper; nothing of that name: queue
    (4, "Customer", "crm", "43", "BRF", []),  # letters in order
    (5, "Customer", "crm", "44", "Something Else", ["X@Y.z"]),  # shares a universal id with its holder
    (6, "Customer", "crm", "45", "Odd Spelling", ["k@k.k"]),  # a universal id of another thing
    (7, "Person", "hr", "DH", "Dwayne Hatcher", []), (8, "Person", "hr", "DH", "Darnell Hughes", []),  # one id, two people
    (9, "Person", "hr", "7", "Hank Ostrander", []),  # surname and first initial
    (10, "Customer", "crm", "46", "Twin Name", []),  # two things of that name: queue
    (11, "Customer", "crm", None, "No Id", None), (12, "Customer", "crm", "47", None, None),
]
NAMES = [("k", "Customer", "Kemper Molding Co."), ("n", "Customer", "Northgate Dairy"), ("b", "Customer", "Blue Ridge Foods, Inc."), ("t1", "Customer", "Twin Name"), ("t2", "Customer", "The Twin Name"), ("d", "Person", "Dwayne Hatcher"), ("h", "Person", "Henry Ostrander")]
IDS = [("k", "Customer", "crm", "40"), ("n", "Customer", "crm", "41"), ("k", "Customer", "crm", "42"), ("b", "Customer", "crm", "43"), ("n", "Customer", "crm", "44"), ("n", "Customer", "Email", "x@y.z"), ("n", "Customer", "crm", "45"), ("k", "Customer", "Email", "K@k.k"), ("d", "Person", "hr", "dh"), ("h", "Person", "hr", "7"), ("n", "Customer", "crm", "46"), ("n", "Customer", "crm", "47")]
LINKS = [("rep", "n", "p1"), ("rep", "n", "p2"), ("site", "n", "s1"), ("rep", "k", "p1")]
ROW_LINKS = [(2, "rep", "p1"), (2, "site", "s1"), (5, "site", "s1"), (3, "rep", "p1")]


def test_repair(spark):
    rows = spark.createDataFrame(ROWS, "row int, type string, system string, ext string, row_name string, universal array<string>")
    out = repair_ids(
        rows, spark.createDataFrame(NAMES, "entity string, type string, name string"), spark.createDataFrame(IDS, "entity string, type string, system string, value string"),
        spark.createDataFrame(LINKS, "relationship string, source string, target string"), spark.createDataFrame(ROW_LINKS, "row int, relationship string, target string"),
    )
    assert {tuple(r) for r in out.shared.collect()} == {("Person", "hr", "dh")}
    fixes = {r["ext"]: (r["holder"], r["into"]) for r in out.fixes.collect()}
    assert fixes == {"41": ("n", "b"), "42": ("k", None), "45": ("n", "k"), "46": ("n", None)}
    ids = {(r["system"], r["value"]): r["entity"] for r in out.identifiers.collect()}
    assert ids == {("crm", "40"): "k", ("crm", "41"): "b", ("crm", "42"): "k", ("crm", "43"): "b", ("crm", "44"): "n", ("Email", "x@y.z"): "n", ("crm", "45"): "k", ("Email", "K@k.k"): "k", ("hr", "7"): "h", ("crm", "46"): "n", ("crm", "47"): "n"}
    # the moved row's links go along, but for one that a row of the holder's own makes too
    assert {tuple(r) for r in out.links.collect()} == {("rep", "b", "p1"), ("rep", "n", "p2"), ("site", "n", "s1"), ("rep", "k", "p1")}
    empty = repair_ids(rows.limit(0), *(spark.createDataFrame([], s) for s in ("entity string, type string, name string", "entity string, type string, system string, value string", "relationship string, source string, target string", "row int, relationship string, target string")))
    assert all(df.count() == 0 for df in empty)
