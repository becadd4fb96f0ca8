"""What an answer may rest on, by hand."""

from __future__ import annotations

import datetime

from lorekeep.operators import briefs


def test_context_pack(spark):
    day = datetime.date
    asked = spark.createDataFrame([(1, "What does Kemper pay?"), (2, "nothing")], "query_id long, question string")
    hits = spark.createDataFrame(
        [(1, 1, "fact", "Kemper: rate", "books", True, False, "Timeline: 5 then 6\n" + "x" * 2000), (1, 2, "fact", "Kemper: rate", "books", False, False, "Timeline: 5 then 6\nold"), (1, 3, "passage", "mail", "a.eml", True, False, "says so"), (1, 4, "fact", "Odd", "b", True, True, "hm"), (1, 5, "passage", "too", "many", True, False, "z"), (3, 1, "passage", "not", "asked", True, False, "z")],
        "query_id long, rank int, doc_type string, title string, place string, is_current boolean, disputed boolean, content string",
    )
    named = spark.createDataFrame([(1, 0, "t", "Big Blue", "Term"), (1, 1, "k", "Kemper", "Customer"), (1, 2, "n", "Northgate", "Site"), (1, 3, "x", "Fourth", "Site")], "query_id long, nth int, entity string, name string, type string")
    facts = spark.createDataFrame(
        [("k", "rate 6", day(2024, 1, 2), None, False), ("k", "rate 6", day(2024, 1, 2), None, False), ("k", "rate 5", day(2020, 1, 1), day(2023, 12, 31), False), ("k", "terms net 30", None, None, True), ("n", "old", None, day(2020, 5, 5), False), ("x", "far", None, None, False)],
        "entity string, fact string, since date, until date, disputed boolean",
    )
    pack = briefs.context_pack(asked, hits, named, facts, "2024-06-01", sources=4, things=2)
    got = {(r["part"], r["n"]): r["line"] for r in pack.collect()}
    assert {k for k in got if k[0] == "source"} == {("source", n) for n in (1, 2, 3, 4)} and len(got["source", 1]) == len("[1] Kemper: rate · books (Current)\n") + 900
    assert "(Outdated)" in got["source", 2] and "(Supports)" in got["source", 3] and "(Disputed)" in got["source", 4]
    assert {v for k, v in got.items() if k[0] == "change"} == {"Kemper: rate: 5 then 6"}  # once, though two hits say it
    assert [v for k, v in sorted(got.items()) if k[0] == "current"] == ["Kemper: rate 6 (since Jan 2, 2024)", "Kemper: terms net 30 [DISPUTED]"]
    assert {v for k, v in got.items() if k[0] == "earlier"} == {"Kemper: rate 5 (Jan 1, 2020 to Dec 31, 2023)", "Northgate: old (until May 5, 2020)"}
    texts = {r["query_id"]: r["prompt"] for r in briefs.prompts(pack, asked).collect()}
    assert texts[2] == "Question: nothing\n" and texts[1].index("5 then 6") < texts[1].index("rate 6 (since") < texts[1].index("[1]")
    assert briefs.context_pack(asked.limit(0), hits, named, facts, "2024-06-01").count() == 0
