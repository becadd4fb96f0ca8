"""Near terms and scores over fields."""

from __future__ import annotations

import random

from lorekeep.operators import retrieval

RNG = random.Random(3)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_terms_equal_all_pairs(spark):
    words = sorted({"".join(RNG.choice("abc") for _ in range(RNG.randint(1, 8))) for _ in range(250)})
    asked = words[::7] + ["abcabcabc", "b", "zz"]
    got = {(r["term"], r["near"]): r["weight"] for r in retrieval.near_terms(spark.createDataFrame([(w,) for w in asked], "term string"), spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    allowed = lambda w: 0 if len(w) < 3 else 1 if len(w) < 6 else 2
    want = {(a, w): 1 - edits(a, w) / min(len(a), len(w)) for a in asked for w in words if a[0] == w[0] and edits(a, w) <= allowed(a)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_field_search(spark):
    docs = spark.createDataFrame([(1, "pump manual", "how to service it"), (2, "notes", "the pump failed; pump again"), (3, "pmup", "nothing"), (4, None, ""), (5, "other", "words")], "id long, title string, content string")
    asked = spark.createDataFrame([(1, "pump"), (1, "manuel"), (2, "zzz")], "query_id long, term string")
    got = {r["id"]: r["score"] for r in retrieval.field_search(docs, asked, "id", {"title": 2.0, "content": 1.0}, ["title", "content"]).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]  # "manual" is near "manuel"; "pmup" is two edits from "pump", which may have one
    exact = {r["id"]: r["score"] for r in retrieval.field_search(docs, asked, "id", {"title": 2.0, "content": 1.0}, ["content"]).collect()}
    assert exact[1] < got[1]
    assert retrieval.field_search(docs.limit(0), asked, "id", {"title": 1.0}, ["title"]).count() == 0
