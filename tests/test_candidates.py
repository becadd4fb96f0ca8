"""Fuzzy groups against all pairs."""

from __future__ import annotations

import random

from lorekeep.operators import candidates

RNG = random.Random(6)


def grams(s):
    s = f"  {s} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def contains(a, b):
    a, b = sorted((a.split(), b.split()), key=len)
    return bool(a) and all(any(x == s or (len(s) >= 4 and x.startswith(s)) for x in b) for s in a) and any(len(s) >= 4 for s in a)


def test_pairs_equal_all_pairs(spark):
    words = ["north", "valley", "kemper", "kemp", "harbor", "summit", "oak", "foods", "food", "st", "dairy", "dairyland"]
    names = sorted({" ".join(RNG.choice(words) for _ in range(RNG.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([("t", n) for n in names], "type string, norm string")
    near = {(r["a"], r["b"]) for r in candidates.similar_pairs(df).collect()}
    held = {(r["a"], r["b"]) for r in candidates.contained_pairs(df).collect()}
    pairs = [(a, b) for a in names for b in names if a < b]
    assert near == {(a, b) for a, b in pairs if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    # of two names of as many words either may be the shorter one
    assert held == {(a, b) for a, b in pairs if contains(a, b) or contains(b, a)}


def test_groups(spark):
    rows = [(f"a{i:03d}", "Customer", f"Kemper Molding {i:03d}") for i in range(40)] + [("b1", "Branch", "Louisville"), ("b2", "Branch", "J-town"), ("b3", "Branch", "Erie")]
    rows += [("c1", "Vendor", "Blue Ridge"), ("c2", "Vendor", "The Blue Ridge Co."), ("c3", "Vendor", "")] + [(f"v{i}", "Vendor", "".join(RNG.choice("bcdfghjk") for _ in range(9))) for i in range(30)]
    groups, cut = candidates.fuzzy_groups(spark.createDataFrame(rows, "entity string, type string, name string"))
    got = {r["entity"]: r["group"] for r in groups.collect()}
    sizes = {}
    for g in got.values():
        sizes[g] = sizes.get(g, 0) + 1
    mine = [got[f"a{i:03d}"] for i in range(40)]
    assert max(sizes.values()) <= 14 and len(set(mine)) == 3 and mine == sorted(mine)  # runs of neighbouring names
    assert got["b1"] == got["b2"] == got["b3"] and got["c1"] == got["c2"] and "c3" not in got and not any(e.startswith("v") for e in got)
    listed = {(r["a"], r["b"]) for r in cut.collect()}
    assert listed and all(got[a] != got[b] for a, b in listed)
    again, _ = candidates.fuzzy_groups(spark.createDataFrame(rows, "entity string, type string, name string").repartition(7))
    assert {r["entity"]: r["group"] for r in again.collect()} == got
    assert candidates.fuzzy_groups(spark.createDataFrame([], "entity string, type string, name string"))[0].count() == 0
