"""The search index: builds beside the live one, updates in two branches, deletions, refused writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import index as module
from lorekeep.sources.index import IndexConflict, SearchIndex


def rows(spark, *given):
    return spark.createDataFrame(list(given), "id long, content_hash string, title string")


@pytest.fixture
def index(spark, tmp_path):
    counted = []
    made = SearchIndex(spark, f"file://{tmp_path}/index", lambda r: counted.append(1) or r.withColumn("embedding", F.concat(F.lit("v:"), "content_hash")))
    return made


def seen(view):
    return {r["id"]: (r["title"], r["embedding"]) for r in view.collect()}


def test_versions(spark, index):
    assert index.read() is None
    index.build(rows(spark, (1, "a", "one"), (2, "b", "two")))
    old = index.read()
    index.update(rows(spark, (1, "a", "ONE"), (2, "B", "two"), (3, "c", "three")))
    assert seen(index.read()) == {1: ("ONE", "v:a"), 2: ("two", "v:B"), 3: ("three", "v:c")}
    index.delete(rows(spark, (2, "", ""), (9, "", "")).select("id"))
    assert set(seen(index.read())) == {1, 3}
    index.update(rows(spark, (2, "b", "back")))
    assert seen(index.read())[2] == ("back", "v:b")
    assert seen(old) == {1: ("one", "v:a"), 2: ("two", "v:b")}  # an earlier reader goes on


def test_failed_build_leaves_the_old_index(spark, index):
    index.build(rows(spark, (1, "a", "one")))
    with pytest.raises(ValueError):
        index.build(rows(spark, (1, "a", "one"), (1, "b", "two")))
    index.embed = lambda r: r.where("id = 1").withColumn("embedding", F.lit("x"))  # loses rows
    with pytest.raises(ValueError):
        index.build(rows(spark, (1, "a", "one"), (2, "b", "two")))
    assert seen(index.read()) == {1: ("one", "v:a")}


def test_of_two_writers_one_is_refused(spark, index):
    index.build(rows(spark, (1, "a", "one")))
    number, layers = index.current()
    index.update(rows(spark, (2, "b", "two")))
    with pytest.raises(IndexConflict):
        index._publish(number + 1, layers)
    assert set(seen(index.read())) == {1, 2}


def test_layers_are_merged(spark, index, monkeypatch):
    monkeypatch.setattr(module, "MOST_LAYERS", 2)
    index.build(rows(spark, (1, "a", "one")))
    for k in range(2, 6):
        index.update(rows(spark, (k, "x", "t"), (1, "a", f"one {k}")))
        assert len(index.current()[1]) <= 2
    assert set(seen(index.read())) == {1, 2, 3, 4, 5} and seen(index.read())[1] == ("one 5", "v:a")
    index.build(rows(spark).limit(0))
    assert index.read().count() == 0
