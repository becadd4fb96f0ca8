"""Ids that hang on the wrong thing: rows whose name doesn't fit the holder of their id, where they belong, and what goes with them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators.load import name_fits
from lorekeep.session import staged


class Repair(NamedTuple):
    """What a repair finds and what is left of ids and links."""

    shared: DataFrame  # type, system, ext: ids that rows of one table give to names which can't be one thing
    fixes: DataFrame  # type, system, ext, row_name, holder, into (null: queued for a person)
    identifiers: DataFrame  # entity, type, system, value
    links: DataFrame  # relationship, source, target


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _fits(a: Column, b: Column, kind: Column) -> Column:
    return F.when(kind == "Person", name_fits(a, b, True)).otherwise(name_fits(a, b))


def shared_ids(rows: DataFrame) -> DataFrame:
    """(type, system, ext) of ids whose rows (type, system, ext, norm) have two names that can't be one thing.

    Each name is held against the id's first one; only ids whose names all fit that one compare them in pairs.
    """
    keys = ["type", "system", "ext"]
    names = rows.where("norm <> ''").select(*keys, "norm").distinct()
    first = names.groupBy(*keys).agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1")
    judged = names.join(first, keys).withColumn("fit", _fits(F.col("norm"), F.col("first"), F.col("type")))
    plain = judged.where("not fit").select(*keys).distinct()
    left = judged.join(plain, keys, "left_anti").where("norm <> first").select(*keys, "norm")
    pairs = left.join(left.withColumnRenamed("norm", "other"), keys).where("norm < other")
    return plain.union(pairs.where(~_fits(F.col("norm"), F.col("other"), F.col("type"))).select(*keys)).distinct()


def repair_ids(rows: DataFrame, names: DataFrame, identifiers: DataFrame, links: DataFrame, row_links: DataFrame) -> Repair:
    """Repair of the ids of things after lists of several systems were loaded.

    rows: row, type, system, ext, row_name, universal (ids that mean the same everywhere); names: entity, type, name (all a thing is
    called); identifiers: entity, type, system, value; links: relationship, source, target; row_links: row, relationship, target, the
    links that a row made. A row whose name fits no name of its id's holder, and that shares no universal id with it, belongs
    to the thing with its universal id, else to the only other thing of its name, else to a queue. Its id goes with it, and so do its links,
    unless a row of the holder's own makes them as well. Ids that name several things are nobody's; null names and ids count as empty.
    """
    rows = rows.select("row", "type", "system", _key(F.coalesce("ext", F.lit(""))).alias("ext"), F.coalesce("row_name", F.lit("")).alias("row_name"), F.transform(F.coalesce("universal", F.array().cast("array<string>")), _key).alias("universal"))
    rows = staged(rows.withColumn("norm", text.normalize_name(F.col("row_name"))).where("ext <> ''"), "id-rows")
    shared = staged(shared_ids(rows), "shared-ids")
    held = staged(identifiers.select("entity", "type", "system", _key(F.col("value")).alias("value"), F.col("value").alias("said")).distinct(), "held-ids")
    known = names.select("entity", "type", text.normalize_name(F.col("name")).alias("known")).where("known <> ''").distinct()
    single = rows.join(shared, ["type", "system", "ext"], "left_anti")
    placed = single.join(held.select(F.col("entity").alias("holder"), "type", "system", F.col("value").alias("ext")), ["type", "system", "ext"])
    universal = placed.select("row", "holder", "type", F.explode("universal").alias("value")).join(held.select("entity", "type", "value"), ["type", "value"])
    same = universal.where("entity = holder").select("row", "holder").distinct().withColumn("same", F.lit(True))
    called = placed.join(known.withColumnRenamed("entity", "holder"), ["holder", "type"]).groupBy("row", "holder").agg(F.bool_or(_fits(F.col("norm"), F.col("known"), F.col("type"))).alias("fit"))
    judged = placed.join(same, ["row", "holder"], "left").join(called, ["row", "holder"], "left")
    own = F.col("same").isNotNull() | F.coalesce("fit", F.lit(False)) | (F.col("norm") == "")
    judged = staged(judged.withColumn("own", own), "judged-rows")
    wrong = judged.where("not own").select("row", "type", "system", "ext", "row_name", "norm", "holder")
    by_universal = universal.where("entity <> holder").groupBy("row", "holder").agg(F.min("entity").alias("elsewhere"))
    by_name = wrong.join(known.withColumnRenamed("known", "norm"), ["type", "norm"]).where("entity <> holder").groupBy("row", "holder").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("namesake")).where("n = 1").drop("n")
    fixes = wrong.join(by_universal, ["row", "holder"], "left").join(by_name, ["row", "holder"], "left").withColumn("into", F.coalesce("elsewhere", "namesake")).drop("elsewhere", "namesake", "norm")
    fixes = staged(fixes, "id-fixes")
    moved = fixes.where("into is not null")
    # an id goes to one thing: of rows that disagree the smallest
    goes = moved.groupBy("holder", "type", "system", "ext").agg(F.min("into").alias("into"))
    kept = held.join(shared.withColumnRenamed("ext", "value"), ["type", "system", "value"], "left_anti")
    kept = kept.join(goes.select(F.col("holder").alias("entity"), "type", "system", F.col("ext").alias("value"), "into"), ["entity", "type", "system", "value"], "left")
    after = kept.select(F.coalesce("into", "entity").alias("entity"), "type", "system", F.col("said").alias("value")).distinct()
    made = row_links.join(judged.where("own").select("row", "holder"), "row").select(F.col("holder").alias("source"), "relationship", "target").distinct()
    off = row_links.join(moved.select("row", F.col("holder").alias("source"), "into"), "row").select("source", "relationship", "target", "into").join(made, ["source", "relationship", "target"], "left_anti")
    off = off.groupBy("source", "relationship", "target").agg(F.min("into").alias("into"))
    linked = links.join(off, ["source", "relationship", "target"], "left").select("relationship", F.coalesce("into", "source").alias("source"), "target").where("source <> target").distinct()
    return Repair(shared, fixes.select("type", "system", "ext", "row_name", "holder", "into").distinct(), after, linked)
