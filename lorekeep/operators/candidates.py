"""Groups of entities that may be the same thing, small enough to be reviewed together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.operators.closure import connected_components
from lorekeep.session import staged

SIMILAR = 0.5


def positions(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with each row's place (from 0) in a total order: a range-partitioned sort, and the sizes of the partitions in front, a number each."""
    spot = F.monotonically_increasing_id()  # the partition, and the row's number in it
    rows = staged(df.orderBy(*order).withColumn("_spot", spot), "positions").withColumn("_part", F.shiftright("_spot", 33))
    before, fronts = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):
        fronts.append((part, before))
        before += n
    front = df.sparkSession.createDataFrame(fronts, "_part long, _front long")
    return rows.join(F.broadcast(front), "_part").withColumn(out, F.col("_front") + F.col("_spot").bitwiseAND((1 << 33) - 1)).drop("_spot", "_part", "_front")


def similar_pairs(names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(type, a, b): normal names (type, norm) that share `least` of their trigrams; only the rarest trigrams of a name meet, which is enough for any such pair."""
    grams = names.withColumn("g", text.name_trigrams(F.col("norm"))).withColumn("n", F.size("g"))
    one = grams.select("type", "norm", "n", F.explode("g").alias("t"))
    held = one.join(one.groupBy("type", "t").agg(F.count("*").alias("seen")), ["type", "t"])
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("type", "norm").orderBy("seen", "t")))
    rare = held.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("type", "t", "norm", "n")
    a, b = rare.withColumnsRenamed({"norm": "a", "n": "na"}), rare.withColumnsRenamed({"norm": "b", "n": "nb"})
    near = a.join(b, ["type", "t"]).where("a < b").where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")).select("type", "a", "b").distinct()
    share = text.jaccard(text.name_trigrams(F.col("a")), text.name_trigrams(F.col("b")))
    return near.where(share >= least)


def contained_pairs(names: DataFrame) -> DataFrame:
    """(type, a, b): normal names of which one contains the other's words, the last letters left out; a name asks by its rarest word of four letters."""
    split = names.withColumn("w", text.words(F.col("norm")))
    long_words = F.filter("w", lambda w: F.length(w) >= 4)
    begins = F.array_distinct(F.flatten(F.transform(long_words, lambda w: F.transform(F.sequence(F.lit(4), F.length(w)), lambda k: F.substring(w, F.lit(1), k)))))
    held = split.select("type", F.col("norm").alias("longer"), F.explode(begins).alias("word"))
    seen = held.groupBy("type", "word").agg(F.count("*").alias("seen"))
    asks = split.select("type", F.col("norm").alias("shorter"), F.explode(F.array_distinct(long_words)).alias("word")).join(seen, ["type", "word"])
    asks = asks.groupBy("type", "shorter").agg(F.min_by("word", F.struct("seen", "word")).alias("word"))
    met = asks.join(held, ["type", "word"]).where("shorter <> longer").where(F.size(text.words(F.col("shorter"))) <= F.size(text.words(F.col("longer"))))
    fit = met.where(text.contains_name(F.col("shorter"), F.col("longer")))
    return fit.select("type", F.least("shorter", "longer").alias("a"), F.greatest("shorter", "longer").alias("b")).distinct()


def fuzzy_groups(entities: DataFrame, small: int = rules.DEFAULTS["resolution"]["small_type_max"], most: int = rules.DEFAULTS["resolution"]["max_component"]) -> tuple[DataFrame, DataFrame]:
    """(groups: entity, group; cut: a, b): entities (entity, type, name) with similar or contained names, at most `most` in a group.

    Types of up to `small` entities are one component, as jargon shares no spelling with what it names. Larger components
    are cut into runs of neighbouring names; links between runs are listed. Entities without a link are in no group.
    Equal names are linked to the first of them, so that only distinct names meet.
    """
    named = staged(entities.withColumn("norm", text.normalize_name(F.col("name"))), "candidates")
    heads = named.where("norm <> ''").groupBy("type", "norm").agg(F.min("entity").alias("head"))
    names = heads.select("type", "norm")
    pairs = similar_pairs(names).union(contained_pairs(names)).distinct()
    head = lambda side: heads.select("type", F.col("norm").alias(side), F.col("head").alias(f"{side}_head"))
    links = pairs.join(head("a"), ["type", "a"]).join(head("b"), ["type", "b"]).select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    equal = named.join(heads, ["type", "norm"]).where("entity <> head").select(F.col("head").alias("a"), F.col("entity").alias("b"))
    sizes = named.groupBy("type").agg(F.count("*").alias("size"), F.min("entity").alias("first")).where(F.col("size").between(2, small))
    whole = named.join(sizes, "type").where("entity <> first").select(F.col("first").alias("a"), F.col("entity").alias("b"))
    links = staged(links.union(equal).union(whole).distinct(), "candidate-links")
    parts = connected_components(links, "a", "b").select(F.col("vertex").alias("entity"), "component")
    placed = positions(parts.join(named.select("entity", "norm"), "entity"), ["component", "norm", "entity"], "at")
    starts = placed.groupBy("component").agg(F.min("at").alias("start"))
    run = F.floor((F.col("at") - F.col("start")) / most)
    groups = staged(placed.join(starts, "component").select("entity", F.concat_ws("/", "component", run).alias("group")), "groups")
    side = lambda c: groups.select(F.col("entity").alias(c), F.col("group").alias(f"{c}_group"))
    cut = links.join(side("a"), "a").join(side("b"), "b").where("a_group <> b_group").select("a", "b")
    return groups, cut
