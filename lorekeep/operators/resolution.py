"""Entity resolution: certain merges, survivors, merge maps, threads, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators.closure import connected_components


def certain_merges(entities: DataFrame, identifiers: DataFrame, least_name: int = 3, least_id: int = 5) -> DataFrame:
    """(entity, group): entities that share a normalised name or a strong identifier, over any number of steps.

    Entities are linked to the first holder of each key, so a key that a third of them share adds one link each.
    """
    names = entities.select("entity", F.concat(F.lit("n:"), text.normalize_name(F.col("name"))).alias("key")).where(F.length("key") >= least_name + 2)
    ids = identifiers.where(F.length("identifier") >= least_id).select("entity", F.concat(F.lit("i:"), "identifier").alias("key"))
    keys = names.union(ids).distinct()
    first = keys.groupBy("key").agg(F.min("entity").alias("head"))
    links = keys.join(first, "key").where("entity <> head").select("entity", "head")
    return connected_components(links, "entity", "head").select(F.col("vertex").alias("entity"), F.col("component").alias("group"))


def merge_map(groups: DataFrame, weights: DataFrame) -> DataFrame:
    """(entity, survivor): identifiers count a thousand each, then activity, then the longer name, then the smaller id."""
    w = Window.partitionBy("group").orderBy(F.desc(F.col("n_ids") * 1000 + F.col("activity")), F.desc("name_length"), "entity")
    best = groups.join(weights, "entity").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("group", F.col("entity").alias("survivor"))
    return groups.join(best, "group").where("entity <> survivor").select("entity", "survivor")


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends replaced; edges of a thing to itself and repeated ones go, the smallest id stays."""
    m = mapping.select(F.col("entity").alias("k"), "survivor")
    e = edges.join(m, edges["src"] == m["k"], "left").select("id", F.coalesce("survivor", "src").alias("src"), "dst", "rel")
    e = e.join(m, e["dst"] == m["k"], "left").select("id", "src", F.coalesce("survivor", "dst").alias("dst"), "rel")
    return e.where("src <> dst").groupBy("src", "dst", "rel").agg(F.min("id").alias("id"))


def threads(messages: DataFrame) -> DataFrame:
    """(thread, messages, first, last, missing): messages linked by what they answer; unknown parents count as missing.

    messages: id, parent, at.
    """
    known = messages.select(F.col("id").alias("parent_id"))
    linked = messages.join(known, messages["parent"] == known["parent_id"], "left")
    parts = connected_components(linked.where("parent_id is not null"), "id", "parent")
    named = linked.join(parts, linked["id"] == parts["vertex"], "left").withColumn("thread", F.coalesce("component", "id"))
    return named.groupBy("thread").agg(F.count("*").alias("messages"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("parent").isNotNull() & F.col("parent_id").isNull()).alias("missing"))


def merge_directory(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """One person per normalised name out of several systems: each attribute from the system with most authority.

    rows: system, authority, name and the attributes; conflicts names the attributes on which systems disagree.
    """
    keyed = rows.withColumn("person", text.normalize_name(F.col("name")))
    picked = [F.min_by(a, F.struct(F.negative("authority"), "system")).alias(a) for a in attributes]
    clash = [F.when(F.count_distinct(a) > 1, F.lit(a)) for a in attributes]
    return keyed.groupBy("person").agg(F.sort_array(F.collect_set("system")).alias("systems"), *picked, F.array_compact(F.array(*clash)).alias("conflicts"))


def similar_names(questions: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(q, name, score): names whose words share more than `least` of their trigrams with the question's.

    Only rare trigrams meet: of n trigrams, the rarest n - ceil(least * n) + 1 of either side hold a common one.
    """
    sides = questions.select(F.col("q").alias("p"), F.lit(True).alias("asked")).union(names.select("name", F.lit(False))).distinct()
    grams = sides.withColumn("g", text.word_trigrams(F.col("p")))
    one = grams.select("p", "asked", F.size("g").alias("n"), F.explode("g").alias("t"))
    held = one.join(one.groupBy("t").agg(F.count("*").alias("seen")), "t").withColumn("place", F.row_number().over(Window.partitionBy("p", "asked").orderBy("seen", "t")))
    rare = held.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    side = lambda df, asked, c, *more: df.where(F.col("asked") == asked).select(F.col("p").alias(c), *more)
    meet = side(rare, True, "q", "t", F.col("n").alias("nq")).join(side(rare, False, "name", "t", F.col("n").alias("nn")), "t")
    fits = meet.where(F.least("nq", "nn") >= F.lit(least) * F.greatest("nq", "nn")).select("q", "name").distinct()
    whole = fits.join(side(grams, True, "q", F.col("g").alias("gq")), "q").join(side(grams, False, "name", F.col("g").alias("gn")), "name")
    return whole.select("q", "name", text.jaccard(F.col("gq"), F.col("gn")).alias("score")).where(F.col("score") > least)


def lookup_cascade(questions: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(q, leg, name, score): what each question means, by the first leg that finds something.

    Legs: 1 the exact name (1.0), 2 an alias (0.95), 3 similar trigrams (their share, the highest first), 4 a first word that one
    name alone begins with (0.5). Ties go to the smaller name; questions that nothing fits have no row. Case doesn't count.
    """
    lower = F.lower(F.trim("q"))
    exact = questions.withColumn("k", lower).join(names.withColumn("k", F.lower("name")), "k").select("q", F.lit(1).alias("leg"), "name", F.lit(1.0).alias("score"))
    alias = questions.withColumn("k", lower).join(aliases.withColumn("k", F.lower("alias")), "k").select("q", F.lit(2), "name", F.lit(0.95))
    similar = similar_names(questions, names).select("q", F.lit(3), "name", "score")
    first = names.groupBy(F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("k")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).where("n = 1")
    by_first = questions.withColumn("k", lower).join(first, "k").select("q", F.lit(4), "name", F.lit(0.5))
    found = exact.union(alias).union(similar).union(by_first)
    best = found.groupBy("q").agg(F.min(F.struct("leg", (-F.col("score")).alias("less"), "name")).alias("b"))
    return best.select("q", "b.leg", "b.name", (-F.col("b.less")).alias("score"))
