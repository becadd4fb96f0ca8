"""Typed edges between things: degrees, summaries, lookups in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """(x, other, rel, outgoing): each edge from either end, so that an undirected join is an equi-join."""
    out = edges.select(F.col("src").alias("x"), F.col("dst").alias("other"), "rel", F.lit(True).alias("outgoing"))
    return out.union(edges.select("dst", "src", "rel", F.lit(False)))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("x").agg(F.count("*").alias("degree"))


def most_usual(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per key; the smallest of equally frequent ones."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counted.withColumn("rn", first).where("rn = 1").select(*keys, F.col(value).alias(name))


def single_valued(edges: DataFrame, least: int = 5, share: float = 0.85) -> DataFrame:
    """Relations in which nearly every source has one target: the exceptions are worth a look."""
    per = edges.select("rel", "src", "dst").distinct().groupBy("rel", "src").agg(F.count("*").alias("n"))
    found = per.groupBy("rel").agg(F.count("*").alias("sources"), F.avg((F.col("n") == 1).cast("double")).alias("share"))
    return found.where((F.col("sources") >= least) & (F.col("share") >= share) & (F.col("share") < 1))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def business_edges(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """The record's typed edges over the commerce tables: src, dst, rel, and the types of both ends."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    typed = lambda df, rel, s, d, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"), F.lit(s).alias("src_type"), F.lit(d).alias("dst_type"))
    placed = typed(orders, "for_customer", "order", "customer", key("o", "o_orderkey"), key("c", "o_custkey"))
    located = typed(customer, "located_in", "customer", "nation", key("c", "c_custkey"), key("n", "c_nationkey"))
    belongs = typed(nation, "belongs_to", "nation", "region", key("n", "n_nationkey"), key("r", "n_regionkey"))
    return placed.union(located).union(belongs)
