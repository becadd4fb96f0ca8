"""Graph closure on edge tables: components, reachability, pointer chasing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import staged, unstage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """Label every vertex of an edge list with the smallest vertex of its component.

    Alternates the large-star and small-star steps: each rewires neighbours to the smallest vertex
    known, so the edge count never grows and the rounds are logarithmic in practice. Each round is
    written to the shared folder. Returns (vertex, component); self loops and nulls are ignored, a
    vertex that has no edge to another is absent. Only a row count and a checksum reach the driver.
    """
    kind = edges.schema[src].dataType
    cur = staged(
        edges.select(F.col(src).alias("a"), F.col(dst).cast(kind).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _fingerprint(cur)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = staged(small, "edges")
        now = _fingerprint(nxt)
        unstage(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.union(cur.select("v", "v").distinct())


def top_ancestors(nodes: DataFrame, id_col: str, parent_col: str, hops: int = 10) -> DataFrame:
    """(id, top): the last known ancestor of each node, at most `hops` steps up.

    Pointers are doubled: after r joins a node points 2**r steps up, so a few joins do for any bound. An
    unknown parent counts as none.
    """
    known = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    ids = known.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    step = known.join(ids, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).otherwise(F.col("id")).alias("up"))
    out, single, left = known.select("id", F.col("id").alias("top")), step, hops
    while left:
        if left & 1:
            out = out.join(single.select(F.col("id").alias("top"), "up"), "top").select("id", F.col("up").alias("top"))
        left >>= 1
        if left:
            single = single.join(single.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up"))
    return out


def levels(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): what start (node) reaches over edges (parent, child), at the fewest steps; start itself is at 0.

    Each round's new nodes are written out; nodes seen before don't go on, so cycles end.
    """
    seen = fresh = staged(start.select("node").distinct().withColumn("depth", F.lit(0)), "levels")
    depth = 0
    while not fresh.isEmpty():
        depth += 1
        step = fresh.join(edges, fresh["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        fresh = staged(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "levels")
        seen = seen.union(fresh)
    return seen
