"""Exact top-k by inner product: columnar branch-and-bound.

A task holds a block of candidates in vertical layout, one row per dimension, dimensions in order of
their spread so that the telling ones come first. For a block of queries the scores are accumulated
over blocks of dimensions. After each, the mass that remains (the Cauchy-Schwarz bound of the
dimensions to come) caps what a candidate can still reach; candidates that cannot pass the k-th best
score known are dropped and the survivors compacted. Vectors whose norm is at most EXACT_NORM have products
below 2**53, which doubles hold exactly; pairs with a longer vector are multiplied as Python integers.

The queries are a stated set and pass against all rows in blocks: each pass takes the next PASS_QUERIES from the
table, broadcasts them (a few megabytes), and writes each task's k best per query to the shared folder.
So driver, plan and broadcasts stay the same size however many queries there are.

Defined results: null vectors, and vectors with null or non-finite components, take no part; components are
held to the range of a long behind the scaling, and so are scores; vectors of another length than the query's
are not compared with it; a query is matched with every row but those of its own id; of several rows of one
query id the smallest vector is asked; rows of a repeated id are candidates each; equal scores go to the
smaller id; with fewer rows than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import shared_dir, staged

PASS_QUERIES = 8192
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
DIMENSION_BLOCK = 8
EXACT_NORM = float(1 << 26)
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): scale * x of each component as double, for vectors of finite components only."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.lit(float(scale)) * x.cast("double")).alias("v"))


def floors(x: np.ndarray) -> np.ndarray:
    """Whole components as doubles, held to the range of a long."""
    return np.clip(np.floor(x), -(2.0**63), 2.0**63 - 1024)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of rows of equal length, CANDIDATE_BLOCK rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
            part = batch.slice(at, CANDIDATE_BLOCK)
            ids = part.column("vec_id").to_numpy()
            lists = part.column("v")
            sizes = lists.value_lengths().to_numpy()
            flat = floors(lists.flatten().to_numpy())
            begin = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                yield ids[rows], flat[begin[rows][:, None] + np.arange(d)]


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows**2).sum(1))


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows of a candidate block that may be among its k best: (query, rows, scores).

    floor: the k-th best score that each query has so far; ties with it stay, as ids decide them.
    """
    order = np.argsort(-block.var(0), kind="stable")
    columns = np.ascontiguousarray(block[:, order].T)
    asked = queries[:, order]
    dims = len(order)
    cuts = list(range(0, dims, DIMENSION_BLOCK)) + [dims]
    rest = {c: (np.sqrt((columns[c:] ** 2).sum(0)), np.sqrt((asked[:, c:] ** 2).sum(1))) for c in cuts[1:-1]}
    first = cuts[1]
    for part in range(0, len(asked), QUERY_BLOCK):
        partial = asked[part : part + QUERY_BLOCK, :first] @ columns[:first]
        for q in range(part, part + len(partial)):
            own = ids != query_ids[q]
            alive, scores = np.flatnonzero(own), partial[q - part][own]
            least = floor[q]
            for c, d in zip(cuts[1:-1], cuts[2:], strict=True):
                mass, of_query = rest[c]
                reach = mass[alive] * of_query[q]
                if len(alive) > k:  # the k-th best that candidates reach at the least
                    least = max(least, np.partition(scores - reach, len(alive) - k)[len(alive) - k])
                keep = scores + reach + 1e-6 * (1 + abs(least) if np.isfinite(least) else 1) >= least
                alive, scores = alive[keep], scores[keep]
                if not len(alive):
                    break
                scores = scores + asked[q, c:d] @ columns[c:d, alive]
            keep = scores >= least if len(alive) else np.zeros(0, bool)
            if keep.any():
                yield q, alive[keep], scores[keep].astype(np.int64)


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as Python integers, held to the range of a long."""
    own = [int(x) for x in query]
    return np.array([min(max(sum(a * int(b) for a, b in zip(own, row, strict=True)), -_LONG - 1), _LONG) for row in rows.tolist()], np.int64)


def _found(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """best_of_block over vectors of exact doubles, and every product with a longer one."""
    with np.errstate(over="ignore"):
        plain, fine = _norms(queries) <= EXACT_NORM, _norms(block) <= EXACT_NORM
    few, many = np.flatnonzero(plain), np.flatnonzero(fine)
    if len(few) and len(many):
        for q, rows, scores in best_of_block(query_ids[few], queries[few], ids[many], block[many], floor[few], k):
            yield int(few[q]), many[rows], scores
    for q in range(len(queries)):
        rows = np.flatnonzero((ids != query_ids[q]) & (~fine if plain[q] else np.ones(len(ids), bool)))
        if len(rows):
            yield q, rows, _exact(queries[q], block[rows])


def _search(candidates: DataFrame, query_ids: np.ndarray, queries: list[np.ndarray], k: int, path: str) -> None:
    """Append each task's k best candidates of each query to a table: query_id, vec_id, score."""
    shared = candidates.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        sizes = np.array([len(q) for q in queries])
        groups = {d: (np.flatnonzero(sizes == d), np.array([q for q in queries if len(q) == d])) for d in np.unique(sizes)}
        floor = np.full(len(queries), -np.inf)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, block in _blocks(batches):
            if block.shape[1] not in groups:
                continue
            at, asked = groups[block.shape[1]]
            for q, rows, scores in _found(query_ids[at], asked, ids, block, floor[at], k):
                n = int(at[q])
                have = best.get(n, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                all_ids, all_scores = np.concatenate([have[0], ids[rows]]), np.concatenate([have[1], scores])
                top = np.lexsort((all_ids, ~all_scores))[:k]  # ~x falls as x rises, without overflow
                best[n] = all_ids[top], all_scores[top]
                if len(top) == k:
                    floor[n] = best[n][1][-1]
        for n, (found, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query_ids[n])), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    candidates.mapInArrow(run, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
    shared.destroy()


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest scores of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, scale)
    asked = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    path = f"{shared_dir(spark)}/staged/best-{uuid.uuid4().hex[:12]}"
    low = None
    while True:  # one pass per block of queries, in order of their ids
        part = asked if low is None else asked.where(F.col("vec_id") > low)
        block = part.orderBy("vec_id").limit(PASS_QUERIES).collect()
        if block or low is None:
            _search(rows, np.array([r["vec_id"] for r in block], np.int64), [floors(np.array(r["v"])) for r in block], k, path)
        if len(block) < PASS_QUERIES:
            break
        low = block[-1]["vec_id"]
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
