"""Embedding whitening by TSQR: exact sums centre the rows, each partition is factored, R factors merge as a tree.

Components become whole numbers x = floor(scale * c) + shift, so sums over any number of rows are exact. A task
holds BLOCK centred rows and its R factor, and factors them together again and again: its memory stays at a few
blocks. R factors merge FAN at a time, a round of Spark tasks each, until one is left; its singular values and right
vectors are the spread and the axes of all rows. The covariance is never formed: with a shift a hundred times as
large as the spread its digits would cancel, while the centred rows keep them.

The check value comes from the written rows: means of the whitened components first, then the centred products.

Defined results: null and empty vectors, and vectors with null or non-finite entries, take no part; among vectors of
several lengths the most frequent length takes part (the smaller one of two); x is held to the range of a long behind
the scaling; each row of a repeated or null vec_id counts and is returned; an axis without spread (under 1e-12 of the first one's
singular value, as a single vector or equal vectors have) gives whitened null and is left out of identity_error; a deviation beyond a
long is null; an axis's largest entry is positive; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import staged, unstage

BLOCK = 4096
FAN = 32
#: Singular values below this share of the first one are no spread.
NO_SPREAD = 1e-12


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): scale * c of each entry as double, for vectors of finite entries only."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda c: F.lit(float(scale)) * c.cast("double")).alias("v"))


def _whole(lists: pa.ListArray, dims: int, shift: int) -> np.ndarray:
    """x of a block of vectors, as a matrix of longs."""
    flat = np.floor(lists.flatten().to_numpy())
    return (np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64) + shift).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def exact_sums(vectors: DataFrame, dims: int, shift: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension; one row per dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = [0] * dims, 0
        for batch in _blocks(batches):
            x = _whole(batch.column("v"), dims, shift)
            high, low = x >> 31, x & ((1 << 31) - 1)  # halves of a block's numbers can't overflow
            total = [t + (int(h) << 31) + int(low_) for t, h, low_ in zip(total, high.sum(0), low.sum(0), strict=True)]
            rows += len(x)
        names = ["dim", "n", "high", "low"]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([rows] * dims, pa.int64()), pa.array([t >> 40 for t in total], pa.int64()), pa.array([t & ((1 << 40) - 1) for t in total], pa.int64())], names=names)

    parts = vectors.mapInArrow(run, "dim int, n long, high long, low long").groupBy("dim")
    wide = {c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")}
    found = sorted(parts.agg(F.sum("n").alias("n"), *wide.values()).collect(), key=lambda r: r["dim"])
    return (int(found[0]["n"]) if found else 0), [(int(r["high"]) << 40) + int(r["low"]) for r in found]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: as longs where they fit, as Python integers elsewhere."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums))
    if 2 * most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares, null beyond a long."""
    dims = centred.shape[1]
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * dims < 1 << 62:
        return (centred**2).sum(1).tolist()
    exact = [int(v) for v in (centred.astype(object) ** 2).sum(1)]
    return [v if v < 1 << 63 else None for v in exact]


def _factor(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """R of rows that come a block at a time."""
    r = np.zeros((0, dims))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return r


def triangular_factor(vectors: DataFrame, dims: int, shift: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: per partition, then merged FAN at a time."""
    schema = "part long, r array<double>"
    row = pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _factor(((_centred(_whole(b.column("v"), dims, shift), n, sums) / n).astype(float) for b in _blocks(batches)), dims)
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "r": r.ravel().tolist()}], row)

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        blocks = (np.array(v.as_py(), float).reshape(-1, dims) for v in parts.column("r"))
        return pa.Table.from_pylist([{"part": key[0].as_py(), "r": _factor(blocks, dims).ravel().tolist()}], row)

    level = staged(vectors.mapInArrow(factor, schema), "r-factors")
    while (last := level.agg(F.max("part")).first()[0]) is not None and last > 0:
        merged = staged(level.select(F.floor(F.col("part") / FAN).alias("part"), "r").groupBy("part").applyInArrow(merge, schema), "r-factors")
        unstage(level)
        level = merged
    rows = level.collect()  # one factor of dims * dims entries
    unstage(level)
    return np.array(rows[0]["r"], float).reshape(-1, dims) if rows else np.zeros((0, dims))


def axes_of(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Spreads (eigenvalues, falling) and axes as rows, each with its largest entry positive."""
    _, singular, axes = np.linalg.svd(np.concatenate([r, np.zeros((max(0, r.shape[1] - len(r)), r.shape[1]))]), full_matrices=False)
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return singular**2 / n, axes * sign[:, None]


def fit(vectors: DataFrame, dims: int, shift: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(n, sums, spreads, axes) of usable vectors (vec_id, v) of equal length."""
    n, sums = exact_sums(vectors, dims, shift)
    spreads, axes = axes_of(triangular_factor(vectors, dims, shift, n, sums), n)
    return n, sums, spreads, axes


def transform(vectors: DataFrame, model: tuple[int, list[int], np.ndarray, np.ndarray], shift: int, components: int) -> DataFrame:
    """vec_id, deviation, w0, w1, ... of every vector: whitened components, null where an axis has no spread."""
    n, sums, spreads, axes = model
    dims, k = axes.shape[1], min(components, axes.shape[1])
    spread = np.sqrt(spreads[:k])
    live = spread > NO_SPREAD * spread[0]
    turn = np.where(live, axes[:k].T / np.where(live, spread, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            centred = _centred(_whole(batch.column("v"), dims, shift), n, sums)
            w = (centred / n).astype(float) @ turn
            columns = [pa.array(w[:, j]) if live[j] else pa.nulls(len(w), pa.float64()) for j in range(k)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_deviations(centred), pa.int64()), *columns], names=["vec_id", "deviation", *(f"w{j}" for j in range(k))])

    return vectors.mapInArrow(run, "vec_id long, deviation long, " + ", ".join(f"w{j} double" for j in range(k)))


def identity_error(whitened: DataFrame, names: list[str]) -> float | None:
    """The largest absolute entry of the whitened components' covariance minus the identity."""
    if not names:
        return None
    means = whitened.agg(*[F.avg(c).alias(c) for c in names]).first()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    products = whitened.agg(*[F.avg((F.col(a) - means[a]) * (F.col(b) - means[b])).alias(f"{a}{b}") for a, b in pairs]).first()
    return max(abs(products[f"{a}{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vector_col, scale)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dims = lengths[0]["d"]
    rows = rows.where(F.size("v") == dims)
    model = fit(rows, dims, shift)
    n, _, spreads, _ = model
    whitened = staged(transform(rows, model, shift, components), "whitened")
    names = whitened.columns[2:]
    spread = np.sqrt(spreads[: len(names)])
    error = identity_error(whitened, [c for c, s in zip(names, spread, strict=True) if s > NO_SPREAD * spread[0]])
    total = float(spreads.sum())
    shares = [float(e) / total if total > 0 else None for e in spreads[: len(names)]]
    listed = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(c).alias("whitened"), F.lit(s).cast("double").alias("explained")) for j, (c, s) in enumerate(zip(names, shares, strict=True))])
    out = whitened.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.explode(listed).alias("c"))
    return out.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
