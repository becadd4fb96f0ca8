"""Quality rules: rule statistics of each text, and an isolation forest over them.

Statistics come from numpy passes over whole texts in Arrow batches; no shuffle moves text. The
forest's splits depend on the range of all labelled rows alone; every ordinary row of two thirds of them is then
counted in its leaves, inside tasks, and the cut-off is the exact rank of a score among all rows of the third that
the forest has not seen. Ranges, leaf counts and bucket counts reach the driver, as many at any number of rows.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than 50
words); texts of any length are counted whole; repeated doc_ids give one row each; an empty table gives no rows; without labels the
forest is empty and only the base rule decides; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import mix, shingle_hashes, span_hashes, text_chunks, words
from lorekeep.llm.tokens import forget
from lorekeep.session import staged, unstage

TREES = 150
DEPTH = 8
#: Share of labelled good rows that the calibrated cut-off may reject.
GOOD_LOSS = 0.003
MIN_WORDS = 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?@=/\\{}[]_~^+;:"]] = True


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def rule_stats(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each document of a chunk: the five STATS, and rates for the forest."""
    starts, ends, first = words(data, offs)
    n_words = np.diff(first)
    heads = (data & 0xC0) != 0x80
    solid = np.ones(len(data), bool)
    solid[(data == 0x20) | ((data >= 9) & (data <= 13))] = False
    word_chars = _per_doc(heads & solid, offs)
    symbols = _per_doc(_SYMBOL[data], offs)

    cut = np.flatnonzero(data == 0x0A)
    doc_starts = offs[:-1]
    line_starts = np.concatenate([doc_starts, cut + 1])
    line_docs = np.concatenate([np.arange(len(doc_starts)), np.searchsorted(offs, cut, "right") - 1])
    order = np.lexsort((line_starts, line_docs))
    line_starts, line_docs = line_starts[order], line_docs[order]
    line_ends = np.empty(len(line_starts), np.int64)
    if len(line_starts):
        same = line_docs[1:] == line_docs[:-1]
        line_ends[:-1] = np.where(same, line_starts[1:] - 1, offs[line_docs[:-1] + 1])
        line_ends[-1] = offs[-1]
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_docs = line_starts[filled], line_ends[filled], line_docs[filled]
    lines = np.bincount(line_docs, minlength=len(n_words))
    keys = span_hashes(data, line_starts, line_ends) + mix(line_docs.astype(np.uint64) + np.uint64(7))
    _, kept = np.unique(keys, return_index=True)
    dup_lines = lines - np.bincount(line_docs[kept], minlength=len(n_words))

    hashes = span_hashes(data, starts, ends)
    grams, begin = shingle_hashes(hashes, first, 3, whole=False)
    docs = np.repeat(np.arange(len(n_words)), np.diff(begin))
    grams = grams + mix(docs.astype(np.uint64) + np.uint64(7))
    order = np.argsort(grams)
    ranked = grams[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(grams) + 2, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    at = at - begin[docs[at]] + first[docs[at]]
    covered = np.zeros(len(starts) + 2, bool)
    for j in range(3):
        covered[at + j] = True
    repeat = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(covered[: len(starts)], out=repeat[1:])
    repeat = repeat[first[1:]] - repeat[first[:-1]]

    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeat], 1).astype(np.int64)
    w = np.maximum(n_words, 1)
    chars = np.maximum(word_chars, 1)
    caps = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(_UPPER[data[starts]], out=caps[1:])
    features = np.stack(
        [
            symbols / w,
            _per_doc(_UPPER[data], offs) / chars,
            _per_doc(_MARK[data], offs) / w,
            _per_doc(_DIGIT[data], offs) / chars,
            dup_lines / np.maximum(lines, 1),
            repeat / w,
            word_chars / w,
            (caps[first[1:]] - caps[first[:-1]]) / w,
        ],
        1,
    ).astype(np.float64)
    return counts, np.sqrt(features)


def split_box(low: np.ndarray, high: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Complete binary trees over the box [low, high] as flat arrays: each node splits a random feature uniformly inside its own box."""
    rng = np.random.default_rng(seed)
    size = (1 << (DEPTH + 1)) - 1
    feature = np.full((TREES, size), -1, np.int16)
    split = np.zeros((TREES, size))
    able = np.flatnonzero(high > low)
    for t in range(TREES if len(able) else 0):
        boxes = {0: (low, high)}
        for node in range((1 << DEPTH) - 1):
            lo, hi = boxes.pop(node)
            f = rng.choice(able)
            cut = rng.uniform(lo[f], hi[f])
            feature[t, node], split[t, node] = f, cut
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[f] = right_lo[f] = cut
            boxes[2 * node + 1], boxes[2 * node + 2] = (lo, left_hi), (right_lo, hi)
    return {"feature": feature, "split": split}


def _leaves(forest: dict[str, np.ndarray], rows: np.ndarray) -> Iterator[np.ndarray]:
    """The node of each tree in which each row ends."""
    at_row = np.arange(len(rows))
    for feature, split in zip(forest["feature"], forest["split"], strict=True):
        node = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (rows[at_row, np.maximum(f, 0)] >= split[node]))
        yield node


def leaf_counts(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many rows end in each node of each tree."""
    return np.stack([np.bincount(node, minlength=forest["feature"].shape[1]) for node in _leaves(forest, rows)])


def settle(forest: dict[str, np.ndarray], counts: np.ndarray) -> dict[str, np.ndarray]:
    """The forest with the lengths of its paths, from how many ordinary rows end in each leaf.

    What lies away from every ordinary row soon falls into a branch that holds none and ends there. A leaf keeps its
    depth plus the expected depth of its rows.
    """
    held = counts.astype(np.int64)
    for node in range((1 << DEPTH) - 2, -1, -1):
        held[:, node] += held[:, 2 * node + 1] + held[:, 2 * node + 2]
    depth = np.log2(np.arange(held.shape[1]) + 1).astype(np.int64)
    feature = np.where(held <= 1, np.int16(-1), forest["feature"])
    return {"feature": feature, "split": forest["split"], "length": depth + _expected(held), "norm": _expected(held[0, 0])}


def grow_forest(rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Isolation trees that split the box [low, high], the range of all labelled rows, and hold all the given ordinary rows."""
    forest = split_box(low, high, seed)
    return settle(forest, leaf_counts(forest, rows))


def _expected(n: np.ndarray) -> np.ndarray:
    m = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m)


def anomaly(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / expected path length): near 1 for rows that split off early."""
    total = np.zeros(len(rows))
    for node, length in zip(_leaves(forest, rows), forest["length"], strict=True):
        total += length[node]
    return np.exp2(-total / len(forest["feature"]) / max(float(forest["norm"]), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut-off that rejects most bad rows while losing at most GOOD_LOSS of the good ones."""
    if not good.any() or good.all():
        return float("inf")
    fine = np.sort(scores[good])
    return float(np.nextafter(fine[_last_kept(len(fine))], 2))


def _last_kept(n: int) -> int:
    """The rank (from 0) of the last of n good rows that the cut-off keeps."""
    return max(0, int(np.ceil(n * (1 - GOOD_LOSS))) - 1)


def ranked_score(scores: DataFrame, rank: int) -> float:
    """The score of a rank (from 0) among all scores from 0 to 1, by counts of ever narrower buckets."""
    low, high = 0.0, 1.0
    while True:
        bucket = F.floor((F.col("score") - low) / ((high - low) / 1000)).alias("bucket")
        inside = scores.where(F.col("score").between(low, high))
        for r in inside.groupBy(bucket).agg(F.count("*").alias("n"), F.min("score").alias("a"), F.max("score").alias("z")).orderBy("bucket").collect():
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["a"], r["z"]
        if low == high:
            return low


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, ..., quality, toxic) of at most `rows` labelled documents, chosen by hash."""
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    drop = [c for c in documents.columns if c in ("quality", "toxic")]
    return documents.drop(*drop).join(F.broadcast(picked), "doc_id")


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            counts, features = rule_stats(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(counts[:, 0]), pa.array(list(features), pa.list_(pa.float64()))], names=["doc_id", "n_words", "f"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[dict, float]:
    """Forest and cut-off from all labelled documents of 50 words and more.

    A third of them, by the hash of their ids, is held back for the cut-off.
    """
    spark: SparkSession = documents.sparkSession
    kinds = dict(documents.dtypes)
    stats = documents.select("doc_id", "text").mapInArrow(_features_of, f"doc_id {kinds['doc_id']}, n_words long, f array<double>")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    rows = stats.where(f"n_words >= {MIN_WORDS}").join(known, "doc_id").select("good", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), "f")
    rows = staged(rows, "quality-features")
    try:
        width = range(rows.select(F.max(F.size("f"))).first()[0] or 0)
        box = rows.agg(F.count_if(F.col("good") & ~F.col("held")).alias("n"), *[F.min(F.col("f")[i]).alias(f"a{i}") for i in width], *[F.max(F.col("f")[i]).alias(f"z{i}") for i in width]).first()
        if not box["n"]:
            return {}, float("inf")
        splits = split_box(*(np.array([box[f"{side}{i}"] for i in width]) for side in "az"))
        trees, shape = spark.sparkContext.broadcast(splits), splits["feature"].shape

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += leaf_counts(trees.value, _matrix(batch.column("f")))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["place", "n"])

        counts = np.zeros(shape, np.int64).ravel()
        for r in rows.where("good and not held").select("f").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            counts[r["place"]] = r["n"]
        forest = settle(splits, counts.reshape(shape))
        grown = spark.sparkContext.broadcast(forest)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(anomaly(grown.value, _matrix(batch.column("f"))))], names=["good", "score"])

        scores = staged(rows.where("held").select("good", "f").mapInArrow(score, "good boolean, score double"), "quality-scores")
        seen = scores.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
        cut = float("inf")
        if 0 < seen["good"] < seen["n"]:
            cut = float(np.nextafter(ranked_score(scores.where("good"), _last_kept(seen["good"])), 2))
        unstage(scores)
        return forest, cut
    finally:
        unstage(rows)


def score_rules(documents: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every document with its rule counts, the forest's anomaly score and the verdict.

    Columns: doc_id, the five STATS, base_failed, anomaly, kept, then the carried columns.
    """
    spark: SparkSession = documents.sparkSession
    forest, cut = fit(documents, labels)
    model = spark.sparkContext.broadcast((forest, cut))
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        forest, cut = model.value
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                counts, features = rule_stats(data, offs)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
                odd = anomaly(forest, features) if forest else np.zeros(len(counts))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(odd), pa.array(~failed & (odd < cut)), *(part.column(c) for c in carry)],
                    names=["doc_id", *STATS, "base_failed", "anomaly", "kept", *carry],
                )

    source = documents.select("doc_id", "text", *[c for c in carry if c != "text"])
    kinds = dict(source.dtypes)
    schema = f"doc_id {kinds['doc_id']}, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, anomaly double, kept boolean"
    schema += "".join(f", `{c}` {kinds[c]}" for c in carry)
    return source.mapInArrow(run, schema)


def filter_by_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    names = [c for c in documents.columns if c != "doc_id"]
    renamed = documents.select("doc_id", *[F.col(f"`{c}`").alias("text" if c == "text" else f"own_{i}") for i, c in enumerate(names)])
    out = score_rules(renamed, labels, carry=[c for c in renamed.columns if c != "doc_id"])
    kept = out.where("kept").select("doc_id", *[F.col("text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(names)])
    return kept.select(*[f"`{c}`" for c in documents.columns])
