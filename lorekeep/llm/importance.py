"""Target-distribution importance resampling over hashed word runs, with overlap chunking of long texts.

Texts are read in chunks of about CHUNK bytes, split at word boundaries. A chunk carries the n - 1 words behind
its end and owns the runs that start inside it, so every run of 1..n words is counted once and runs across a
border are not lost. Chunks of long texts are dealt over all tasks; per document only their counts and weights
are summed. Bucket sums of a corpus are added inside tasks first, so that at most one row per bucket and task is
shuffled; the table of gains has one entry per bucket and is broadcast at that size, whatever the corpus.

The draw adds Gumbel noise made of a document's id to its weight and takes the highest scores, which is a draw
without replacement in proportion to the weights. Ranks come from a range-partitioned sort: each row's place in
its partition, behind the rows of the partitions in front, so that no task sees more than its range.

Defined results: a null or empty text, or one without words, has no features and weight 0; texts with fewer words
than asked take no part in the draw (rank null), nor do rows without a doc_id; rows of a repeated doc_id are
scored each, share their noise, and among equal scores and ids any order holds; without documents of enough words
nothing is drawn; an empty target gives gains by the corpus alone; an empty corpus gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import text_chunks
from lorekeep.session import staged

CHUNK = 1 << 18
#: Words of more bytes are hashed one by one, the others a byte place at a time.
SHORT_WORD = 40
#: Words are digits, letters and everything beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk of texts, and the first word of each text (with an end)."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = IN_WORD[data]
    step = np.diff(edge)
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joined = inner[(edge[inner] == 1) & (edge[inner + 1] == 1)]  # words of two texts that touch
    joined = np.unique(joined)
    starts = np.sort(np.concatenate([np.flatnonzero(step == 1), joined]))
    ends = np.sort(np.concatenate([np.flatnonzero(step == -1), joined]))
    return starts, ends, np.searchsorted(starts, offs)


def _extend(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states behind one more word each: all words a byte place at a time, long ones by themselves."""
    sizes = ends - starts
    out = state.copy()
    order = np.argsort(-sizes, kind="stable")
    n_long = int((sizes > SHORT_WORD).sum())
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[n_long:]
    at, left = starts[order], sizes[order]
    crc = out[order]
    for place in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -place, "left"))  # words with a byte here come first
        head = crc[:n]
        crc[:n] = _CRC[(head ^ data[at[:n] + place]) & np.uint32(0xFF)] ^ (head >> np.uint32(8))
    out[order] = crc
    return out


def run_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length 1..n: the words at which a run of that length starts, and the run's bucket.

    last: the end (as a word number) of each word's text. The CRC of a longer run goes on from the shorter one's.
    """
    folded = _FOLDED[data]
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.arange(len(starts))
    for length in range(1, n + 1):
        if length > 1:
            keep = at + length <= last[at]
            at, state = at[keep], state[keep]
            state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = _extend(state, folded, starts[at + length - 1], ends[at + length - 1])
        yield at, ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)


def chunk_bounds(data: np.ndarray, n: int, size: int) -> list[tuple[int, int, int]]:
    """(start, end of what the chunk owns, end with the n - 1 words carried) of a text's chunks, cut between words."""
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    if not len(starts):
        return [(0, len(data), len(data))]
    out, first = [], 0
    while first < len(starts):
        after = max(first + 1, int(np.searchsorted(starts, starts[first] + size)))
        carry = min(len(starts), after + n - 1)
        out.append((int(starts[first]), int(ends[after - 1]), int(ends[carry - 1])))
        first = after
    return out


_CHUNK_SCHEMA = "row long, doc_id long, own long, body binary"


def _long_chunks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Chunks of long texts, dealt over all tasks: row, doc_id, own (bytes that the chunk owns), body."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("own", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, name, text in zip(batch.column("row"), batch.column("doc_id"), batch.column("body"), strict=True):
                body = text.as_py()
                for begin, own, end in chunk_bounds(np.frombuffer(body, np.uint8), n, size):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([name.as_py()], pa.int64()), pa.array([own - begin], pa.int64()), pa.array([body[begin:end]])], schema=schema)

    return rows.mapInArrow(run, _CHUNK_SCHEMA).repartition("row", F.xxhash64("body"))


def _parts(texts: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(short texts, chunks of long texts), both as row, doc_id, own, body."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.select("row", "doc_id", F.octet_length("body").cast("long").alias("own"), "body")
    return rows.where(F.col("own") <= size), _long_chunks(rows.where(F.col("own") > size), n, size)


def _features(batch: pa.RecordBatch, n: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows of a batch: (first row, end row, words owned by each, [(row of each owned run, its bucket)])."""
    owns = batch.column("own").to_numpy()
    for lo, hi, data, offs in text_chunks(batch.column("body")):
        starts, ends, first = word_spans(data, offs)
        text_of = np.repeat(np.arange(hi - lo), np.diff(first))
        mine = starts - offs[text_of] < owns[lo:hi][text_of]
        found = []
        for at, bucket in run_buckets(data, starts, ends, first[1:][text_of], n, buckets):
            held = mine[at]
            found.append((text_of[at][held], bucket[held]))
        yield lo, hi, np.bincount(text_of[mine], minlength=hi - lo), found


def bucket_sums(texts: DataFrame, n: int, buckets: int, chunk: int = CHUNK) -> np.ndarray:
    """How many features of all texts lie in each bucket; one row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _features(batch, n, buckets):
                for _, bucket in found:
                    sums += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    counted = [part.select("own", "body").mapInArrow(run, "bucket long, n long") for part in _parts(texts, n, chunk)]
    out = np.zeros(buckets, np.int64)
    for r in counted[0].unionByName(counted[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier the target is to hold a bucket), one added to each bucket."""
    buckets, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    odds = [(t + 1.0) * (all_corpus + buckets) / ((s + 1.0) * (all_target + buckets)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in odds], np.int64)


def weights(texts: DataFrame, gain: np.ndarray, n: int, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; chunks of a long text are summed."""
    buckets = len(gain)
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            columns = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for lo, hi, n_words, found in _features(batch, n, buckets):
                columns[0][lo:hi] = n_words
                for row, bucket in found:
                    columns[1][lo:hi] += np.bincount(row, minlength=hi - lo)
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])  # rows come in order
                    ends = np.searchsorted(row, np.arange(hi - lo + 1))
                    columns[2][lo:hi] += np.diff(sums[ends])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, columns)], names=["row", "doc_id", "n_words", "n_features", "weight"])

    short, long_chunks = (part.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long") for part in _parts(texts, n, chunk))
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    return short.unionByName(long_chunks.groupBy("row", "doc_id").agg(*sums)).drop("row")


def draw(weighted: DataFrame, seed: str, min_words: int, percent: int) -> DataFrame:
    """score and rank: the highest `percent` of a hundred of the documents with min_words words are ranked from 1."""
    spark = weighted.sparkSession
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0))).cast("long")
    scored = staged(weighted.withColumn("score", F.col("weight") + noise), "scored-texts")
    takes_part = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    spot = F.monotonically_increasing_id()  # the partition, and the row's number in it
    ordered = staged(scored.where(takes_part).orderBy(F.desc("score"), "doc_id").withColumn("spot", spot), "ordered-texts")
    ordered = ordered.select("*", F.shiftright("spot", 33).alias("part"), F.col("spot").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    drawn = percent * sum(sizes.values()) // 100
    before, fronts = 0, []
    for part in sorted(sizes):
        fronts.append((part, before))
        before += sizes[part]
    front = F.broadcast(spark.createDataFrame(fronts, "part long, front long"))
    rank = F.col("front") + F.col("place") + 1
    ranked = ordered.join(front, "part").withColumn("rank", F.when(rank <= drawn, rank))
    others = scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(others.select(*columns))


def resample(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000, seed: str = "2024", min_words: int = 20, percent: int = 10, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every document: how like the target it is, and whether it is drawn."""
    bench = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(bucket_sums(documents, n, buckets, chunk), bucket_sums(bench, n, buckets, chunk))
    return draw(weights(documents, gain, n, chunk), seed, min_words, percent)
