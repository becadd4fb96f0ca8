"""Token-ID output in Simple-8b: ids packed into 64-bit words behind four-bit selectors.

A table of token blocks is a folder of Parquet files, written by Spark's own committer so that lost
executors leave no half-written blocks. A block holds whole documents in ascending doc_id order:

    shard, block    place in the order (shards are ranges of doc_id)
    ids_before      ids of the shard before this block
    doc_ids         its documents; lengths: the ids of each
    words           little-endian 64-bit words: selector in the top four bits
    starts          first word of each run of RUN ids, with the ids that the word holds before the run
    escapes         ids of 60 bits and more, which words of selector 0 point to

Selectors 1..15 hold 120 zeros, or 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1 ids of 1, 2, 3, 4,
5, 6, 7, 8, 10, 12, 15, 20, 30, 60 bits. Decoding treats all words of a selector at once.

Texts are encoded where they are read; only ids are shuffled, to the range of their doc_id, two bytes each where the vocabulary allows it.

Defined results: a null or empty text is one end id; texts of any length are encoded whole and stay in one block;
rows of equal doc_id follow each other in the order of their ids' bytes; null doc_ids come first; an empty
table writes no blocks; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import text_chunks
from lorekeep.llm.tokens import encoder
from lorekeep.session import shared_dir

COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_BIT_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
BLOCK_IDS = 1 << 16
RUN = 4096
#: Bytes that a worker may remember of parts of texts: nothing else here needs much memory.
REMEMBERED_BYTES = 288 << 20
#: Ranges of ids for every shuffle partition, so that partitions come out even.
SHARDS = 3
SCHEMA = "shard int, block int, ids_before long, n_ids long, doc_ids array<long>, lengths array<long>, words binary, starts array<long>, escapes array<long>"


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, ids held before each word, escapes) of unsigned 64-bit ids: each word takes all it can."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if int(ids.max()) < len(_BIT_LENGTHS):
        bits = _BIT_LENGTHS[ids]
    else:
        bits = np.frexp((ids & np.uint64((1 << 30) - 1)).astype(np.float64))[1].astype(np.uint8)
        high = ids >> np.uint64(30)
        bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1].astype(np.uint8) + np.uint8(30), bits)
    widest = {1: np.concatenate([bits, np.zeros(128, np.uint8)])}
    for p in (1, 2, 4, 8, 16, 32):
        w = widest[p]
        widest[2 * p] = np.concatenate([np.maximum(w[:-p], w[p:]), w[-p:]])
    code = np.zeros(n, np.uint8)
    for c in range(len(COUNTS) - 1, 0, -1):  # smaller codes hold more ids and win
        size = int(COUNTS[c])
        p = 1 << (size.bit_length() - 1)
        w = widest[p]
        fits = np.maximum(w[:n], w[size - p : size - p + n]) <= np.uint8(BITS[c])
        if not fits.any() and c < 12:
            break  # the wider selectors can't fit where a narrower one didn't
        code[fits] = c
    steps = COUNTS.astype(np.uint8)[code].tobytes()
    at, i = [], 0
    push = at.append
    while i < n:
        push(i)
        i += steps[i]
    at = np.array(at)
    code = code[at]
    padded = np.concatenate([ids, np.zeros(128, np.uint64)])
    words = code.astype(np.uint64) << np.uint64(60)
    escapes = ids[at[code == 0]]
    words[code == 0] |= np.arange(len(escapes), dtype=np.uint64)
    for c in range(2, len(COUNTS)):
        rows = np.flatnonzero(code == c)
        if len(rows):
            first = at[rows]
            part = padded[first]
            for lane in range(1, int(COUNTS[c])):
                part |= padded[first + lane] << np.uint64(lane * int(BITS[c]))
            words[rows] |= part
    return words, at, escapes


def unpack_words(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The first n ids of words, all words of a selector at a time."""
    code = (words >> np.uint64(60)).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(COUNTS[code])])
    out = np.zeros(int(place[-1]), np.uint64)
    for c in range(len(COUNTS)):
        rows = np.flatnonzero(code == c)
        if not len(rows) or c == 1:
            continue
        if c == 0:
            out[place[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        lanes = np.arange(COUNTS[c])
        out[place[rows][:, None] + lanes] = (words[rows][:, None] >> (lanes * BITS[c]).astype(np.uint64)) & np.uint64((1 << int(BITS[c])) - 1)
    return out[:n]


def _bounds(source: DataFrame) -> list[float]:
    """Ids that part the documents into ranges of about equal size, from their ids alone: SHARDS for every shuffle partition."""
    n = SHARDS * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = source.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)
    return sorted(set(found))


def _encoded(source: DataFrame, tokenizer: str, end_id: int, bounds: list[float]) -> DataFrame:
    """shard, doc_id, wide, ids: the ids of each whole text with the end id, two bytes each, or four (wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, REMEMBERED_BYTES), int(end_id).to_bytes(4, "little")
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, _, _ in text_chunks(texts):
                ids = [np.frombuffer(e + end, "<u4") for e in encode.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])]
                wide = [int(x.max()) > 0xFFFF for x in ids]
                body = [(x if w else x.astype("<u2")).tobytes() for x, w in zip(ids, wide, strict=True)]
                names = batch.column("doc_id").slice(lo, hi - lo)
                # no id comes first; the ranges follow the order of ids, as rounding to doubles does too
                shard = np.where(names.is_null(), 0, np.searchsorted(bounds, names.fill_null(0).to_numpy().astype(np.float64)) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), names, pa.array(wide), pa.array(body, pa.binary())], names=["shard", "doc_id", "wide", "ids"])

    return source.mapInArrow(run, "shard int, doc_id long, wide boolean, ids binary")


def write_token_blocks(documents: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode whole texts and write their ids, in ascending doc_id order, as token blocks."""

    def flush(shard: int, block: int, before: int, ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(held).astype(np.uint64)
        words, at, escapes = pack_words(flat)
        first = np.searchsorted(at, np.arange(0, len(flat), RUN), "right") - 1
        starts = np.stack([first, np.arange(0, len(flat), RUN) - at[first]], 1).ravel()
        values = [shard, block, before, len(flat), ids, [len(h) for h in held], words.astype("<u8").tobytes(), starts, escapes.view(np.int64)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, held, size, before, block = None, [], [], 0, 0, 0
        for batch in batches:
            for own, name, wide, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "wide")), batch.column("ids"), strict=True):
                if ids and (own != shard or size >= BLOCK_IDS):
                    yield flush(shard, block, before, ids, held)
                    ids, held, size, before, block = [], [], 0, before + size, block + 1
                if own != shard:
                    shard, before, block = own, 0, 0
                ids.append(name)
                # a copy, so that a block doesn't hold on to the batches that it comes from
                held.append(np.frombuffer(body.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32))
                size += len(held[-1])
        if ids:
            yield flush(shard, block, before, ids, held)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = _encoded(source, tokenizer, end_id, _bounds(source))
    encoded.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def block_ids(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, at: int, n: int) -> np.ndarray:
    """Ids at..at+n-1 of a block: only the words of the runs that hold them are decoded."""
    if n <= 0:
        return np.zeros(0, np.uint64)
    first, skip = starts[2 * (at // RUN)], starts[2 * (at // RUN) + 1]
    last = (at + n - 1) // RUN + 1
    stop = starts[2 * last] + 1 if 2 * last < len(starts) else len(words)
    skip = int(skip) + at % RUN
    return unpack_words(words[int(first) : int(stop)], skip + n, escapes)[skip:]


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with base, the ids of all documents before each."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # a row per shard, and there are SHARDS for every shuffle partition: a bound that doesn't grow with the input
    before = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_before"))
    return blocks.join(F.broadcast(before), "shard").select("n_ids", "lengths", "doc_ids", (F.col("ids_before") + F.col("shard_before")).alias("base"), "escapes", "words", "starts")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, list[memoryview]]]:
    """doc_ids, starts, lengths and ids (little-endian 32-bit) of each block's documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in ("n_ids", "lengths", "doc_ids", "base", "escapes", "words")}
            ids = memoryview(unpack_words(np.frombuffer(row["words"].as_buffer(), "<u8"), row["n_ids"].as_py(), row["escapes"].values.to_numpy().view(np.uint64)).astype("<u4").tobytes())
            lengths = row["lengths"].values.to_numpy()
            ends = np.cumsum(lengths)
            cut = [ids[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield row["doc_ids"].values, pa.array(row["base"].as_py() + ends - lengths), pa.array(lengths), cut


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token table: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *cols, cut in _decoded(batches):
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Ids of parts of documents, decoded from their runs alone: doc_id, start, length, ids (wanted: doc_id, start, length; start in the document)."""
    lists = F.transform(F.arrays_zip("doc_ids", "lengths"), lambda x, i: F.struct(x["doc_ids"].alias("doc_id"), F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("long"), lambda a, n: a + n).alias("at")))
    held = _placed(spark, path).select("words", "starts", "escapes", F.explode(lists).alias("d")).select("d.doc_id", "d.at", "words", "starts", "escapes").join(wanted.select("doc_id", "start", "length"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("words", "starts", "escapes", "at", "start", "length")}
                ids = block_ids(np.frombuffer(row["words"].as_buffer(), "<u8"), row["starts"].values.to_numpy(), row["escapes"].values.to_numpy().view(np.uint64), row["at"].as_py() + row["start"].as_py(), row["length"].as_py())
                out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(out, pa.binary())], names=["doc_id", "start", "length", "ids"])

    kinds = dict(held.dtypes)
    return held.mapInArrow(run, f"doc_id long, start {kinds['start']}, length {kinds['length']}, ids binary")


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token blocks of all documents to the shared folder and digest what is read back."""
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_token_blocks(documents, tokenizer, path, end_id)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *cols, cut in _decoded(batches):
            yield pa.RecordBatch.from_arrays([*cols, pa.array([zlib.crc32(x) for x in cut], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
