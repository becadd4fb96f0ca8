"""Token counts of whole texts by a sentencepiece BPE file, with overlap resynchronisation of huge texts.

A text of more than CHUNK characters becomes chunks, each reaching `overlap` characters into the next
one, that any task may encode. Neighbours both see the overlap. A token that stands at the same place in
both encodings is a splice: every two tokens that meet in "the left chunk up to it, the right chunk behind it"
meet in one of the two encodings as well, and a BPE segmentation is the only one of its text in which every
two neighbours stay as they are when encoded together. Pieces of white space alone are no splices: they share
one rank, so that this doesn't hold for them. Per chunk only a count and the overlaps' tokens are written;
the splices are an equi-join of these, and a text's count is the sum over its chunks less what the splices
see twice. Texts with an overlap that holds no splice (runs of one letter, say) go round again with overlaps
and chunks four times as wide, until they align or are one chunk; only the number of such texts reaches the driver.

Inside a chunk text is cut before each space behind another character. No piece of the vocabulary crosses such a
place (checked when it is loaded; otherwise nothing is cut), so the parts' counts add up; a worker remembers the
counts of short parts in a dictionary of bounded size.

Defined results: a null or empty text has 0 tokens and 0 bytes; equal texts have equal counts, and repeated
rows stay as many; strings of special tokens are ordinary text; a null doc_id stays null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import text_chunks
from lorekeep.session import staged, unstage

CHUNK = 1 << 16
OVERLAP = 512
#: Characters of a part whose count is remembered, and bytes that a worker's dictionary may take.
SHORT_PART = 48
CACHE_BYTES = 128 << 20
ENTRY_BYTES = 130
SPACE = "▁"
_ZONE = "array<struct<at: long, n: int, id: int, upto: long>>"
_ENCODED = f"key string, chunk int, chunks int, n_tokens long, before {_ZONE}, behind {_ZONE}"


class Counter:
    """Counts and places of a vocabulary's tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self._chars = [len(p) for p in pieces]
        for i, p in enumerate(pieces):
            if self._model.is_byte(i):  # a character ends where its last byte does; it counts at its first
                self._chars[i] = 0 if 0x80 <= int(p[1:-1], 16) < 0xC0 else 1
        self._blank = [not p.strip(SPACE) for p in pieces]
        self._front = int(self._model.encode("a", out_type=str)[0][:1] == SPACE)  # a space in front of every text
        apart = self._front and self._model.decode(self._model.encode(" a  a ")) == " a  a " and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._parts = re.compile(" *[^ ]+| +" if apart else ".+", re.DOTALL)
        self._known: dict[str, int] = {}
        self._size = 0

    def parts(self, text: str) -> list[str]:
        """The text in parts that no token crosses, each behind the space that the vocabulary puts in front of a text."""
        if SPACE in text:  # the character that stands for a space
            text = text.replace(SPACE, " ")
        return self._parts.findall(" " + text) if text else []

    def counts(self, parts: list[str]) -> list[int]:
        found = list(map(self._known.get, parts))
        if None in found:
            if self._size > CACHE_BYTES:
                self._known, self._size = {}, 0
                found = [None] * len(parts)
            gaps = [i for i, n in enumerate(found) if n is None]
            new = list({parts[i] for i in gaps})
            fresh = {p: len(ids) for p, ids in zip(new, self._model.encode([p[1:] for p in new], num_threads=1), strict=True)}
            if " " in fresh:  # a text's last space is a token of its own
                fresh[" "] = 1
            short = {p: n for p, n in fresh.items() if len(p) <= SHORT_PART}
            self._known.update(short)
            self._size += sum(2 * len(p) + ENTRY_BYTES for p in short)
            for i in gaps:
                found[i] = fresh[parts[i]]
        return found

    def tokens(self, parts: list[str], counts: list[int], lo: int, hi: int, text_at: int) -> list[tuple[int, int, int, int]]:
        """Tokens that lie between two characters of a chunk: (place in the text, characters, id, tokens of the chunk up to its end)."""
        out = []
        at = -self._front
        upto = 0
        for part, n in zip(parts, counts, strict=True):
            if at + len(part) > lo and at < hi and len(part) > 1:
                ids = self._model.encode(part[1:])
                sizes = [self._chars[i] for i in ids]
                if sum(sizes) != len(part) - 1 + self._front:  # a vocabulary that rewrites texts: places don't tell anything
                    return []
                for k, (i, size, end) in enumerate(zip(ids, sizes, accumulate(sizes), strict=True)):
                    begin = at + end - size
                    if size and not self._blank[i] and begin >= lo and at + end <= hi:
                        out.append((text_at + begin, size, i, upto + k + 1))
            at += len(part)
            upto += n
            if at >= hi:
                break
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _count_short(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of texts of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            texts = batch.column("text")
            found = []
            for lo, hi, _, _ in text_chunks(texts):
                cut = [count.parts(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                numbers = iter(count.counts([p for parts in cut for p in parts]))
                found += [sum(next(numbers) for _ in parts) for parts in cut]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return documents.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def chunk_rows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows (key, chunk, chunks, body) of texts (key, doc_id, text); every body but the last reaches into the next one.

    They are dealt by doc_id as well, so that copies of one text don't meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name, text in zip(batch.column("key"), batch.column("doc_id"), batch.column("text"), strict=True):
                body = text.as_py()
                n = max(1, -(-len(body) // chunk))
                for i in range(n):
                    part = body[i * chunk : (i + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pylist([{"key": key.as_py(), "doc_id": name.as_py(), "chunk": i, "chunks": n, "body": part}], schema)

    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("body", pa.string())])
    return texts.select("key", "doc_id", "text").mapInArrow(run, "key string, doc_id long, chunk int, chunks int, body string").repartition("key", "chunk", "doc_id")


def encode_chunks(rows: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's count and its tokens in the overlaps: before (with the chunk before it) and behind (with the next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            for row in batch.to_pylist():
                parts = count.parts(row["body"])
                counts = count.counts(parts)
                at = row["chunk"] * chunk
                zones = []
                for lo, there in ((0, row["chunk"] > 0), (chunk, row["chunk"] + 1 < row["chunks"])):
                    found = count.tokens(parts, counts, lo, lo + overlap, at) if there else []
                    zones.append([dict(zip(("at", "n", "id", "upto"), t, strict=True)) for t in found])
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "chunk": row["chunk"], "chunks": row["chunks"], "n_tokens": sum(counts), "before": zones[0], "behind": zones[1]}], schema)

    zone = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32()), ("id", pa.int32()), ("upto", pa.int64())]))
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("n_tokens", pa.int64()), ("before", zone), ("behind", zone)])
    return rows.mapInArrow(run, _ENCODED)


def spliced(encoded: DataFrame) -> DataFrame:
    """key, n_tokens, aligned of encoded chunks: the counts less what neighbours see twice at their first common token."""
    left = encoded.select("key", (F.col("chunk") + 1).alias("chunk"), (F.col("n_tokens")).alias("left_tokens"), F.explode("behind").alias("t"))
    right = encoded.select("key", "chunk", F.explode("before").alias("t"))
    places = ["key", "chunk", "at", "n", "id"]
    left = left.select("key", "chunk", "t.at", "t.n", "t.id", (F.col("left_tokens") - F.col("t.upto")).alias("left_rest"))
    right = right.select("key", "chunk", "t.at", "t.n", "t.id", F.col("t.upto").alias("right_upto"))
    splices = left.join(right, places).groupBy("key", "chunk").agg(F.min_by(F.col("left_rest") + F.col("right_upto"), "at").alias("twice"))
    splices = splices.groupBy("key").agg(F.sum("twice").alias("twice"), F.count("*").alias("splices"))
    totals = encoded.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"), F.max("chunks").alias("chunks"))
    met = F.coalesce("splices", F.lit(0)) + 1 == F.col("chunks")
    return totals.join(splices, "key", "left").select("key", (F.col("n_tokens") - F.coalesce("twice", F.lit(0))).alias("n_tokens"), met.alias("aligned"))


def count_long(texts: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_tokens of the texts (key, doc_id, text), equal keys meaning equal texts; rounds of wider overlaps until all align."""
    done = None
    while True:
        encoded = staged(encode_chunks(chunk_rows(texts, chunk, overlap), model, chunk, overlap).dropDuplicates(["key", "chunk"]), "chunk-counts")
        found = staged(spliced(encoded), "spliced-counts")
        unstage(encoded)
        part = found.where("aligned").select("key", "n_tokens")
        done = part if done is None else done.unionByName(part)
        failing = found.where(~F.col("aligned")).select("key")
        if failing.isEmpty():
            return done
        texts = texts.join(failing, "key", "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)


def count_tokens(documents: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    huge = F.length("text") > chunk
    long_rows = rows.where(huge).withColumn("key", F.sha2("text", 256))
    counted = count_long(long_rows, model, chunk, overlap)
    joined = long_rows.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return _count_short(rows.where(~huge), model).unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
