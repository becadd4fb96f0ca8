"""Packing by Karmarkar-Karp multiway differencing.

A task gathers encoded documents until they fill GROUP_WINDOWS windows, then packs that group and
moves on: no shuffle, bounded memory, and the same result when a lost task runs again. Full windows
are cut from long documents; the rests become partial partitions, each a tuple of k loads of which
one is not zero: a rest of more than an eighth of a window in parts, very short rests a few
together. The two partitions with the largest spread are merged again and again, the heaviest
window of one with the lightest of the other, until one partition is left. Whenever its heaviest window
exceeds the capacity, the window count rises, and the rests are parted anew, from the second time on half as large.

Defined results: a null or empty text is one end id; a very long text fills windows of its own, and only its
rest is parted; equal rests are taken in the order of their rows; repeated doc_ids are packed row by row; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import text_chunks
from lorekeep.llm.tokens import CACHE_BYTES, encoder

CAPACITY = 4096
GROUP_WINDOWS = 320
#: Parts of a window: the longest and the shortest that rests are cut into, and how much longer than what is gathered they are.
LONGEST_PART, SHORTEST_PART, GATHERED_PART = 8, 64, 4
STRIDE = 79
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k windows of near-equal load; each window is a list of item numbers."""

    def spelled(size: int, item: int, loads: np.ndarray | None, windows: list | None) -> tuple[np.ndarray, list]:
        if loads is not None:
            return loads, windows
        loads = np.zeros(k, np.int64)
        loads[-1] = -size
        return loads, [None] * (k - 1) + [item]

    # a single item gets its k windows when its turn comes: most of them wait, and would hold k loads each
    heap: list[tuple] = [(-size, item, None, None) for item, size in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, left = spelled(*heapq.heappop(heap))
        b, right = spelled(*heapq.heappop(heap))
        loads = a + b[::-1]
        joined = [y if x is None else x if y is None else (x, y) for x, y in zip(left, reversed(right), strict=True)]
        order = np.argsort(loads, kind="stable")
        loads = loads[order]
        heapq.heappush(heap, (-int(loads[-1] - loads[0]), tick, loads, [joined[i] for i in order]))
        tick += 1

    def flat(tree: object) -> list[int]:
        out, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            elif t is not None:
                out.append(t)
        return sorted(out)

    return [flat(w) for w in spelled(*heap[0])[1]] if heap else []


def parts_of(rests: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Rests (document, start, length) in parts of at most `size`; shorter ones than a quarter of it are gathered in turn.

    Parts are of many lengths, from half of `size` on, so that rests of one length still fill windows evenly.
    """
    out, held, n = [], [], 0
    least = max(1, size // GATHERED_PART)
    for d, s, length in rests:
        if length < least:
            held.append((d, s, length))
            n += length
            if n >= least:
                out.append(held)
                held, n = [], 0
            continue
        end = s + length
        while end - s > size:
            cut = size - len(out) * STRIDE % (size // 2 + 1)
            out.append([(d, s, cut)])
            s += cut
        out.append([(d, s, end - s)])
    return out + ([held] if held else [])


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A window's pieces; those that follow each other in a document are one."""
    out: list[tuple[int, int, int]] = []
    for d, s, n in sorted(pieces):
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == s:
            out[-1] = (d, out[-1][1], out[-1][2] + n)
        else:
            out.append((d, s, n))
    return out


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces that cover documents of these lengths."""
    windows = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rests = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    if not rests:
        return windows
    least = -(-sum(r[2] for r in rests) // capacity)
    k, size = least, max(1, capacity // LONGEST_PART)
    while True:
        parts = parts_of(rests, size)
        split = differencing([sum(p[2] for p in part) for part in parts], k)
        filled = [joined([p for i in w for p in parts[i]]) for w in split]
        if max(sum(p[2] for p in w) for w in filled) <= capacity:
            return windows + [w for w in filled if w]
        k += 1
        if k > least + 1:
            size = max(1, capacity // SHORTEST_PART, size // 2)


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 2, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence. cache_bytes: what a worker may remember of parts of texts."""

    def pieces(ids: list[int | None], encoded: list[bytes], base: int) -> pa.RecordBatch:
        rows = []
        lengths = [len(e) // 4 for e in encoded]
        for number, window in enumerate(pack(lengths)):
            at = 0
            for d, s, n in window:
                rows.append((ids[d], s, n, zlib.crc32(encoded[d][4 * s : 4 * (s + n)]), lengths[d], base + number, at))
                at += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, cache_bytes), int(end_id).to_bytes(4, "little")
        ids, held, tokens, base = [], [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for lo, hi, _, _ in text_chunks(texts):
                encoded = [e + end for e in encode.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])]
                for name, e in zip(names[lo:hi], encoded, strict=True):
                    ids.append(name)
                    held.append(e)
                    tokens += len(e) // 4
                    if tokens >= GROUP_WINDOWS * CAPACITY:
                        yield pieces(ids, held, base)
                        ids, held, tokens, base = [], [], 0, base + (1 << 24)
        if ids:
            yield pieces(ids, held, base)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
