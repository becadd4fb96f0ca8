"""Byte-level BPE: pre-tokenisation by array scans, cached pair merging, decoding.

The split pattern of rank files,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is a small automaton over classes of code points. Each character is a function from the state before
it to the state behind it; the functions that compositions can reach are few and numbered, and a
table composes two of them, so the states of a whole chunk come from an associative scan over
numbers. A token starts where the state before a character and its class say so. The slices between
starts go through a dictionary; what is new there is merged pair by pair, lowest rank first. Long slices
(runs of one letter, scripts without spaces) are merged over a heap of pairs in a linked list.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded
row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import text_chunks
from lorekeep.llm.tokens import Remembered

#: Classes of characters: letter, number, space, other white space, other, and apostrophes before s t m d or re ve ll.
LETTER, NUMBER, SPACE, WHITE, OTHER, SHORT, LONG = range(7)
#: States: fresh start, in letters, in numbers, in others, behind a space, behind other white space, one or two letters of a suffix to come.
START, LETTERS, NUMBERS, OTHERS, SPACED, BLANK, ONE_MORE, TWO_MORE = range(8)
_WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _next_state(state: int, kind: int) -> int:
    if state == TWO_MORE:
        return ONE_MORE
    if state == ONE_MORE:
        return START
    if kind in (SHORT, LONG):
        return OTHERS if state in (OTHERS, SPACED) else ONE_MORE if kind == SHORT else TWO_MORE
    return {LETTER: LETTERS, NUMBER: NUMBERS, SPACE: SPACED, WHITE: BLANK, OTHER: OTHERS}[kind]


def _starts_token(state: int, kind: int) -> bool:
    """Whether a token starts at a character of this class; within white space the next character decides."""
    if state in (ONE_MORE, TWO_MORE):
        return False
    if kind in (SPACE, WHITE):
        return state not in (SPACED, BLANK)
    own = {LETTER: LETTERS, NUMBER: NUMBERS}.get(kind, OTHERS)
    return state not in (own, SPACED)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; function number of each class (plain, and at a text's start); composition; result from START; token starts."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        if (c := unicodedata.category(chr(cp))[0]) in "LN":
            kinds[cp] = LETTER if c == "L" else NUMBER
    kinds[_WHITE_SPACE] = WHITE
    kinds[0x20] = SPACE
    plain = [tuple(_next_state(s, k) for s in range(8)) for k in range(7)]
    first = [(f[START],) * 8 for f in plain]
    functions = list(dict.fromkeys([tuple(range(8)), *plain, *first]))
    number = {f: i for i, f in enumerate(functions)}
    for f in functions:  # grows while it is walked
        for g in [*plain, *first]:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    table = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    of_class = np.array([[number[f] for f in plain], [number[f] for f in first]], np.uint16)
    starts = np.array([[_starts_token(s, k) for k in range(7)] for s in range(8)])
    return kinds, of_class, table, np.array([f[START] for f in functions], np.uint8), starts


def _scan(functions: np.ndarray, table: np.ndarray, width: int = 128) -> np.ndarray:
    """Composition of all functions up to each place, itself included."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, functions.dtype)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = table[grid[j - 1], grid[j]]
    before = np.concatenate([np.zeros(1, functions.dtype), _scan(grid[-1], table, width)[:-1]])
    grid = table[before[None, :], grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte places where tokens of a chunk of UTF-8 texts start."""
    kinds, of_class, table, result, starts = _tables()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return lead
    head = data[lead].astype(np.uint32)
    points = head.copy()
    wide = np.flatnonzero(head >= 0xC0)
    if len(wide):
        at, h = lead[wide], head[wide]
        tail = [(data[np.minimum(at + j, len(data) - 1)] & 0x3F).astype(np.uint32) for j in (1, 2, 3)]
        points[wide] = np.where(
            h < 0xE0, (h & 0x1F) << 6 | tail[0], np.where(h < 0xF0, (h & 0x0F) << 12 | tail[0] << 6 | tail[1], (h & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
        )
    kind = kinds[np.minimum(points, 0x10FFFF)]
    n = len(lead)
    opening = np.zeros(n + 1, bool)
    opening[np.searchsorted(lead, offs)] = True
    opening[n] = True
    p1, p2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    p1[:-1] = np.where(opening[1:n], 0, points[1:])
    p2[:-1] = np.where(opening[1:n], 0, np.append(p1[1:], 0)[: n - 1])
    quote = points == 39
    kind[quote & np.isin(p1, [ord(c) for c in "stmd"])] = SHORT
    kind[quote & ((np.isin(p1, [ord("r"), ord("v")]) & (p2 == ord("e"))) | ((p1 == ord("l")) & (p2 == ord("l"))))] = LONG
    states = result[_scan(of_class[opening[:n].astype(np.int8), kind], table)]
    before = np.concatenate([np.zeros(1, np.uint8), states[:-1]])
    start = starts[before, kind] | opening[:n]
    blank = (kind == SPACE) | (kind == WHITE)
    last_blank = blank.copy()
    last_blank[:-1] &= ~blank[1:] & ~opening[1:n]
    last_blank[-1] = False
    start |= last_blank & (opening[1:] == 0)
    return lead[start]


class BytePairEncoder:
    """ids of byte slices by a rank file; slices seen lately come from a dictionary."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._known = Remembered()
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.lengths = np.array([len(t) for t in by_id])
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def merge(self, piece: bytes) -> bytes:
        """Merge the lowest-ranked neighbours, leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        if len(piece) > LONG_SLICE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (low := min(costs)) != _NEVER:
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
        return b"".join([ranks[p].to_bytes(4, "little") for p in parts])

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges by a heap of (rank, place): n log n in the slice's length."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i] + parts[j]))

        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(joined):
                continue  # one of the two has been merged since
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return b"".join([ranks[p].to_bytes(4, "little") for p in parts if p is not None])

    def encode(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        self._known.age()
        known, body = self._known.now, data.tobytes()
        at = [*starts.tolist(), len(body)]
        slices = [body[a:b] for a, b in zip(at, at[1:], strict=False)]
        ids = list(map(known.get, slices))
        if None in ids:
            self._known.add({s: self.merge(s) for s in self._known.missing({s for s, i in zip(slices, ids, strict=True) if i is None})})
            ids = [known[s] if i is None else i for s, i in zip(slices, ids, strict=True)]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends + size, size)].tobytes()


_NEVER = 1 << 60
#: Bytes of a slice from which on pairs are merged over a heap.
LONG_SLICE = 100
_ENCODERS: dict[str, BytePairEncoder] = {}


def _encoder(path: str) -> BytePairEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def encode_documents(documents: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), slice_starts and slice_ids (byte place, and first id, of each slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(ranks)
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                starts = token_starts(data, offs)
                ids = own.encode(data, starts)
                first = np.searchsorted(starts, offs)
                count = np.array([len(i) >> 2 for i in ids], np.int64)
                before = np.cumsum(count) - count
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([b"".join(ids[a:b]) for a, b in cut], pa.binary()),
                        pa.array([(starts[a:b] - offs[k]).astype("<u4").tobytes() for k, (a, b) in enumerate(cut)], pa.binary()),
                        pa.array([(before[a:b] - (before[a] if a < b else 0)).astype("<u4").tobytes() for a, b in cut], pa.binary()),
                    ],
                    names=["doc_id", "ids", "slice_starts", "slice_ids"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, slice_starts binary, slice_ids binary")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """The encoded rows' doc_id and ids, with the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = [own.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(text, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(documents: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    decoded = decode_documents(encode_documents(documents, ranks), ranks)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
