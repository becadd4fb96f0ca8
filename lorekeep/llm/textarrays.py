"""Texts as flat byte arrays: word, line and shingle hashing without per-word Python.

A chunk of documents is one uint8 buffer plus document offsets. A word is a run of bytes other than
space and 0x09-0x0D; multi-byte UTF-8 sequences never hold those bytes, so bytes and code points
agree on the cuts. Hashes are prefix sums of byte values times powers of an odd base modulo 2**64,
shifted back by the inverse power, then mixed: each costs a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: ASCII white space that separates words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse; only those of a chunk's length are remembered."""
    if len(_powers[0]) < n:
        size, found = max(n, CHUNK_BYTES + 1), list(_powers)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling: powers d..2d-1 are powers 0..d-1 times base**d
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            found[k] = p
        if size > CHUNK_BYTES + 1:
            return found[0], found[1]
        _powers[:] = found
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; fold ignores the case of A-Z.

    Spans in order that don't overlap are hashed a chunk at a time, so that very long texts need no more memory.
    """
    if len(data) > 2 * CHUNK_BYTES and (starts[1:] >= ends[:-1]).all():
        parts, k = [np.zeros(0, np.uint64)], 0
        while k < len(starts):
            j = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK_BYTES, "right")))
            parts.append(_span_hashes(data[starts[k] : ends[j - 1]], starts[k:j] - starts[k], ends[k:j] - starts[k], fold))
            k = j
        return np.concatenate(parts)
    return _span_hashes(data, starts, ends, fold)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    up, down = powers(len(data) + 1)
    values = _BYTE_VALUES[_FOLDED] if fold else _BYTE_VALUES
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts hold about limit bytes: (first row, end row, bytes, offsets).

    A null text counts as empty. A text longer than the limit is a run of its own, never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, body = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 50_000)
        yield lo, hi, body[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and the first word of each document (with an end)."""
    solid = ~SPACES[data]
    edge = np.empty(len(data) + 1, bool)
    edge[:-1] = solid
    edge[-1] = False
    begin = edge[:-1].copy()
    begin[1:] &= ~solid[:-1]
    at = offs[1:-1]
    at = at[at < len(data)]
    begin[at] = solid[at]
    starts = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = at[at > 0] - 1
    stop[last] = solid[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingle_hashes(word_hashes: np.ndarray, first: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each document, and each document's first window.

    whole: a document with fewer than k words, but one at least, has its whole sequence as its only
    window; without it such a document has none.
    """
    n_words = np.diff(first)
    counts = np.maximum(n_words - k + 1, 0)
    if whole:
        counts[(n_words > 0) & (counts == 0)] = 1
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], counts)
    short = np.repeat((n_words < k) & (counts > 0), counts)
    out = np.zeros(len(at), np.uint64)
    width = np.repeat(np.minimum(n_words, k), counts) if short.any() else None
    padded = np.concatenate([word_hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        part = mix(padded[at + j], (j + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        if width is not None:
            part[j >= width] = 0
        out = out * np.uint64(0xD6E8FEB86659FD93) + part
    if width is not None:
        out += width.astype(np.uint64)
    return mix(out), begin
