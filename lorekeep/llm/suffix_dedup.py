"""Suffix-array dedup: remove every byte of a repeated byte string of LENGTH or more.

A byte goes when some LENGTH-byte window over it also starts anywhere else in the table, the same
document included; windows never cross documents. The steps:

1. Anchors. Every window belongs to the k-gram with the smallest hash in it (the leftmost one), so
   equal windows belong to equal anchors at equal offsets. Neighbouring windows of one anchor form a
   slice: about one row per 80 bytes.
2. One aggregation by anchor tells apart anchors seen once (their windows are unique), anchors whose
   slices are all equal (their windows all repeat) and mixed ones. Only mixed anchors need text, and
   of their equal slices only one.
3. Shards of mixed slices get a suffix array: Larsson-Sadakane refinement in numpy (only groups that
   are still tied are sorted again at each doubling), then Kasai's common prefixes in their
   permuted, vectorised form. Neighbours that share LENGTH bytes form a class of equal windows.
4. An anchor with more slices than fit one shard is cut into several; their window classes are then
   merged across shards by binary search, in groups of bounded size.
5. Repeated windows become removed spans of their documents.

Defined results: null and empty texts keep nothing and lose nothing; documents under LENGTH bytes
lose nothing; repeated rows are documents of their own (a repeated doc_id with several rows: the
rows are told apart, spans are never mixed); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import mix, powers, span_hashes, text_chunks
from lorekeep.session import staged, unstage

LENGTH = 200
GRAM = 40
#: Slices of one anchor in one shard; more are spread over several shards.
RUN_SLICES = 1500
#: Ranges that the digests of one anchor are merged in, one a run; an anchor of more runs is merged digest by digest.
MOST_RANGES = 4096
#: Bytes of slices in one suffix array.
SHARD_BYTES = 1 << 20
PIECE = 4 << 20
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def slices(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Slices of a chunk: document index, first window (in the document), windows, anchor's offset, anchor hash, slice hash."""
    if len(data) > 2 * PIECE and len(offs) == 2:  # a very long text: windows in pieces
        parts = []
        for at in range(0, len(data) - length + 1, PIECE):
            d, lo, *rest = slices(data[at : at + PIECE + length - 1], np.array([0, min(len(data) - at, PIECE + length - 1)]), length, gram)
            parts.append((d, lo + at, *rest))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty, empty
    sums, down = _sums(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * down[:n])
    width = length - gram + 1
    ranked = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = ranked
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    total = len(data) - length + 1
    anchor = (np.minimum(behind[:total], ahead[width - 1 : width - 1 + total]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    ok = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(offs) >= length)
    ok[offs[long]] += 1
    ok[offs[long + 1] - length + 1] -= 1
    valid = np.flatnonzero(np.cumsum(ok)[:total] > 0)
    if not len(valid):
        return empty, empty, empty, empty, empty, empty
    own = anchor[valid]
    begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    count = np.diff(np.append(begin, len(valid)))
    lo, at = valid[begin], own[begin]
    stop = lo + count - 1 + length
    body = mix((sums[stop] - sums[lo]) * down[lo] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 99)
    docs = np.searchsorted(offs, lo, "right") - 1
    return docs, lo - offs[docs], count, at - lo, grams[at].view(np.int64), body.view(np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order (Larsson-Sadakane refinement).

    The first sort is by 8 bytes; each doubling sorts only the suffixes whose groups are still tied.
    """
    n = len(text)
    first = _head_words(text)[:n]
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = starts
    h = 8
    tied = ~(new & np.append(new[1:], True))
    while tied.any():
        at = np.flatnonzero(tied)  # positions in the order that belong to groups of two and more
        part = order[at]
        key = rank[part] * np.int64(n + 2) + rank[np.minimum(part + h, n)] + 1
        by = np.argsort(key, kind="stable")
        order[at] = part[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied[at] = ~(fresh & np.append(fresh[1:], True))
        h *= 2
    return order


def _head_words(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, breaks: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with its predecessor in the order, up to cap bytes.

    In text order a suffix shares at least one byte less than the suffix before it did; where both
    predecessors are preceded by the same byte it shares exactly that. So only the other suffixes,
    and those at breaks, are compared, eight bytes at a time; a running maximum fills in the rest.
    """
    n = len(text)
    words = np.append(_head_words(text), np.zeros(cap + 16, np.uint64))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fixed = np.ones(n, bool)
    inner = (at > 0) & (before > 0)
    fixed[inner] = text[at[inner] - 1] != text[before[inner] - 1]
    fixed[breaks] = True
    todo = np.flatnonzero(fixed & (before >= 0))
    shared = np.zeros(n, np.int64)
    i, j = todo, before[todo]
    for step in range(0, cap, 8):
        differ = words[i + step] ^ words[np.minimum(j + step, len(words) - 1)]
        same = differ == 0
        end = i[~same]
        top = differ[~same]
        shared[end] = step + sum((top < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(1, 8))
        i, j = i[same], j[same]
        shared[i] = step + 8
        if not len(i):
            break
    bound = np.where(fixed, shared + at, 0)
    return np.maximum(np.maximum.accumulate(bound) - at, 0)


def window_classes(bodies: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each body in turn: its class of equal windows, and the class's size."""
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
    order = suffix_array(text)
    prefixes = common_prefixes(text, order, begin, int(sizes.max()) + length + 8)  # exact up to length at every place of a body
    # neighbours in the order only; suffixes that are no windows are left out, so take the least prefix between
    is_window = np.zeros(len(text), bool)
    is_window[at] = True
    joined = prefixes[order] >= length
    group = np.cumsum(~joined)
    rows = np.flatnonzero(is_window[order])
    _, of, size = np.unique(group[rows], return_inverse=True, return_counts=True)
    classes = np.empty(len(text), np.int64)
    classes[order[rows]] = of
    return classes[at], size[classes[at]]


def _rows(batch: pa.RecordBatch, step: int = 200) -> Iterator[dict]:
    for at in range(0, batch.num_rows, step):
        yield from batch.slice(at, step).to_pylist()


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _find_slices(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row_key").to_numpy(zero_copy_only=False)
            for lo, _, data, offs in text_chunks(batch.column("text")):
                docs, at, count, off, akey, skey = slices(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + docs]), pa.array(at), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(akey.astype(np.int64)), pa.array(skey.astype(np.int64))],
                    names=["row_key", "lo", "n", "off", "akey", "skey"],
                )

    return documents.select("row_key", "text").mapInArrow(run, "row_key long, lo long, n int, off int, akey long, skey long")


_DOC = "row_key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, pending binary, ranges binary, parts array<struct<akey:long,skey:long,n:int,off:int,body:binary>>"


def _removal(text: bytes, ranges: np.ndarray, keep_text: bool) -> tuple:
    flags = np.zeros(len(text) + 1, np.int32)
    np.add.at(flags, ranges[:, 0], 1)
    np.add.at(flags, ranges[:, 1], -1)
    gone = np.cumsum(flags)[:-1] > 0
    a, _ = _spans(gone)
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(ranges) else text
    return len(text), int(gone.sum()), len(a), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if keep_text else None


def _apply_known(joined: DataFrame, keep_text: bool) -> DataFrame:
    """Finish documents without mixed slices; hand on the others with the slices they must supply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _DOC.split(", ")
        names = [x.split(" ")[0] for x in names]
        part = pa.list_(pa.struct([("akey", pa.int64()), ("skey", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("body", pa.binary())]))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.binary(), pa.binary(), part]
        for batch in batches:
            out, size = [], 0
            for row in _rows(batch.select(["row_key", "doc_id", "text", "full", "mixed", "wanted"])):
                text = (row["text"] or "").encode()
                full = np.array([(x["lo"], x["lo"] + x["n"] - 1 + LENGTH) for x in row["full"] or ()], np.int64).reshape(-1, 2)
                give = [{"akey": x["akey"], "skey": x["skey"], "n": x["n"], "off": x["off"], "body": text[x["lo"] : x["lo"] + x["n"] - 1 + LENGTH]} for x in row["wanted"] or ()]
                if row["mixed"]:
                    out.append((row["row_key"], row["doc_id"], len(text), None, None, None, None, text, full.tobytes(), give))
                else:
                    out.append((row["row_key"], row["doc_id"], *_removal(text, full, keep_text), None, None, give))
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, _DOC)


def _shards(parts: DataFrame) -> DataFrame:
    """Suffix arrays over runs of slices: (akey, skey, runs, spans of repeated windows, digests of all windows)."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        counts = np.array([r[2] for r in rows])
        bodies = [r[3] for r in rows]
        classes, size = window_classes(bodies, counts)
        copies = np.repeat([r[4] for r in rows], counts) > 1
        # a class repeats if it has several windows, or a slice that several documents hold
        hot = np.zeros(int(classes.max()) + 1, bool)
        hot[classes[(size > 1) | copies]] = True
        flags = hot[classes]
        cut = np.concatenate([[0], np.cumsum(counts)])
        spans, digests = [], []
        for k, r in enumerate(rows):
            a, b = _spans(flags[cut[k] : cut[k + 1]])
            spans.append(np.stack([a, b], 1).astype(np.int64).tobytes())
            if r[5] > 1:
                body = np.frombuffer(r[3], np.uint8)
                at = np.arange(r[2])
                digests.append(span_hashes(body, at, at + LENGTH).astype("<u8").tobytes())
            else:
                digests.append(None)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[5] for r in rows], pa.int32()), pa.array([r[6] for r in rows], pa.int32()), pa.array(spans, pa.binary()), pa.array(digests, pa.binary())],
            names=["akey", "skey", "runs", "run", "spans", "digests"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("akey", "skey", "n", "body", "copies", "runs", "run")), strict=True):
                if size >= SHARD_BYTES and (r[0], r[6]) != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
                last = r[0], r[6]
        if rows:
            yield flush(rows)

    dealt = parts.repartition("akey", "run").sortWithinPartitions("akey", "run")
    return dealt.select("akey", "skey", "n", "body", "copies", "runs", "run").mapInArrow(run, "akey long, skey long, runs int, run int, spans binary, digests binary")


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8")


def _merge_runs(shards: DataFrame) -> DataFrame:
    """(akey, skey, spans) of windows that another run of the same anchor holds as well.

    Each run deals its sorted digests into ranges; a range of one anchor meets in one group, where
    each run's digests are looked up in those of all runs by binary search. What a run shares goes
    back to it, packed, and is matched with the windows of its slices.
    """
    several = shards.where("runs > 1")

    def deal(table: pa.Table) -> pa.Table:
        own = np.unique(_digests(table.column("digests")))
        ranges = table.column("runs")[0].as_py()
        of = own % np.uint64(ranges)
        key = [table.column(c)[0].as_py() for c in ("akey", "run")]
        rows = [(*key, r, own[of == r].tobytes()) for r in range(ranges) if (of == r).any()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["akey", "run", "range", "packed"])

    def merge(table: pa.Table) -> pa.Table:
        packed = [np.frombuffer(x, "<u8") for x in table.column("packed").to_pylist()]
        every = np.sort(np.concatenate(packed))
        hits = [own[np.searchsorted(every, own, "right") - np.searchsorted(every, own, "left") > 1].tobytes() for own in packed]
        return table.select(["akey", "run"]).append_column("hits", pa.array(hits, pa.binary()))

    def flag(slices: pa.Table, hits: pa.Table) -> pa.Table:
        shared = np.sort(_digests(hits.column("hits"))) if hits.num_rows else np.zeros(0, "<u8")
        out = []
        for akey, skey, packed in zip(*(slices.column(c).to_pylist() for c in ("akey", "skey", "digests")), strict=True):
            own = np.frombuffer(packed, "<u8")
            at = np.minimum(np.searchsorted(shared, own), max(len(shared) - 1, 0))
            found = shared[at] == own if len(shared) else np.zeros(len(own), bool)
            if found.any():
                out.append((akey, skey, np.stack(_spans(found), 1).astype(np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["akey", "skey", "spans"])

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.unique(np.frombuffer(batch.column("digests")[k].as_buffer(), "<u8")).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(c)[k].as_py(), t)) for c, t in (("akey", np.int64), ("run", np.int32))] + [pa.array(own)], names=["akey", "run", "digest"])

    def packed_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.ascontiguousarray(batch.column("digest").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("akey"), batch.column("run"), pa.array([x.tobytes() for x in own], pa.binary())], names=["akey", "run", "hits"])

    few, many = several.where(F.col("runs") <= MOST_RANGES), several.where(F.col("runs") > MOST_RANGES)
    dealt = few.select("akey", "run", "runs", "digests").groupBy("akey", "run").applyInArrow(deal, "akey long, run int, range int, packed binary")
    met = dealt.groupBy("akey", "range").applyInArrow(merge, "akey long, run int, hits binary")
    # an anchor of more runs than that: a row a digest, so that nothing grows with the number of runs
    single = many.mapInArrow(one_each, "akey long, run int, digest long").distinct()
    again = single.groupBy("akey", "digest").agg(F.min("run").alias("x"), F.max("run").alias("y")).where("x < y").select("akey", "digest")
    met = met.union(single.join(again, ["akey", "digest"]).select("akey", "run", "digest").mapInArrow(packed_one, "akey long, run int, hits binary"))
    return several.select("akey", "run", "skey", "digests").groupBy("akey", "run").cogroup(met.groupBy("akey", "run")).applyInArrow(flag, "akey long, skey long, spans binary")


def _spans_of(documents: DataFrame, keep_text: bool) -> DataFrame:
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows are told apart by id and content; equal rows are copies of each other in any case
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = staged(_find_slices(base), "found")
    anchors = found.groupBy("akey").agg(F.count("*").alias("seen"), F.min("skey").alias("s1"), F.max("skey").alias("s2")).where("seen > 1")
    # a written table: the join below has shuffles alone under it, so that a hot anchor's rows are split over tasks
    anchors = staged(anchors.select("akey", (F.col("s1") != F.col("s2")).alias("mixed")), "anchors")
    flagged = staged(found.join(anchors, "akey"), "slices")
    unstage(found)
    unstage(anchors)
    firsts = staged(
        flagged.where("mixed").groupBy("akey", "skey").agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "lo", "n", "off")).alias("at")),
        "firsts",
    )
    per_doc = flagged.groupBy("row_key").agg(
        F.collect_list(F.when(~F.col("mixed"), F.struct("lo", "n"))).alias("full"), F.max("mixed").alias("mixed")
    )
    wanted = firsts.groupBy(F.col("at.row_key").alias("row_key")).agg(F.collect_list(F.struct("akey", "skey", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"), F.col("at.off").alias("off"))).alias("wanted"))
    joined = base.join(per_doc, "row_key", "left").join(wanted, "row_key", "left")
    docs = staged(_apply_known(joined.select("row_key", "doc_id", "text", "full", "mixed", "wanted"), keep_text), "known")

    parts = docs.where("size(parts) > 0").select(F.explode("parts").alias("p")).select("p.*")
    per_anchor = firsts.groupBy("akey").agg(F.ceil(F.count("*") / RUN_SLICES).cast("int").alias("runs"))
    parts = parts.join(firsts.select("akey", "skey", "copies"), ["akey", "skey"]).join(per_anchor, "akey").withColumn("run", F.pmod(F.xxhash64("skey"), F.col("runs")).cast("int"))
    shards = staged(_shards(parts), "shards")
    def to_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("spans").to_pylist()]
            n = [len(s) for s in spans]
            both = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("akey", "skey")] + [pa.array(both[:, 0]), pa.array(both[:, 1])], names=["akey", "skey", "a", "b"]
            )

    spans = shards.select("akey", "skey", "spans").union(_merge_runs(shards)).mapInArrow(to_spans, "akey long, skey long, a long, b long")
    hits = flagged.where("mixed").join(spans, ["akey", "skey"]).select("row_key", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") - 1 + LENGTH).alias("b"))
    more = hits.groupBy("row_key").agg(F.collect_set(F.struct("a", "b")).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string()]
        names = ["row_key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            out, size = [], 0
            for row in _rows(batch):
                ranges = np.concatenate([np.frombuffer(row["ranges"], np.int64).reshape(-1, 2), np.array([(x["a"], x["b"]) for x in row["more"] or ()], np.int64).reshape(-1, 2)])
                out.append((row["row_key"], row["doc_id"], *_removal(row["pending"], ranges, keep_text)))
                size += len(row["pending"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    waiting = docs.where("pending is not null").select("row_key", "doc_id", "pending", "ranges").join(more, "row_key", "left")
    schema = "row_key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    late = waiting.select("row_key", "doc_id", "pending", "ranges", "more").mapInArrow(finish, schema)
    return docs.where("pending is null").select("row_key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").union(late)


def repeated_spans(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _spans_of(documents, keep_text=False).drop("row_key", "kept")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents with their repeated strings taken out; a cut UTF-8 sequence leaves U+FFFD."""
    kept = _spans_of(documents, keep_text=True).select(F.col("row_key").alias("clean_key"), F.col("n_removed").alias("clean_removed"), F.col("kept").alias("clean_text")).dropDuplicates(["clean_key"])
    keys = documents.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("clean_key"), F.col("text").isNull().alias("clean_null"), *[c for c in documents.columns if c != "text"])
    joined = keys.join(kept, "clean_key")
    text = F.when(~F.col("clean_null"), F.col("clean_text"))
    count = F.coalesce(F.length(text).cast("long"), F.col("n_chars")) if "n_chars" in documents.columns else None
    return joined.select(*[text.alias("text") if c == "text" else count.alias(c) if c == "n_chars" else F.col(c) for c in documents.columns])
