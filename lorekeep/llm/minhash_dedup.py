"""MinHash near-dedup with HyperMinHash registers.

A document's set holds the distinct k-word shingles of its whole lower-cased text. Each register
keeps, for its own hash function, the leading-zero count and the next mantissa bits of the smallest
hash: two bytes instead of eight. Bands of registers propose candidates, a collision-corrected
estimate drops hopeless ones, and every link is confirmed on the full sets.

1. Rows are told apart by a key of doc_id and text; rows with equal sets are folded into one set,
   and only sets go on (from there to the last step a doc_id is the number of a set).
2. A band value that several representatives share is a bucket; its leader is the row that meets most
   others over all bands. Every representative is verified against the most central leader it
   meets, then against the other leaders of buckets that still hold several components.
3. Rows that share a bucket and still lie in different components are compared inside groups of
   bounded size, registers first, and their promising pairs are verified in place: links inside a
   component can't change it, so no link between different texts is lost, and neither pairs nor
   whole groups are written out.

Defined results: null, empty and wordless texts have an empty set and stand alone; fewer than k
words make one shingle of the whole sequence; an empty table gives no rows; other columns are ignored.
In near_duplicates repeated doc_ids collapse to one row, which the links of all their texts join, and
null doc_ids are dropped. In drop_near_duplicates every row is a document of its own, those with null
or repeated doc_ids too; of rows equal in doc_id and text one stays (but all that have neither id nor words).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import mix, shingle_hashes, span_hashes, text_chunks, words
from lorekeep.llm.tokens import forget
from lorekeep.operators.closure import connected_components
from lorekeep.session import staged, unstage

BANDS = 32
ROWS = 5
MANTISSA_BITS = 10
#: Standard errors of the register estimate that a candidate may lie under the threshold.
SLACK = 4.5
#: Places (bits) of the map that tells before the shuffle which texts can't be wanted.
PLACES = 1 << 26
#: Rows of a bucket that meet in one group; larger buckets are dealt into pairs of blocks.
BLOCK = 1024
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows."""
    for lo, _, data, offs in text_chunks(column):
        starts, ends, first = words(data, offs)
        grams, begin = shingle_hashes(span_hashes(data, starts, ends, fold=True), first, k, whole=True)
        yield lo, [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row per non-empty set: leading zeros << MANTISSA_BITS | mantissa."""
    flat = np.concatenate(sets)
    begin = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=begin[1:])
    out = np.empty((len(sets), len(_SEEDS)), np.uint16)
    for j, seed in enumerate(_SEEDS):
        h = flat * seed
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = np.minimum.reduceat(h, begin)
        bits = np.frexp(np.maximum(low >> np.uint64(11), 1).astype(np.float64))[1]  # position of the leading one, of 53
        zeros = 53 - bits
        shift = np.maximum(bits - 1 - MANTISSA_BITS, 0).astype(np.uint64)
        mantissa = ((low >> np.uint64(11)) >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
        out[:, j] = (zeros.astype(np.uint16) << MANTISSA_BITS) | mantissa.astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, less the matches that chance makes.

    The expected share of chance matches of two unrelated sets is about 0.1699 * 2**(1 - bits) * phi with
    phi = 4q / (1 + q)**2 and q the ratio of their sizes.
    """
    share = (a == b).mean(1)
    q = n / np.maximum(m, 1)
    chance = 0.169919487159739 * 2.0 ** (1 - MANTISSA_BITS) * 4 * q / (1 + q) ** 2
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("row_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key (16-byte digest of the sorted set, null when empty), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), k):
                full = [s for s in sets if len(s)]
                regs = iter(registers(full) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(sets)),
                        batch.column("row_key").slice(lo, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "set_key", "regs"],
                )

    source = _keyed(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "row_key", "text")
    return source.mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_key binary, regs binary")


def _rows(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with a wanted row_key (wanted: row_key, n_rows), row_key included; one each where n_rows is over 1."""
    found = keyed.join(wanted.where("n_rows = 1").select("row_key"), "row_key", "left_semi").select(keyed.columns)
    repeated = wanted.where("n_rows > 1").select("row_key")
    if repeated.isEmpty():
        return found
    again = keyed.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(F.min(F.struct(*keyed.columns)).alias("row"))
    return found.union(again.select("row.*"))


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose row_key falls on the same place of a map of PLACES bits as a wanted one; PLACES / 64 words are broadcast at most."""
    place = F.pmod("row_key", F.lit(PLACES))
    word, bit = F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).cast("int")
    words = wanted.select(word, F.expr("shiftleft(1L, cast(pmod(row_key, 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumn("word", word).withColumn("at", bit).join(F.broadcast(words), "word")
    return marked.where(F.getbit("bits", F.col("at")) == 1).select(rows.columns)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """The key of each band of register rows, which holds the band's number and its registers."""
    table = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(table.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, j])
    return key.view(np.int64)


def _band_keys(regs: DataFrame) -> DataFrame:
    """(key, doc_id): one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = band_keys(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(batch.num_rows, -1))
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], names=["key", "doc_id"])

    return regs.select("doc_id", "regs").mapInArrow(run, "key long, doc_id long")


def _sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, s): the sorted full set of each wanted row, as bytes (wanted: doc_id, row_key, n_rows)."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s"])

    return _wanted_texts(documents, wanted).mapInArrow(to_sets, "doc_id long, s binary")


def _wanted_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of each wanted row (wanted: doc_id, row_key, n_rows).

    Most texts meet no other, and aren't shuffled. The joins are inner ones: Spark would move a semi join below the
    map of _maybe, and shuffle all texts for it.
    """
    keyed = _maybe(_keyed(documents.select("doc_id", "text")), wanted).select("row_key", "text")
    side = lambda rows: keyed.join(rows.select("row_key", "doc_id"), "row_key").select("doc_id", "text")
    repeated = wanted.where("n_rows > 1")
    found = side(wanted.where("n_rows = 1"))
    return found if repeated.isEmpty() else found.union(side(repeated).groupBy("doc_id").agg(F.min("text").alias("text")))


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.concatenate([p, q])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold exactly."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("sa"), batch.column("sb"), strict=True)
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Deal each bucket's rows into pairs of blocks of about BLOCK rows, so that no group is larger.

    A bucket of up to BLOCK rows is one group; a larger one has a group for each pair of its blocks,
    and each of its rows goes to as many groups as the bucket has blocks.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    spread = dealt.select("*", other)
    return spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")


def _cross_links(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows of one bucket with different labels, found inside bounded groups.

    rows: key, doc_id, label. Registers first single out the rows with a promising partner; only
    their full sets travel, and only confirmed links come back. A pair that shares several buckets is
    compared in the first of them only, by the number of its band.
    """
    least = _least(percent)

    def candidates(own: np.ndarray, label: np.ndarray, n: np.ndarray, regs: np.ndarray, low: bool, earlier: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(label)):
            fits = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if not low:  # pairs inside a block belong to that block's own group
                fits &= own != own[i]
            fits[: i + 1] = False
            at = np.flatnonzero(fits)
            if len(at):
                at = at[~(earlier[at] == earlier[i]).any(1)]
                at = at[estimate(regs[at], regs[i], n[at], n[i]) >= least]
                if len(at):
                    yield i, at

    def arrays(table: pa.Table) -> tuple:
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        own, label, n = (table.column(c).to_numpy() for c in ("own", "label", "n"))
        same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        keys = band_keys(regs)
        band = int(np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0])
        return own, label, n, regs, same, keys[:, :band]

    def mark(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, at in candidates(*arrays(table)):
            hit[i] = True
            hit[at] = True
        return table.select(["key", "doc_id", "own", "low", "high", "label", "n", "regs"]).filter(pa.array(hit))

    def confirm(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        ids, found = table.column("doc_id").to_numpy(), []
        own, label, n, regs, same, earlier = arrays(table)
        label = label.copy()
        for i, at in candidates(own, label, n, regs, same, earlier):
            for j in at:
                if label[i] != label[j] and _linked(sets[i], sets[j], percent):
                    found.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]  # one link joins two labels
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    named = _blocks(rows).join(sigs.select("doc_id", "regs", F.col("n_shingles").alias("n")), "doc_id").select("key", "doc_id", "own", "low", "high", "label", "n", "regs")
    marked = named.groupBy("key", "low", "high").applyInArrow(mark, "key long, doc_id long, own int, low int, high int, label long, n long, regs binary")
    full = staged(marked, "marked").join(sets, "doc_id").select("key", "doc_id", "own", "low", "high", "label", "n", "regs", "s")
    return full.groupBy("key", "low", "high").applyInArrow(confirm, "a long, b long").distinct()


def _least(percent: int) -> float:
    return percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / (BANDS * ROWS))


def _promising(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate is not hopeless: under the threshold by SLACK standard errors at most."""
    least = _least(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (estimate(ra, rb, n, m) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _label(buckets: DataFrame, links: DataFrame) -> DataFrame:
    labels = connected_components(links, "a", "b").withColumnRenamed("vertex", "doc_id")
    named = buckets.join(labels, "doc_id", "left").select("key", "doc_id", "leader", F.coalesce("component", "doc_id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return staged(named.join(mixed, "key", "left_semi"), "mixed")


def _linked_sets(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, set_id, n_shingles, n_rows), one for equal ones, and the links (a, b) between their sets."""
    sigs = staged(signatures(documents, k).withColumn("set_id", F.when(F.col("set_key").isNotNull(), F.xxhash64("set_key"))).drop("set_key"), "minhash")
    rows = staged(sigs.groupBy("doc_id", "row_key", "set_id").agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n_rows")), "rows")
    reps = staged(sigs.where("set_id is not null").select(F.col("set_id").alias("doc_id"), "n_shingles", "regs").dropDuplicates(["doc_id"]), "reps")
    unstage(sigs)

    keys = _band_keys(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = staged(keys.join(shared, "key").select("key", "doc_id", "rows"), "bands")
    weight = shared.groupBy("doc_id").agg(F.sum("rows").alias("weight"))
    leaders = shared.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("weight", F.negative("doc_id").alias("least"))).alias("top"))
    buckets = staged(
        shared.join(leaders, "key").select("key", "doc_id", F.negative("top.least").alias("leader"), F.col("top.weight").alias("weight")), "buckets"
    )
    unstage(shared)
    first = rows.where("set_id is not null").groupBy(F.col("set_id").alias("doc_id")).agg(F.min(F.struct("n_rows", "row_key")).alias("row"))
    wanted = staged(first.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "row.row_key", "row.n_rows"), "wanted")
    sets = staged(_sets(documents, wanted, k), "sets")

    # the most central leader that a document meets, then every other leader it meets, then what is left
    best = buckets.where("doc_id <> leader").groupBy("doc_id").agg(F.max(F.struct("weight", "leader")).alias("top"))
    stars = best.select(F.col("top.leader").alias("a"), F.col("doc_id").alias("b"))
    links = staged(_verify(_promising(stars, reps, percent), sets, percent), "links")
    left = _label(buckets, links)
    led = left.select("key", F.col("doc_id").alias("leader"), F.col("label").alias("own"))
    stars = left.join(led, ["key", "leader"]).where("label <> own").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = staged(links.union(_verify(_promising(stars, reps, percent), sets, percent)), "links")
    left = _label(buckets, links)
    return rows, staged(links.union(_cross_links(left.select("key", "doc_id", "label").distinct(), reps, sets, percent)), "links")


def _firsts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, group, first): each set's group and its first row; the smallest doc_id, then the smallest row_key, comes first."""
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key", "n_rows")
    per_set = rows.where("set_id is not null").groupBy("set_id").agg(F.min(order).alias("first"))
    groups = connected_components(links, "a", "b")
    return per_set.join(groups, per_set["set_id"] == groups["vertex"], "left").select("set_id", F.coalesce("component", "set_id").alias("group"), "first")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id linked), kept."""
    rows, links = _linked_sets(documents.where("doc_id is not null"), k, percent)
    # the texts of one doc_id are one document
    several = rows.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a < z").select("doc_id", "a")
    links = links.union(rows.join(several, "doc_id").where("set_id > a").select("a", F.col("set_id").alias("b")))
    firsts = staged(_firsts(rows, links), "firsts")
    heads = firsts.groupBy("group").agg(F.min("first").alias("head"))
    named = firsts.join(heads, "group").select("set_id", F.col("head.doc_id").alias("component_id"))
    out = rows.join(named, "set_id", "left").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each near-duplicate group (its smallest doc_id), columns unchanged."""
    rows, links = _linked_sets(documents, k, percent)
    heads = _firsts(rows, links).groupBy("group").agg(F.min("first").alias("head"))
    alone = rows.where("set_id is null").select("row_key", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("n_rows")).alias("n_rows"))
    kept = staged(heads.select("head.row_key", "head.n_rows").union(alone), "kept")
    return _rows(_keyed(documents), kept).select(documents.columns)
