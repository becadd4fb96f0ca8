"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision is seen in the contexts of the 0 to DEPTH bytes
before it. A node (context, bits so far) holds its counts and their Krichevsky-Trofimov estimate; from
the deepest nodes upwards its weighted probability is half its own estimate and half the product of
its children's, and a prediction mixes the estimates of all depths by the resulting posterior
weights. Summed over a text's bytes and its end, that is a code length.

A node's counts follow from the counts of (DEPTH + 1)-byte strings, which are gathered over all training
texts: tasks send their distinct strings, a shuffle adds them up. Groups of strings that share the two
bytes before the prediction hold whole subtrees, so nodes are built inside tasks; only the top two
levels, at most 256 * 255 nodes each, meet on the driver.

Scoring looks the frequent strings up in a table of fixed size (2**GRAM_SLOTS places, the same at any
input) that is broadcast; every other string goes through an exact join. Unigram counts of words
for the base score work the same way. So the model grows with the corpus and the broadcast doesn't.

Defined results: a null or empty text is its end alone; texts are scored as UTF-8; repeated doc_ids are
scored row by row and learned from each; a null doc_id is scored and not learned from; with an empty
training set every bit has probability one half; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import mix, span_hashes, text_chunks, words
from lorekeep.session import staged

DEPTH = 5
#: Never a byte of UTF-8: stands before a text's first byte and is predicted behind its last.
EDGE = 0xFF
GRAM_SLOTS = 22
WORD_SLOTS = 20
#: Strings or words that a task holds before it sends what it has counted.
HELD = 1_500_000
#: Strings in one group of subtrees.
GROUP_STRINGS = 300_000
END_WORD = 0x454E44
CHOICES = 6
#: Looked-up strings that meet one group of subtrees.
GROUP_ASKED = 2_000_000


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the strings behind every byte and end of a chunk, and each text's first key.

    A key holds the predicted byte lowest and the nearest byte of context highest.
    """
    size = np.diff(offs)
    begin = np.concatenate([[0], np.cumsum(size + DEPTH + 1)])
    text = np.full(begin[-1], EDGE, np.uint8)
    doc = np.repeat(np.arange(len(size)), size)
    text[np.arange(len(data)) - offs[doc] + begin[doc] + DEPTH] = data
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    key = text[DEPTH:].astype(np.uint64)
    for j in range(DEPTH):
        key |= text[DEPTH - 1 - j : len(text) - 1 - j].astype(np.uint64) << np.uint64(8 * (DEPTH - j))
    mask = np.ones(len(key), bool)
    for j in range(DEPTH):
        mask[begin[1:-1] + j - DEPTH] = False  # predictions of the edges before the next text
    return key[mask], np.concatenate([[0], np.cumsum(size + 1)])


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a chunk, and each text's first word."""
    starts, ends, first = words(data, offs)
    return span_hashes(data, starts, ends, fold=True), first


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x of 0.5 and more: Stirling's series eight places up, shifted back."""
    y = x + 8.0
    down = np.ones_like(y)
    for j in range(8):
        down *= x + j
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(down)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their values; keys are sorted already."""
    if not len(keys):
        return keys, values
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values, at)


class Subtrees:
    """Nodes of depth 2 to DEPTH for strings that share their two nearest bytes in groups."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for depth in range(DEPTH, 1, -1):
            short = (keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)) | (keys & np.uint64(255))
            order = np.argsort(short, kind="stable")
            at, total = _sum_by(short[order], counts[order].astype(np.float64))
            for k in range(8):
                bit = (at >> np.uint64(7 - k)) & np.uint64(1)
                node = (at >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << k) | ((at & np.uint64(255)) >> np.uint64(8 - k))
                ids, ones = _sum_by(node, total * bit)
                _, both = _sum_by(node, total)
                own = log_kt(both - ones, ones)
                if depth == DEPTH:
                    self.nodes[depth, k] = ids, ones, both, own, np.full(len(ids), np.inf)
                    continue
                child = self.nodes[depth + 1, k]
                parent = (child[0] >> np.uint64(16) << np.uint64(8)) | (child[0] & np.uint64(255))
                below = np.bincount(np.searchsorted(ids, parent), child[3], len(ids)) if len(ids) else own
                self.nodes[depth, k] = ids, ones, both, np.logaddexp(own, below) - np.log(2), own - below

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each node of depth 1 below which this group has nodes: id, ones, visits, sum of the children's log weights."""
        parts = [[], [], [], []]
        for k in range(8):
            ids, ones, both, weight, _ = self.nodes[2, k]
            parent = (ids >> np.uint64(16) << np.uint64(8)) | (ids & np.uint64(255))
            at, of = np.unique(parent, return_inverse=True)
            for p, v in zip(parts, (at, *(np.bincount(of, x, len(at)) for x in (ones, both, weight))), strict=True):
                p.append(v)
        return tuple(np.concatenate(p) for p in parts)

    def log10(self, keys: np.ndarray, upper: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of the mixed probability of each key's byte in its context, whether seen or not."""
        total = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for k in range(8):
            bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            prefix = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
            p = np.full(len(keys), 0.5)
            for depth in range(DEPTH, 1, -1):
                ids, ones, both, _, beta = self.nodes[depth, k]
                if not len(ids):
                    continue
                node = (keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)) | prefix
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                own = np.where(bit, ones[at], both[at] - ones[at])
                kt, share = (own + 0.5) / (both[at] + 1), 1 / (1 + np.exp(-np.clip(beta[at], -700, 700)))
                p = np.where(ids[at] == node, share * kt + (1 - share) * p, 0.5)
            near = (keys >> np.uint64(8 * DEPTH)).astype(np.int64) * 256 + prefix.astype(np.int64)
            for (ones, both, beta), node in ((upper[0], near), (upper[1], prefix.astype(np.int64))):
                own = np.where(bit, ones[node], both[node] - ones[node])
                kt, share = (own + 0.5) / (both[node] + 1), 1 / (1 + np.exp(-np.clip(beta[node], -700, 700)))
                p = np.where(both[node] > 0, share * kt + (1 - share) * p, 0.5)
            total += np.log10(p)
        return total


def upper_levels(rows: list[tuple]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Counts and weights of the nodes of depth 1 (65536 places) and 0 (256), from sums over depth 2."""
    ones, both, below, seen = (np.zeros(65536) for _ in range(4))
    for node, a, b, w in rows:
        ones[node], both[node], below[node], seen[node] = a, b, w, 1
    own = np.where(seen > 0, log_kt(both - ones, ones), 0)
    weight = np.where(seen > 0, np.logaddexp(own, below) - np.log(2), 0)
    near = ones, both, np.where(seen > 0, own - below, 0)
    grid = lambda x: x.reshape(256, 256).sum(0)
    one, all_ = grid(ones), grid(both)
    top = log_kt(all_ - one, one)
    return near, (one, all_, np.where(all_ > 0, top - grid(weight), 0))


class Table:
    """A hash table of fixed size over arrays; keys that find no free place are left out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int) -> None:
        self.bits = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max)
        self.values = np.zeros(1 << bits, values.dtype)
        for choice in range(CHOICES):
            at = mix(keys, choice + 1) >> self.bits
            free = np.flatnonzero(self.keys[at] == np.iinfo(np.uint64).max)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values = keys[rest], values[rest]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and which of them the table holds."""
        at = mix(keys, 1) >> self.bits
        found = self.keys[at] == keys
        out = self.values[at]
        left = np.flatnonzero(~found)
        for choice in range(1, CHOICES):
            if not len(left):
                break
            at = mix(keys[left], choice + 1) >> self.bits
            hit = self.keys[at] == keys[left]
            out[left[hit]], found[left[hit]] = self.values[at[hit]], True
            left = left[~hit]
        return out, found


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    return _sum_by(keys[order], counts[order])


def _count(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strings, words): key and count over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def send(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = _counted(held[kind])
            held[kind] = []
            for at in range(0, len(keys), 500_000):
                part = keys[at : at + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(counts[at : at + 500_000])], names=["kind", "key", "n"])

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column("text")):
                held[0].append(np.unique(grams(data, offs)[0], return_counts=True))
                own, counts = np.unique(word_keys(data, offs)[0], return_counts=True)
                held[1].append((np.append(own, np.uint64(END_WORD)), np.append(counts, len(offs) - 1)))
                for kind in (0, 1):
                    if sum(len(p[0]) for p in held[kind]) > HELD:
                        held[kind] = [_counted(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from send(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from send(kind)

    sums = staged(training.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    return sums.where("kind = 0").select("key", "n"), sums.where("kind = 1").select("key", "n")


def _frequent(counts: DataFrame, slots: int) -> DataFrame:
    """The entries of at least some count, the least one whose entries fill three quarters of the slots at most."""
    room = 3 << (slots - 2)
    size = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(size.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["rows"]
        if total > room:
            break
        least = r["level"]
    return counts.where(size >= (least if least is not None else 1 << 30))


def _arrays(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values, the most frequent ones first: those find a place in a table in any case."""
    table = df.select("key", F.col(value).alias("value"), "n").toArrow()
    keys, values, n = (table.column(k).to_numpy() for k in range(3))
    order = np.lexsort((keys, -n))
    return keys[order].astype(np.int64).view(np.uint64), values[order]


def _part_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of each string, by the two bytes nearest to the predicted one."""
    return ((keys >> np.uint64(8 * (DEPTH - 1))) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(groups)


def _subtree_groups(strings: DataFrame) -> tuple[DataFrame, int]:
    groups = max(8, strings.count() // GROUP_STRINGS + 1)
    near = F.shiftright("key", 8 * (DEPTH - 1)) * F.lit(2654435761)
    return strings.withColumn("part", (F.shiftright(near, 16) % groups).cast("int")), groups


def _tree(table: pa.Table) -> Subtrees:
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Subtrees(keys[order], table.column("n").to_numpy()[order])


def score_texts(documents: DataFrame, modulus: int = 10, held_out: int = 0) -> DataFrame:
    """Every document's base and model score: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod modulus is held_out are not learned from.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    strings, vocabulary = _count(source.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, norm = int(total["tokens"]), np.log10(int(total["tokens"]) + 0.1 * (int(total["distinct"]) + 1))

    grouped, groups = _subtree_groups(strings)

    def tops(table: pa.Table) -> pa.Table:
        ids, ones, both, weight = _tree(table).top()
        return pa.table({"node": pa.array(ids.astype(np.int64)), "ones": ones, "visits": both, "below": weight})

    sums = grouped.groupBy("part").applyInArrow(tops, "node long, ones double, visits double, below double")
    rows = sums.groupBy("node").agg(F.sum("ones"), F.sum("visits"), F.sum("below")).collect()  # 65536 rows at most
    upper = spark.sparkContext.broadcast(upper_levels([tuple(r) for r in rows]))

    def learned_often(table: pa.Table) -> pa.Table:
        often = pc.fill_null(table.column("often"), False).to_numpy().astype(bool)
        keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)[often]
        n = table.column("n").to_numpy()[often]
        return pa.table({"key": pa.array(keys.view(np.int64)), "n": pa.array(n), "p": pa.array(_tree(table).log10(keys, upper.value).astype(np.float32))})

    bar = _frequent(strings, GRAM_SLOTS).agg(F.min("n").alias("n")).first()["n"]
    marked = grouped.withColumn("often", F.col("n") >= F.lit(bar if bar is not None else 1 << 62))
    gram_keys, gram_values = _arrays(marked.groupBy("part").applyInArrow(learned_often, "key long, n long, p float"), "p")
    word_table, word_counts = _arrays(_frequent(vocabulary, WORD_SLOTS), "n")
    tables = spark.sparkContext.broadcast((Table(gram_keys, gram_values.astype(np.float32), GRAM_SLOTS), Table(word_table, word_counts.astype(np.int64), WORD_SLOTS)))
    end = vocabulary.where(F.col("key") == END_WORD).first()
    end_count = int(end["n"]) if end else 0

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, grams array<long>, gram_n array<long>, words array<long>, word_n array<long>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, word_table = tables.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                n = hi - lo
                keys, first = grams(data, offs)
                p, found = gram_table.find(keys)
                sums = np.concatenate([[0], np.cumsum(np.where(found, p, 0).astype(np.float64))])
                score = sums[first[1:]] - sums[first[:-1]]
                own, first_word = word_keys(data, offs)
                c, known = word_table.find(own)
                sums = np.concatenate([[0], np.cumsum(np.where(known, np.log10(c + 0.1), 0))])
                base = sums[first_word[1:]] - sums[first_word[:-1]] + np.log10(end_count + 0.1)
                sums = np.concatenate([[0], np.cumsum(known)])
                n_known = sums[first_word[1:]] - sums[first_word[:-1]] + (end_count > 0)
                lists = []
                for miss, begin, k in ((~found, first, keys), (~known, first_word, own)):
                    at = np.flatnonzero(miss)
                    doc = np.searchsorted(begin, at, "right") - 1
                    order = np.lexsort((k[at], doc))
                    doc, key = doc[order], k[at][order]
                    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
                    count = np.diff(np.append(new, len(key)))
                    cut = np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32)
                    lists += [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int64))) for v in (key[new].view(np.int64), count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), batch.column("doc_id").slice(lo, n), pa.array(np.diff(first_word) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), *lists],
                    names=[c.split(" ")[0] for c in schema.split(", ")],
                )
                row += n

    found = staged(source.mapInArrow(look_up, schema), "scores")
    word_rows = found.select("row", F.explode(F.arrays_zip("words", "word_n")).alias("x")).select("row", F.col("x.words").alias("key"), F.col("x.word_n").alias("times"))

    # strings that the table lacks go to the groups of their subtrees, packed: a row per batch of texts and group
    missing = found.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("n")).first()["n"]
    spread = int(missing) // (groups * GROUP_ASKED) + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_no = TaskContext.get().partitionId()
        for batch in batches:
            lists = batch.column("grams")
            keys = lists.flatten().to_numpy().astype(np.int64).view(np.uint64)
            rows = np.repeat(batch.column("row").to_numpy(), lists.value_lengths().to_numpy())
            times = batch.column("gram_n").flatten().to_numpy()
            part = _part_of(keys, groups).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(groups + 1))
            out = [(g, batch_no % spread, *(x[order[a:b]].tobytes() for x in (keys, rows, times.astype(np.int64)))) for g, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            batch_no += 1
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["part", "salt", "keys", "rows", "times"])

    def rare(strings_: pa.Table, asked: pa.Table) -> pa.Table:
        keys, rows, times = (np.frombuffer(b"".join(asked.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("rows", np.int64), ("times", np.int64)))
        if not len(keys):
            return pa.table({"row": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})
        distinct, at = np.unique(keys, return_inverse=True)
        own, of = np.unique(rows, return_inverse=True)
        return pa.table({"row": pa.array(own), "p": pa.array(np.bincount(of, times * _tree(strings_).log10(distinct, upper.value)[at], len(own)))})

    asked = found.select("row", "grams", "gram_n").mapInArrow(ask, "part int, salt int, keys binary, rows binary, times binary")
    salted = grouped.select("key", "n", "part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    answers = salted.groupBy("part", "salt").cogroup(asked.groupBy("part", "salt")).applyInArrow(rare, "row long, p double")
    rare_scores = answers.groupBy("row").agg(F.sum("p").alias("more"))
    counted = F.coalesce(F.col("n"), F.lit(0))
    rare_words = (
        word_rows.join(vocabulary, "key", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(counted + 0.1)).alias("more_base"), F.sum(F.when(counted > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    out = found.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(rare_scores, "row", "left").join(rare_words, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(True)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * F.lit(float(norm))).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
        (-(F.col("score") + F.coalesce("more", zero)) / np.log10(2)).alias("code_bits"),
    )
