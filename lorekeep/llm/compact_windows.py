"""Substring dedup by compact windows: near-duplicate passages anywhere inside texts.

Texts become sequences of hashed k-word shingles. For a hash function, the Cartesian tree over a sequence's
hashes tells where each shingle is the smallest: every subsequence inside its compact window (left, centre,
right) that holds the centre has that shingle as its min-hash. Only nodes that span WIDTH places are wanted;
those are the places that a sliding minimum of that width visits, so only they are looked at.

A pair of passages of MIN_SHINGLES shingles and more with a Jaccard similarity of SIMILARITY or more has an exact
run of WIDTH common shingles: e separate edits kill 9e shingles at least, so that 36e common ones make e + 1
runs, and one edit in the shortest passage leaves two runs of 41 together. All HASHES functions agree on a run.

1. Equal texts are folded into one.
2. An interval join inside each text lays the windows of all functions over each other: each stretch of
   subsequences with the same centres has one signature, its min-hashes with their distances.
3. Texts of one signature meet: inside each task first, so that a task sends one row for a signature however
   frequent it is, then over all tasks. Every row meets the group's first text (a seed), never all others.
4. Seeds of a pair of texts that lie near each other on near diagonals form a region; its two
   sides are cut out and verified on full shingle sequences: a passage is a stretch in which shared shingles
   hold the share that the similarity asks for; its sides' distinct shingles must reach that Jaccard.
5. Where a seed is not in a verified passage, its group is mixed: unrelated texts share the signature. Every row
   of a mixed group meets again, by longer keys: its signature with each window minimum (FINE shingles) that
   stands NEAR to FAR places before or behind it. A fragment that texts share holds such a key only where it spans
   both, so that texts which share less than a passage fall apart, however many they are. What then meets in no
   known passage is verified as before. Runs of MIN_SHINGLES shingles that hold a row of a mixed group, and all of
   whose signatures occur again, meet by their digests too, where equality is the proof: no exact passage is lost.
6. Verified passages that touch form classes.

So exact passages of MIN_WORDS words lose no link. A near passage is missed only where the signatures of all
its exact runs are led by texts that share nothing else with it.

A near passage is missed only where every longer key of its common runs is led by a text that holds that key and isn't
near it: unrelated texts that share 26 to 45 shingles of the passage at one place, whichever part of it is asked.

Defined results: null, empty and short texts (under MIN_WORDS words) have no passages; equal texts of
MIN_WORDS words and more are passages of each other as a whole; repeats inside one text count at any distance, where
they don't overlap; very long texts are read whole, and only the places around seeds are compared; repeated doc_ids with equal texts collapse; an empty table gives no rows; null doc_ids
are dropped; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.textarrays import mix, shingle_hashes, span_hashes, text_chunks, words
from lorekeep.operators.closure import connected_components
from lorekeep.session import staged, unstage

SHINGLE = 5
MIN_WORDS = 50
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
#: Shingles of an exact run that every near-duplicate passage holds, and hash functions that must agree on it.
WIDTH = 20
HASHES = 2
SIMILARITY = 0.8
#: Shares of common shingles between SIMILARITY and the one that, on both sides, makes a Jaccard of SIMILARITY: d / (2 - d).
DENSITIES = np.linspace(SIMILARITY, 2 * SIMILARITY / (1 + SIMILARITY), 4).tolist()
#: Places that neighbouring diagonals of one passage may lie apart.
DRIFT = 16
#: Places that a region reaches beyond its outer seeds; seeds within twice as many are of one region.
MARGIN = 2 * MIN_SHINGLES
#: Places of the minima that lengthen a key of a mixed group, and the shingles of which each is the smallest.
NEAR, FAR, FINE = 16, 48, 16
#: Places between the cuts that are tried between two seeds of one text.
CUT_STEP = 8
#: Rows that a task gathers before it lets them meet.
LOCAL_ROWS = 400_000
#: Texts whose copies a task recognises.
RECENT_TEXTS = 100_000
#: Regions that one copy of their text serves, and bytes of regions in one batch.
ASKS = 512
CUT_BYTES = 4 << 20
_ODD = np.random.default_rng(41).integers(1, 1 << 63, HASHES + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequences(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, first shingle of each row, words of each row) for runs of rows."""
    for lo, _, data, offs in text_chunks(column):
        starts, ends, first = words(data, offs)
        grams, begin = shingle_hashes(span_hashes(data, starts, ends, fold=True), first, SHINGLE, whole=False)
        yield lo, grams, begin, np.diff(first)


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (size places) of each run, one run after the other."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def sliding_minima(hashes: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Places that are the smallest (the leftmost, on ties) of some `width` places in a row of one sequence."""
    n = len(hashes)
    size = np.maximum(np.diff(begin) - width + 1, 0)
    if not size.sum():
        return np.zeros(0, np.int64)
    grid = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    grid[:n] = hashes >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1]).ravel()
    low = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = low[_places(begin[:-1], size)]
    return low[np.concatenate([[True], low[1:] != low[:-1]])]


def _borders(values: np.ndarray, first: np.ndarray, strict: bool) -> np.ndarray:
    """The nearest earlier number of a smaller value (strict), or of one no larger, in the same run; len(values) where there is none.

    first: whether a run begins here. Every pointer passes over larger values only, so all of them jump at once.
    """
    n = len(values)
    held = np.append(values.astype(np.int64), -1)
    to = np.append(np.where(first, n, np.arange(n) - 1), n)
    left = np.arange(n)
    while len(left):
        far, own = held[to[left]], held[left]
        left = left[far >= own if strict else far > own]
        to[left] = to[to[left]]
    return to[:n]


def compact_windows(hashes: np.ndarray, begin: np.ndarray, least: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of every compact window of `least` places or more, right included, by centre.

    A window is the span of a node of its text's Cartesian tree: it reaches to the nearest smaller place on
    either side. Such a place is a centre itself, or the text ends there, so that only the sliding
    minima are looked at.
    """
    centres = sliding_minima(hashes, begin, least)
    n = len(centres)
    values = hashes[centres] >> np.uint64(32)
    text = np.searchsorted(begin, centres, "right") - 1
    new = np.ones(n + 1, bool)
    new[1:n] = text[1:] != text[:-1]
    before = _borders(values, new[:n], False)
    after = _borders(values[::-1], new[1:][::-1], True)[::-1]
    at = np.append(centres, 0)
    left = np.where(before < n, at[before] + 1, begin[text])
    right = np.where(after < n, at[n - 1 - np.minimum(after, n - 1)], begin[text + 1]) - 1
    return left, centres, right


def signatures(grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, at, lo, hi): interval join of the compact windows of all functions inside each text.

    The subsequences of WIDTH shingles that begin at lo..hi (hi included) have the same centre in every
    function; at is the centre of the first one. Places count from the text's first shingle.
    """
    size = np.maximum(np.diff(begin) - WIDTH + 1, 0)
    starts = np.concatenate([[0], np.cumsum(size)])  # subsequences, numbered over all texts
    cuts, found = [starts[:-1][size > 0]], []
    for f in range(HASHES):
        h = grams * _ODD[f]
        left, centre, _ = compact_windows((h ^ h >> np.uint64(32)) * _ODD[f + 1], begin)
        text = np.searchsorted(begin, centre, "right") - 1
        own = np.maximum(left, centre - WIDTH + 1) - begin[text] + starts[text]
        cuts.append(own)
        found.append((own, centre))
    lo = np.sort(np.concatenate(cuts), kind="stable")  # runs in order are merged
    lo = lo[np.append(True, lo[1:] != lo[:-1])[: len(lo)]]
    hi = np.append(lo[1:], starts[-1]) - 1
    key, first = np.zeros(len(lo), np.uint64), None
    for own, centre in found:
        centre = centre[np.searchsorted(own, lo, "right") - 1]
        first = centre if first is None else first
        key = mix(key * _ODD[-1] + grams[centre] + (centre - first).astype(np.uint64))
    text = np.searchsorted(starts, lo, "right") - 1
    return key, text, (first if first is not None else lo) - begin[text], lo - starts[text], hi - starts[text]


def _run_digests(grams: np.ndarray, width: int) -> np.ndarray:
    """A digest of every `width` shingles in a row; runs are put together from runs of half the width."""

    def digests(width: int) -> np.ndarray:
        if width == 1:
            return grams
        half = width // 2
        part = digests(half)
        out = part[:-half] * _ODD[-1] ** np.uint64(half) + part[half:]
        return out if width % 2 == 0 else out[:-1] * _ODD[-1] + grams[width - 1 :]

    return mix(digests(width), width) if len(grams) >= width else np.zeros(0, np.uint64)


#: A run is one number (packed): the rows and seeds of all texts are what the operator moves.
ROW = ["key", "text", "run"]
SEED = ["key", "a", "a_run", "b", "b_run"]
_SEED_SCHEMA = ", ".join(f"{c} long" for c in SEED)
#: What a task sends: rows that go on (0), seeds (1), and the words of each text (2: a, a_run).
_MET_SCHEMA = "kind byte, " + _SEED_SCHEMA


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Runs as numbers, in the order of lo; at and hi lie less than WIDTH places behind it."""
    return lo << 16 | at - lo << 8 | hi - lo


def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, lo, hi) of packed runs."""
    lo = run >> 16
    return lo + (run >> 8 & 255), lo, lo + (run & 255)


def _at(run: str) -> Column:
    return F.shiftright(run, 16) + F.shiftright(run, 8).bitwiseAND(255)


def meet(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Seeds between rows (ROW) of one key, and the first row of each key; the rows of a text follow each other.

    The first places of the texts of a key meet its first text; a further place of a text meets the last one
    that lies a passage before it, or else the first one.
    """
    order = np.argsort(rows[0], kind="stable")
    key, text, run = rows = [x[order] for x in rows]
    n = len(key)
    new_key, new_text = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new_text[1:] = new_key[1:] | (text[1:] != text[:-1])
    b = np.flatnonzero(~new_key)
    own = np.flatnonzero(new_text)[np.cumsum(new_text)[b] - 1]
    a = np.where(own == b, np.flatnonzero(new_key)[np.cumsum(new_key)[b] - 1], own)
    again = np.flatnonzero(own < b)
    place = np.cumsum(new_text) << 32 | unpacked(run)[0]
    a[again] = np.maximum(own[again], np.searchsorted(place, place[b[again]] - MIN_WORDS, "right") - 1)
    seeds = [key[b], text[a], run[a], text[b], run[b]]
    return seeds, [x[new_key] for x in rows]


def _batch(kind: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Seeds, or rows in the columns of seeds, 100,000 a batch."""
    for at in range(0, len(cols[0]), 100_000):
        part = [c[at : at + 100_000] for c in cols]
        n = len(part[0])
        arrays = [*map(pa.array, part), *[pa.nulls(n, pa.int64())] * (len(SEED) - len(part))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *arrays], names=["kind", *SEED])


def _gathered(parts: Iterator[list[np.ndarray]], apart: bool = False) -> Iterator[pa.RecordBatch]:
    """Lets the rows of a task meet, LOCAL_ROWS at a time; the first row of each key goes on.

    apart: seeds inside one text that lie less than a passage apart are left out.
    """
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        seeds, firsts = meet([np.concatenate(x) for x in zip(*held, strict=True)])
        if apart:
            _, a, a_run, b, b_run = seeds
            far = (a != b) | (unpacked(b_run)[0] - unpacked(a_run)[0] >= MIN_WORDS)
            seeds = [x[far] for x in seeds]
        yield from _batch(1, seeds)
        yield from _batch(0, firsts)

    for part in parts:
        if len(part) == 2:  # words of texts
            yield from _batch(2, [np.zeros_like(part[1]), *part])
            continue
        held.append(part)
        n += len(part[0])
        if n > LOCAL_ROWS:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _signature_rows(texts: DataFrame) -> DataFrame:
    """Seeds inside tasks, the rows that go on, and the words of each text; texts: text_key, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        recent: dict[int, None] = {}
        for batch in batches:
            names = batch.column("text_key").to_numpy()
            fresh = []
            for k, name in enumerate(names.tolist()):
                if name not in recent:
                    recent[name] = None
                    fresh.append(k)
            while len(recent) > RECENT_TEXTS:
                del recent[next(iter(recent))]
            names = names[fresh]
            for lo, grams, begin, n_words in sequences(batch.column("text").take(pa.array(fresh, pa.int64()))):
                yield [names[lo : lo + len(n_words)], n_words]
                key, text, *run = signatures(grams, begin)
                yield [key.view(np.int64), names[lo + text], packed(*run)]

    return texts.mapInArrow(lambda batches: _gathered(rows(batches)), _MET_SCHEMA)


def _asked(docs: DataFrame, heads: DataFrame, asks: DataFrame) -> DataFrame:
    """The asks (text_key, ...) beside their text, which comes from one document, however many copies it has."""
    return docs.join(asks.join(heads.select("text_key", "doc_id"), "text_key"), ["text_key", "doc_id"])


def repeated_runs(begin: np.ndarray, lo: np.ndarray, hi: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Places where a run of MIN_SHINGLES in one text may stand again: all its signatures are repeated (lo..hi), one at least in a mixed group.

    begin: the first place of each text, with an end; lo and hi count over all texts.
    """
    n = begin[-1]
    places = _places(begin[:-1], np.maximum(np.diff(begin) - MIN_SHINGLES + 1, 0))

    def covered(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        edge = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi + 1, minlength=n + 1)[: n + 1]
        sums = np.zeros(n + 2, np.int64)
        np.cumsum(np.cumsum(edge) > 0, out=sums[1:])
        return sums[places + MIN_SHINGLES - WIDTH + 1] - sums[places]

    return places[(covered(lo, hi) == MIN_SHINGLES - WIDTH + 1) & (covered(lo[mixed], hi[mixed]) > 0)]


def longer_keys(x: np.ndarray, begin: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Rows (ROW; text as its number) of texts: the signatures with these runs, each with the minima NEAR to FAR places away.

    begin: the first shingle of each text, with an end; text, lo, hi: the runs. Keys are even; a row that occurs twice is sent once.
    """
    key, own, at, first, last = signatures(x, begin)
    runs, asked = own << 32 | first, text << 32 | lo
    found = np.minimum(np.searchsorted(runs, asked), max(len(runs) - 1, 0))
    found = np.unique(found[(runs[found] == asked) & (last[found] == hi)]) if len(runs) else found[:0]
    key, own, at, first, last = (c[found] for c in (key, own, at, first, last))
    place = at + begin[own]
    h = x * _ODD[HASHES]
    fine = sliding_minima((h ^ h >> np.uint64(32)) * _ODD[0], begin, FINE)
    out = []
    for side, (near, far) in enumerate(((NEAR, FAR), (-FAR, -NEAR))):
        low = np.searchsorted(fine, np.maximum(place + near, begin[own]))
        size = np.maximum(np.searchsorted(fine, np.minimum(place + far, begin[own + 1] - 1), "right") - low, 0)
        row = np.repeat(np.arange(len(at)), size)
        out.append((mix(key[row] * _ODD[-1] + x[fine[_places(low, size)]], side + 1) & ~np.uint64(1), row))
    longer, row = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((longer, place[row]))
    longer, row = longer[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (longer[1:] != longer[:-1]) | (place[row[1:]] != place[row[:-1]])
    row = row[new]
    return [longer[new].view(np.int64), own[row], at[row], first[row], last[row]]


def _refined_rows(docs: DataFrame, heads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Like _signature_rows, for texts with rows of mixed groups (ranges: text_key, run, mixed).

    Even keys are the longer ones of the rows of mixed groups, odd ones the digests of the texts' repeated_runs.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            names = batch.column("text_key").to_numpy()
            spans = batch.column("spans")
            for lo, grams, begin, n_words in sequences(batch.column("text")):
                held = spans.slice(lo, len(n_words))
                text = np.repeat(np.arange(len(n_words)), held.value_lengths().to_numpy())
                run, mixed = (held.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("run", "mixed"))
                _, first, last = unpacked(run)
                key, own, *run = longer_keys(grams, begin, text[mixed], first[mixed], last[mixed])
                if len(key):
                    yield [key, names[lo + own], packed(*run)]
                place = repeated_runs(begin, first + begin[text], last + begin[text], mixed)
                if len(place):
                    own = np.searchsorted(begin, place, "right") - 1
                    at = place - begin[own]
                    yield [(_run_digests(grams, MIN_SHINGLES)[place] | np.uint64(1)).view(np.int64), names[lo + own], packed(at, at, at)]

    spans = ranges.groupBy("text_key").agg(F.collect_list(F.struct("run", "mixed")).alias("spans"), F.max("mixed").alias("any")).where("any").drop("any")
    asked = _asked(docs, heads, spans).select("text_key", "text", "spans")
    return asked.mapInArrow(lambda batches: _gathered(rows(batches), apart=True), _MET_SCHEMA)


def _seeds(rows: DataFrame) -> DataFrame:
    """All seeds: those inside tasks, and those between the tasks' first rows, which meet in one sorted pass."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ROW]
            if not batch.num_rows:
                continue
            if lead is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(lead, cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = cols[0][1:] != cols[0][:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            b = np.flatnonzero(cols[1] != cols[1][first])
            a = first[b]
            key, text, run = cols
            for part in _batch(1, [key[b], text[a], run[a], text[b], run[b]]):
                yield part.drop_columns(["kind"])
            lead = [c[first[-1] : first[-1] + 1] for c in cols]

    firsts = rows.where("kind = 0").select("key", F.col("a").alias("text"), F.col("a_run").alias("run"))
    met = firsts.repartition("key").sortWithinPartitions("key", "text", "run").mapInArrow(sweep, _SEED_SCHEMA)
    return rows.where("kind = 1").select(SEED).union(met)


def regions(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, shift: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Interval join of the seeds of pairs of texts: (a, b, a_lo, a_hi, b_lo, b_hi), reaching MARGIN beyond the seeds.

    Seeds whose diagonals (shift) follow each other within DRIFT form a bundle; in a bundle, seeds that
    lie within 2 * MARGIN of each other form a region. lo..hi: the run of a seed in a. Inside one text the seeds of a
    region span about the diagonal at most, and where its margins would meet, the sides end and begin between the
    seeds: they overlap there, as the border of two near repeats isn't known yet, and verify_apart finds it.
    """
    order = np.lexsort((shift, b, a))
    a, b, a_at, shift, lo, hi = (x[order] for x in (a, b, a_at, shift, lo, hi))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (shift[1:] - shift[:-1] > DRIFT)
    bundle = np.cumsum(fresh) - 1
    order = np.lexsort((a_at, bundle))
    a, b, a_at, shift, lo, hi, bundle = (x[order] for x in (a, b, a_at, shift, lo, hi, bundle))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (bundle[1:] != bundle[:-1]) | (a_at[1:] - a_at[:-1] > 2 * MARGIN)
    start = np.searchsorted(bundle, bundle)  # the first seed of each one's bundle
    lap = (a_at - a_at[start]) // np.maximum(shift[start] - WIDTH - DRIFT, MIN_SHINGLES)
    fresh[1:] |= (a[1:] == b[1:]) & (lap[1:] != lap[:-1])
    at = np.flatnonzero(fresh)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    seed_lo, seed_hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at) + WIDTH - 1
    low, high = np.maximum(seed_lo - MARGIN, 0), seed_hi + MARGIN
    least, most = np.minimum.reduceat(shift, at), np.maximum.reduceat(shift, at)
    a, b = a[at], b[at]
    b_low, b_high = np.maximum(seed_lo - MARGIN + least, 0), high + most
    close = (a == b) & (high >= b_low)
    first, last = seed_hi, seed_lo + least - 1  # where the border may lie
    middle = (first + last) // 2
    first, last = np.minimum(first, middle), np.maximum(last, middle)
    return a, b, low, np.where(close, last, high), np.where(close, first + 1, b_low), b_high


def _regions(seeds: DataFrame) -> DataFrame:
    """Regions (a, b, a_lo, a_hi, b_lo, b_hi) of all pairs of texts.

    Pairs are dealt by both texts and sorted; a batch's last pair waits for the next batch, so that memory
    holds a batch and one pair, whose rows two texts bound.
    """
    out = ["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in regions(*rows)], names=out)
        for batch in batches:
            a, a_run, b, b_run = (batch.column(c).to_numpy() for c in SEED[1:])
            at, lo, hi = unpacked(a_run)
            rows = [a, b, at, unpacked(b_run)[0] - at, lo, hi]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield emit([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield emit(held)

    placed = seeds.where((F.col("a") != F.col("b")) | (_at("b_run") - _at("a_run") >= MIN_WORDS)).select(SEED[1:])
    return placed.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(sweep, ", ".join(f"{c} long" for c in out))


def longest_stretch(shared: np.ndarray, least: int, density: float) -> list[tuple[int, int]]:
    """Stretches of `least` places or more that begin and end shared and hold a share of density as a whole.

    From each place on, the furthest end that holds the share; the first place with one of `least` places
    counts, and the search goes on behind it. Where in a stretch the edits lie makes no difference.
    """
    begins = shared.nonzero()[0]
    if len(begins) < density * least - 1 or begins[-1] - begins[0] + 1 < least:
        return []
    sums = np.zeros(len(shared) + 1)
    np.cumsum(shared - density, out=sums[1:])
    after = np.maximum.accumulate(sums[::-1])  # the highest total from here on, last place first
    ends = len(shared) - after.searchsorted(sums[begins] - 1e-9)
    ends = begins[begins.searchsorted(ends - 1, "right") - 1]  # back to a shared place
    long = ends - begins + 1 >= least
    begins, ends = begins[long], ends[long]
    out, k = [], 0
    while k < len(begins):
        out.append((int(begins[k]), int(ends[k])))
        k = int(begins.searchsorted(ends[k], "right"))
    return out


def verify(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Near-duplicate stretches of two shingle sequences: first and last place in x and in y.

    Each side of a passage holds a share of SIMILARITY at least, and two sides that both hold the last of the
    DENSITIES are one in any case: stretches are sought by rising shares until the Jaccard is met.
    """
    return _passages(*_numbered(x, y))


def _numbered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of x and y as numbers, and how many there are."""
    both = np.concatenate([x, y])
    order = both.argsort()
    ranked = both[order]
    number = np.zeros(len(both), np.int64)
    (ranked[1:] != ranked[:-1]).cumsum(out=number[1:])
    codes = np.empty_like(number)
    codes[order] = number
    return codes[: len(x)], codes[len(x) :], int(number[-1]) + 1 if len(number) else 0


def _passages(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """verify() for shingles that are numbered up to n."""
    found: list[tuple[int, int, int, int]] = []

    def holds(part: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[part] = True
        return out

    in_y = holds(y)[x]
    if np.count_nonzero(in_y) < SIMILARITY * MIN_SHINGLES:
        return found
    for density in DENSITIES:
        stretches = longest_stretch(in_y, MIN_SHINGLES, density)
        if not stretches:  # nor is there one of a higher share
            break
        missed = False
        for a, b in stretches:
            if any(f[0] <= a and b <= f[1] for f in found):
                continue
            part = x[a : b + 1]
            in_part = holds(part)[y]
            for c, d in longest_stretch(in_part, MIN_SHINGLES, density):
                other = y[c : d + 1]
                # trim to what both sides hold
                mine, theirs = holds(other)[part].nonzero()[0], in_part[c : d + 1].nonzero()[0]
                p, q = part[mine[0] : mine[-1] + 1], other[theirs[0] : theirs[-1] + 1]
                u, v = holds(p), holds(q)
                both = np.count_nonzero(u & v)
                if min(len(p), len(q)) >= MIN_SHINGLES and both >= SIMILARITY * np.count_nonzero(u | v):
                    found.append((a + int(mine[0]), a + int(mine[-1]), c + int(theirs[0]), c + int(theirs[-1])))
                else:
                    missed = True
        if not missed and found:
            break
    return found


def verify_apart(x: np.ndarray, y: np.ndarray, ahead: int) -> list[tuple[int, int, int, int]]:
    """verify() for two sides of one text that overlap: y begins `ahead` places behind x's begin, and the text is cut between.

    The middle of the overlap is tried first; while a passage ends at the cut, the cut moves on to where it may reach further.
    """
    out: list[tuple[int, int, int, int]] = []
    x, y, n = _numbered(x, y)
    cut = (ahead + len(x)) // 2
    up, down = list(range(cut + CUT_STEP, len(x) + 1, CUT_STEP)), list(range(cut - CUT_STEP, ahead - 1, -CUT_STEP))
    while True:
        found = _passages(x[:cut], y[cut - ahead :], n)
        out += [(p, q, r + cut - ahead, s + cut - ahead) for p, q, r, s in found]
        if found:
            left, right = any(q == cut - 1 for _, q, _, _ in found), any(r == 0 for _, _, r, _ in found)
            if left == right:
                return out
            up, down = (up, []) if left else ([], down)
        if not up and not down:
            return out
        cut = up.pop(0) if up else down.pop(0)


def _verified(found: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Verified passage pairs (a, a_lo, a_hi, b, b_lo, b_hi) in shingle places."""
    numbered = staged(found.withColumn("pair", F.xxhash64("a", "b", "a_lo", "b_lo", "a_hi", "b_hi")), "regions")
    sides = numbered.select("pair", F.lit(0).alias("side"), F.col("a").alias("text_key"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).union(
        numbered.select("pair", F.lit(1), "b", "b_lo", "b_hi")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, asked = batch.column("text_key").to_numpy(), batch.column("asks")
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                starts, ends, first = words(data, offs)
                held = asked.slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), held.value_lengths().to_numpy())
                pair, side, at, last = (held.flatten().field(c).to_numpy() for c in ("pair", "side", "lo", "hi"))
                begin = starts[first[text] + at]
                end = ends[np.minimum(first[text] + last + SHINGLE, first[text + 1]) - 1]
                full = np.flatnonzero(np.diff(np.cumsum(end - begin) // CUT_BYTES)) + 1
                for k in np.split(np.arange(len(text)), full):
                    bodies = [data[i:j].tobytes() for i, j in zip(begin[k].tolist(), end[k].tolist(), strict=True)]
                    cols = [pa.array(x) for x in (pair[k], side[k], names[lo + text[k]], at[k])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(bodies, pa.binary())], names=["pair", "side", "text", "at", "body"])

    # a text travels once for every ASKS of its regions, however many it has
    spread = sides.groupBy("text_key").agg(F.ceil(F.count("*") / ASKS).alias("parts"))
    asked = sides.join(spread, "text_key").withColumn("part", F.pmod("pair", "parts"))
    asks = asked.groupBy("text_key", "part").agg(F.collect_list(F.struct("pair", "side", "lo", "hi")).alias("asks"))
    cuts = _asked(docs, heads, asks).select("text", "text_key", "asks").mapInArrow(cut, "pair long, side int, text long, at long, body binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, done = None, None  # the first side of the pair at hand, and the pair verified last
        for batch in (w.slice(k, 256) for w in batches for k in range(0, w.num_rows, 256)):
            out = []
            names = [*zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "text", "at")), strict=True)]
            for lo, grams, begin, n_words in sequences(batch.column("body")):
                for k, (pair, side, b, j) in enumerate(names[lo : lo + len(n_words)]):
                    y = grams[begin[k] : begin[k + 1]]
                    if side == 0:
                        one = (pair, b, j, y) if one is None or one[0] != pair else one
                    elif one is not None and one[0] == pair and done != pair:
                        done, (_, a, i, x) = pair, one
                        close = a == b and i + len(x) > j
                        for p, q, r, s in verify_apart(x, y, j - i) if close else verify(x, y):
                            if a != b or i + q < j + r or j + s < i + p:  # inside one text, apart from each other
                                out.append((a, i + p, i + q, b, j + r, j + s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(6)], names=["a", "a_lo", "a_hi", "b", "b_lo", "b_hi"])

    sorted_sides = cuts.repartition("pair").sortWithinPartitions("pair", "side")
    return sorted_sides.mapInArrow(check, "a long, a_lo long, a_hi long, b long, b_lo long, b_hi long").distinct()


def _outside(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """The seeds that lie in no verified passage of their pair; inside one text, those with a side in no passage of the text with itself."""
    seeds = seeds.select("*", _at("a_run").alias("a_at"), _at("b_run").alias("b_at"))
    passages = links.select(F.col("a").alias("pa"), F.col("b").alias("pb"), *(F.col(c).alias(f"p{c}") for c in ("a_lo", "a_hi", "b_lo", "b_hi")))
    inside = F.col("a_at").between(F.col("pa_lo"), F.col("pa_hi")) & F.col("b_at").between(F.col("pb_lo"), F.col("pb_hi"))
    two = seeds.where("a <> b").join(passages.where("pa <> pb"), (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")) & inside, "left_anti")
    own = links.where("a = b")
    spans = _merged(own.select(F.col("a").alias("text_key"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).union(own.select("a", "b_lo", "b_hi")))
    held = lambda rows, at: rows.join(spans, (F.col("a") == F.col("text_key")) & F.col(at).between(F.col("lo"), F.col("hi")), "left").withColumn(f"{at}_in", F.col("lo").isNotNull()).drop(*spans.columns)
    one = held(held(seeds.where(f"a = b and b_at - a_at >= {MIN_WORDS}"), "a_at"), "b_at").where("not (a_at_in and b_at_in)")
    return two.unionByName(one.drop("a_at_in", "b_at_in")).select(SEED)


def _ranges(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(text_key, run, mixed): the runs of all seeds; mixed where a seed of the group lies in no verified passage of its pair."""
    alone = _outside(seeds, links).select("key").distinct()
    marked = seeds.join(alone.withColumn("mixed", F.lit(True)), "key", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    sides = marked.select(F.col("a").alias("text_key"), F.col("a_run").alias("run"), "mixed").union(marked.select("b", "b_run", "mixed"))
    return sides.groupBy("text_key", "run").agg(F.max("mixed").alias("mixed"))


def _links(docs: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified passage pairs (a, a_lo, a_hi, b, b_lo, b_hi) of all texts, and (text_key, n_words) of the copied ones.

    docs: doc_id, text_key, text; heads: text_key and the doc_id of one document that has it.
    """
    rows = staged(_signature_rows(docs.select("text_key", "text")), "signatures")
    seeds = staged(_seeds(rows), "seeds")
    copied = rows.where("kind = 2").select(F.col("a").alias("text_key"), F.col("a_run").alias("n_words")).distinct()
    copied = staged(copied.join(heads.where("copies > 1").select("text_key"), "text_key"), "copied")
    unstage(rows)
    links = staged(_verified(_regions(seeds), docs, heads), "passages")
    rows = staged(_refined_rows(docs, heads, _ranges(seeds, links)), "refined")
    unstage(seeds)
    again = staged(_seeds(rows), "refined-seeds")
    unstage(rows)
    longer = _outside(again.where("key & 1 = 0"), links)
    links = staged(links.union(_verified(_regions(longer), docs, heads)).distinct(), "passages")
    places = lambda x: (_at(f"{x}_run").alias(f"{x}_lo"), (_at(f"{x}_run") + MIN_SHINGLES - 1).alias(f"{x}_hi"))
    equal = again.where("key & 1 = 1").select("a", *places("a"), "b", *places("b"))
    # runs of a pair on one diagonal that follow each other are one
    order = Window.partitionBy("a", "b", F.col("b_lo") - F.col("a_lo")).orderBy("a_lo")
    nr = F.sum(F.when(F.col("a_lo") - F.lag("a_lo").over(order) <= MIN_SHINGLES, 0).otherwise(1)).over(order)
    joined = equal.distinct().withColumn("nr", nr).groupBy("a", "b", F.col("b_lo") - F.col("a_lo"), "nr").agg(*(f(c).alias(c) for f, c in ((F.min, "a_lo"), (F.max, "a_hi"), (F.min, "b_lo"), (F.max, "b_hi"))))
    return staged(links.union(joined.select(links.columns)), "passages"), copied


def _merged(spans: DataFrame) -> DataFrame:
    """Passages: unions of the verified spans of a text that overlap (text_key, lo, hi)."""
    spans = spans.groupBy("text_key", "lo").agg(F.max("hi").alias("hi"))  # a row per place, however many links a text has
    order = Window.partitionBy("text_key").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("nr", F.sum("fresh").over(order))
    return marked.groupBy("text_key", "nr").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("nr")


def near_duplicate_passages(documents: DataFrame) -> DataFrame:
    """One row per passage that occurs again: doc_id, start_word, n_words, class_id.

    Passages of one class_id are linked by verified near-duplication; a document with none has no row.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    members = staged(docs.select("doc_id", "text_key").distinct(), "members")
    heads = staged(members.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "heads")
    links, copied = _links(docs, heads)

    spans = links.select(F.col("a").alias("text_key"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).union(links.select("b", "b_lo", "b_hi")).distinct()
    found = staged(_merged(spans).withColumn("passage", F.xxhash64("text_key", "lo")), "merged")
    side = lambda s: links.join(found.select(F.col("text_key").alias(s), F.col("lo").alias(f"{s}l"), F.col("hi").alias(f"{s}h"), F.col("passage").alias(f"{s}p")), s).where(f"{s}_lo >= {s}l and {s}_hi <= {s}h")
    ids = ["a", "a_lo", "a_hi", "b", "b_lo", "b_hi"]
    edges = side("a").select(*ids, "ap").join(side("b").select(*ids, "bp"), ids).select(F.col("ap").alias("src"), F.col("bp").alias("dst"))
    classes = connected_components(edges, "src", "dst")
    named = found.join(classes, found["passage"] == classes["vertex"], "left").select("text_key", "lo", "hi", F.coalesce("component", "passage").alias("class_id"))
    # copies of a text have the passages of their text, and the whole text besides
    inner = members.join(named, "text_key").select("doc_id", F.col("lo").alias("start_word"), (F.col("hi") - F.col("lo") + SHINGLE).alias("n_words"), "class_id")
    whole = members.join(copied.where(F.col("n_words") >= MIN_WORDS), "text_key")
    whole = whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), "n_words", F.xxhash64(F.lit("copies"), "text_key").alias("class_id"))
    return inner.union(whole)
