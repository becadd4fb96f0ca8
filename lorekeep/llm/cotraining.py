"""Quality classifier by co-training of two views.

One view sees the text (words that tell good from bad documents, and the rates of the rule
statistics), the other the page's metadata (source, language, length). Both start from a bounded
sample of labelled documents (good: quality 1 and not toxic). In each round each view names the
unlabelled sample rows that it is most sure of, and the other view learns from those pseudo-labels.
Each view's margin is calibrated on labelled rows that neither learned from, a small logistic model
combines the two, and the combination scores every document.

Fitting runs on the driver over at most LABELLED_ROWS + POOL_ROWS rows of features; the model is a few
thousand numbers. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no words and zero rates; unknown or null metadata have no
weight; repeated doc_ids are scored row by row; an empty table gives no rows; without labels of both
kinds every document scores 1 and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.quality_rules import labelled_sample, rule_stats
from lorekeep.llm.textarrays import span_hashes, text_chunks, words

#: Bounds on the sampled rows that the classifiers are fitted on.
LABELLED_ROWS = 6000
POOL_ROWS = 3000
ROUNDS = 4
#: Pseudo-labels that a view hands over each round, and the calibrated confidence they need.
EXCHANGED = 150
CONFIDENCE = 0.97
WORDS = 1200
#: Share of labelled good rows that the cut-off may reject; it is never above even odds.
GOOD_LOSS = 0.005


@dataclass
class View:
    """A logistic model over named binary features and dense columns."""

    keys: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float
    center: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def matrix(self, begin: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Presence of each key in each row's list (rows are flat[begin[i]:begin[i + 1]])."""
        out = np.zeros((len(begin) - 1, len(self.keys)), np.float32)
        if len(self.keys) and len(flat):
            at = np.searchsorted(self.keys, flat)
            hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == flat)
            out[np.searchsorted(begin, hit, "right") - 1, at[hit]] = 1
        return out

    def margin(self, begin: np.ndarray, flat: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.full(len(begin) - 1, self.bias)
        if len(self.keys) and len(flat):
            at = np.searchsorted(self.keys, flat)
            hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == flat)
            total += np.bincount(np.searchsorted(begin, hit, "right") - 1, self.weights[at[hit]], len(total))
        return total + ((dense - self.center) / self.scale) @ self.dense

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return self.slope * margin + self.shift


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; classes weigh alike."""
    x = x.astype(np.float32)
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    rate = 1.0 / (0.25 * float((share * (np.einsum('ij,ij->i', x, x) + 1)).sum()) + penalty)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + np.float32(vb), -30, 30)))
        g = share * (p - y)
        nw, nb = vw - np.float32(rate) * (g @ x + np.float32(penalty) * vw), vb - rate * float(g.sum())
        m = np.float32(t / (t + 3))
        vw, vb = nw + m * (nw - w), nb + float(m) * (nb - b)
        w, b = nw, nb
    return w.astype(np.float64), b


def _pick_keys(begin: np.ndarray, flat: np.ndarray, good: np.ndarray, limit: int) -> np.ndarray:
    """The features whose shares in good and bad rows differ most, in standard errors."""
    row = np.repeat(np.arange(len(good)), np.diff(begin))
    keys, at = np.unique(flat, return_inverse=True)
    n1, n0 = max(good.sum(), 1), max((~good).sum(), 1)
    in1, in0 = np.bincount(at, good[row], len(keys)), np.bincount(at, ~good[row], len(keys))
    p = (in1 + in0) / (n1 + n0)
    z = np.abs(in1 / n1 - in0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    able = np.flatnonzero((in1 + in0 >= 5) & (z > 3))
    return np.sort(keys[able[np.argsort(-z[able], kind="stable")[:limit]]])


def _fit(begin: np.ndarray, flat: np.ndarray, dense: np.ndarray, good: np.ndarray, limit: int) -> View:
    center, scale = dense.mean(0), dense.std(0) + 1e-6
    view = View(_pick_keys(begin, flat, good, limit), np.zeros(0), np.zeros(0), 0.0, center, scale)
    x = np.concatenate([view.matrix(begin, flat), (dense - center) / scale], 1)
    w, view.bias = _logistic(x, good, 1e-4)
    view.weights, view.dense = w[: len(view.keys)], w[len(view.keys) :]
    return view


@dataclass
class Rows:
    """Features of sampled rows: two key lists and two dense blocks."""

    text: list[np.ndarray]
    text_dense: np.ndarray
    meta: list[np.ndarray]
    meta_dense: np.ndarray

    def view(self, which: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, dense = (self.text, self.text_dense) if which == 0 else (self.meta, self.meta_dense)
        own = [lists[i] for i in rows]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])
        return begin, np.concatenate([*own, np.zeros(0, np.uint64)]).astype(np.uint64), dense[rows]


def co_train(data: Rows, labelled: np.ndarray, good: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS) -> tuple[list[View], np.ndarray, float]:
    """Two views, the weights of their combination and the cut-off.

    labelled: row numbers; good: their labels; pool: row numbers without labels. Every third labelled
    row is held back to calibrate.
    """
    held = np.arange(len(labelled)) % 3 == 2
    calib, calib_good = labelled[held], good[held]
    sets = [(labelled[~held], good[~held]), (labelled[~held], good[~held])]
    left = pool.copy()
    views: list[View] = []
    for step in range(rounds + 1):
        views = [_fit(*data.view(v, sets[v][0]), sets[v][1], WORDS) for v in (0, 1)]
        for v in (0, 1):
            m = views[v].margin(*data.view(v, calib))
            w, b = _logistic(m[:, None], calib_good, 1e-6, 500)
            views[v].slope, views[v].shift = float(w[0]), b
        if step == rounds or not len(left):
            break
        taken = np.zeros(len(left), bool)
        for v in (0, 1):
            p = 1 / (1 + np.exp(-views[v].calibrated(views[v].margin(*data.view(v, left)))))
            for verdict, sure in ((True, p), (False, 1 - p)):
                top = np.argsort(-sure, kind="stable")[:EXCHANGED]
                top = top[sure[top] >= CONFIDENCE]
                rows, labels = sets[1 - v]
                sets[1 - v] = np.concatenate([rows, left[top]]), np.concatenate([labels, np.full(len(top), verdict)])
                taken[top] = True
        left = left[~taken]
    both = np.stack([views[v].calibrated(views[v].margin(*data.view(v, calib))) for v in (0, 1)], 1)
    w, b = _logistic(both, calib_good, 1e-3)
    combine = np.array([*np.maximum(w, 0), b])
    fine = np.sort(both[calib_good] @ combine[:2] + b)
    return views, combine, min(0.0, float(fine[int(len(fine) * GOOD_LOSS)]))


def _word_lists(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text without the marks around them, case ignored: (first word of each text, hashes)."""
    starts, ends, first = words(data, offs)
    inner = _IN_WORD[data]
    place = np.arange(len(data))
    after = np.minimum.accumulate(np.where(inner, place, len(data))[::-1])[::-1] if len(data) else place
    before = np.maximum.accumulate(np.where(inner, place, -1)) if len(data) else place
    a = np.minimum(after[starts], ends)
    b = np.maximum(before[ends - 1] + 1, a)
    return first, span_hashes(data, a, b, fold=True)


_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _meta_keys(sources: list, langs: list) -> list[np.ndarray]:
    packed = [f"s:{s}\0l:{x}" for s, x in zip(sources, langs, strict=True)]
    data = np.frombuffer("".join(packed).encode(), np.uint8)
    cut = np.cumsum([0] + [len(p.encode()) for p in packed])
    mid = np.array([c + len(p.split("\0")[0].encode()) for c, p in zip(cut, packed, strict=False)], np.int64)
    a, b = span_hashes(data, cut[:-1], mid), span_hashes(data, mid + 1, cut[1:])
    return [np.array([x, y]) for x, y in zip(a, b, strict=True)]


def _features(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> tuple:
    first, hashes = _word_lists(data, offs)
    _, rates = rule_stats(data, offs)
    sources, langs = (part.column(c).to_pylist() for c in ("source", "lang"))
    size = np.log1p(np.diff(offs)).astype(np.float64)[:, None]
    return first, hashes, rates, _meta_keys(sources, langs), np.concatenate([size, size**2 / 10], 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            first, hashes, rates, meta, size = _features(part, data, offs)
            lists = [np.unique(hashes[a:b]).astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("good"), pa.array(lists, pa.binary()), pa.array(list(rates), pa.list_(pa.float64())), pa.array([m.tobytes() for m in meta], pa.binary()), pa.array(list(size), pa.list_(pa.float64()))],
                names=["doc_id", "good", "words", "rates", "meta", "size"],
            )


def _inputs(documents: DataFrame) -> DataFrame:
    """doc_id, text, source and lang; missing metadata columns count as null."""
    have = set(documents.columns)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("source", "lang")])


def fit(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> tuple[list[View], np.ndarray, float] | None:
    """Co-train on bounded samples: labelled rows, and unlabelled rows chosen by hash."""
    docs = _inputs(documents)
    sample = labelled_sample(docs, labels, labelled_rows).select("doc_id", "text", "source", "lang", ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"))
    ids = docs.select("doc_id").where("doc_id is not null").join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool_rows)
    pool = docs.join(F.broadcast(chosen), "doc_id").withColumn("good", F.lit(None).cast("boolean"))
    schema = "doc_id long, good boolean, words binary, rates array<double>, meta binary, size array<double>"
    rows = sample.unionByName(pool).mapInArrow(_sampled, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    good = np.array([r["good"] is True for r in rows], bool)
    known = np.array([r["good"] is not None for r in rows], bool)
    labelled = np.flatnonzero(known)
    if not good[labelled].any() or good[labelled].all():
        return None
    shuffled = np.random.default_rng(3).permutation(labelled)
    data = Rows([np.frombuffer(r["words"], "<u8") for r in rows], np.array([r["rates"] for r in rows]), [np.frombuffer(r["meta"], "<u8") for r in rows], np.array([r["size"] for r in rows]))
    return co_train(data, shuffled, good[shuffled], np.flatnonzero(~known))


def classify(documents: DataFrame, labels: DataFrame, carry: list[str] | None = None, **bounds: int) -> DataFrame:
    """Every document's calibrated views and combined score: doc_id, p_text, p_meta, score, kept, then carried columns."""
    model = fit(documents, labels, **bounds)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                n = hi - lo
                if model is None:
                    a = b = total = np.full(n, 30.0)
                    keep = np.ones(n, bool)
                else:
                    views, combine, cut = model
                    first, hashes, rates, meta, size = _features(part, data, offs)
                    doc = np.repeat(np.arange(n), np.diff(first))
                    at = np.searchsorted(views[0].keys, hashes)
                    hit = np.flatnonzero(views[0].keys[np.minimum(at, len(views[0].keys) - 1)] == hashes) if len(views[0].keys) else np.zeros(0, np.int64)
                    pair = np.unique(doc[hit] * np.int64(1 << 20) + at[hit])  # a word counts once a document
                    found, keys = pair >> 20, views[0].keys[pair & ((1 << 20) - 1)] if len(pair) else np.zeros(0, np.uint64)
                    begin = np.searchsorted(found, np.arange(n + 1))
                    a = views[0].calibrated(views[0].margin(begin, keys, rates))
                    b = views[1].calibrated(views[1].margin(np.arange(n + 1) * 2, np.concatenate([*meta, np.zeros(0, np.uint64)]), size))
                    total = combine[0] * a + combine[1] * b + combine[2]
                    keep = total >= cut
                p = [1 / (1 + np.exp(-np.clip(m, -40, 40))) for m in (a, b, total)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in p), pa.array(keep), *(part.column(c) for c in carry)], names=["doc_id", "p_text", "p_meta", "score", "kept", *carry])

    have = [c for c in documents.columns if c in carry and c not in ("text", "doc_id")]
    kinds = dict(documents.dtypes)
    source = _inputs(documents.select("*")) if not carry else documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[_or_null(documents, c) for c in ("source", "lang")], *have)
    schema = "doc_id long, p_text double, p_meta double, score double, kept boolean" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return source.mapInArrow(run, schema)


def _or_null(documents: DataFrame, name: str):  # noqa: ANN202
    return (F.col(name).cast("string") if name in documents.columns else F.lit(None).cast("string")).alias(name)


def filter_by_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the combined classifier keeps, with their own columns only."""
    names = [c for c in documents.columns if c not in ("doc_id", "text")]
    own = documents.select("doc_id", "text", *[_or_null(documents, c) for c in ("source", "lang")], *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)])
    out = classify(own, labels, carry=["text", *[f"own_{i}" for i in range(len(names))]])
    back = {"doc_id": F.col("doc_id").cast(documents.schema["doc_id"].dataType), "text": F.col("text")} | {c: F.col(f"own_{i}").alias(c) for i, c in enumerate(names)}
    return out.where("kept").select(*[back[c] for c in documents.columns])
