"""Retrieval as one plan over many questions: postings, BM25, vectors, fusion, eras."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.session import staged


def postings(documents: DataFrame, key: str, terms: DataFrame, column: str = "text") -> DataFrame:
    """(key, term, length, tf): one row per term of a document that is asked for (term).

    Texts are dealt by their key first, so that whatever is summed up per document or per question and document later needs no other shuffle.
    """
    t = documents.select(key, column).repartition(key).select(key, text.words(F.col(column)).alias("w")).withColumn("length", F.size("w"))
    found = t.select(key, "length", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return found.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def _packed(documents: DataFrame, key: str, terms: DataFrame, column: str) -> DataFrame:
    """(key, length, terms): one row a document with words, and what it holds of the terms, written out so that texts are cut into words once."""
    t = documents.select(key, column).repartition(key).select(key, text.words(F.col(column)).alias("w")).withColumn("length", F.size("w"))
    words = t.select(key, "length", F.explode("w").alias("word")).join(terms.select(F.col("term").alias("word"), "term").distinct(), "word", "left")
    counted = words.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    return staged(counted.groupBy(key, "length").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms")), "postings")


def _idf() -> Column:
    return F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _weight(k1: float, b: float) -> Column:
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))


def term_scores(documents: DataFrame, asked: DataFrame, key: str, column: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """asked (term, any columns) beside (key, score): what each term of each document that holds it scores by BM25, dealt by the key.

    What is asked is written out with the weight of each term, so that the planner knows its size: where it is small it goes
    to the documents, and no row of a question and document is shuffled.
    """
    wanted = staged(asked, "asked")
    held = _packed(documents, key, wanted, column)
    df = held.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    sizes = held.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    known = staged(wanted.join(df, "term").crossJoin(F.broadcast(sizes)).select(*wanted.columns, _idf().alias("idf"), "mean_length"), "asked-terms")  # sizes: one row
    posted = held.repartition(key).select(key, "length", F.inline("terms"))
    return posted.join(known, "term").select(*wanted.columns, key, _weight(k1, b).alias("score"))


def bm25(documents: DataFrame, questions: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(query_id, key, score) of documents that hold a question's term; questions: query_id, term."""
    hits = term_scores(documents, questions.select("query_id", "term").distinct(), key, column)
    return hits.groupBy("query_id", key).agg(F.round(F.sum("score"), 6).alias("score"))


def _shortened(word: Column, most: Column) -> Column:
    """The word, and what is left of it when up to `most` (0 to 2) letters behind the first one go."""
    none = F.array().cast("array<string>")
    without = lambda w, i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w)))
    rest = lambda w, i: F.when(F.length(w) >= i, F.transform(F.sequence(i, F.length(w)), lambda k: without(w, k))).otherwise(none)
    once = rest(word, F.lit(2))
    twice = F.flatten(F.transform(once, lambda w, i: rest(w, i + 2)))  # a second letter goes behind the first one: each pair once
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, once).otherwise(none), F.when(most >= 2, twice).otherwise(none)))


def edits_allowed(word: Column) -> Column:
    """Two letters stand as they are, up to five take one edit, longer words two."""
    return F.when(F.length(word) < 3, 0).when(F.length(word) < 6, 1).otherwise(2)


def near_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, near, weight): vocabulary words within a term's edits that begin alike; a word of its own weighs 1, others less by their edits.

    Both sides are shortened by up to two letters and meet where something equal is left, so that no term meets every word.
    Words whose first letter and length fit no term are left out before.
    """
    left = asked.select("term").distinct().select("term", F.explode(_shortened(F.col("term"), edits_allowed(F.col("term")))).alias("rest"))
    reach = F.when(F.length("near") < 2, 0).when(F.length("near") < 4, 1).otherwise(2)
    shape = lambda c, d: (F.substring(c, 1, 1).alias("letter"), (F.length(c) + d).alias("size"))
    shapes = asked.select("term", F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("d")).select(*shape("term", F.col("d"))).distinct()
    words = vocabulary.select(F.col("term").alias("near")).distinct()
    right = words.withColumns(dict(zip(("letter", "size"), shape("near", F.lit(0)), strict=True))).join(shapes, ["letter", "size"], "left_semi").select("near", F.explode(_shortened(F.col("near"), reach)).alias("rest"))
    met = left.join(right, "rest").select("term", "near").distinct().withColumn("edits", F.levenshtein("term", "near"))
    fits = (F.col("edits") <= edits_allowed(F.col("term"))) & (F.substring("term", 1, 1) == F.substring("near", 1, 1))
    return met.where(fits).select("term", "near", (1 - F.col("edits") / F.least(F.length("term"), F.length("near"))).alias("weight"))


def field_search(documents: DataFrame, questions: DataFrame, key: str, boosts: dict[str, float], fuzzy_fields: list[str], tie: float = 0.3, fuzzy: float = 0.3) -> DataFrame:
    """(query_id, key, score) over several fields: the best field's BM25 (times its boost) and `tie` of the others, and `fuzzy` of the best fuzzy field.

    In the fuzzy leg each asked term counts by the best of its near terms that a field holds. Terms are scored once a document,
    whichever questions ask them; then questions come in. All sums are by document, so texts are shuffled once a field.
    """
    asked = staged(questions.select("query_id", "term").distinct(), "asked")
    # terms have numbers, so that what is summed up a document goes by numbers only
    terms = staged(asked.select("term").distinct().withColumn("asked", F.monotonically_increasing_id()), "asked-numbers")
    best, legs = None, {}
    for f in boosts:
        wanted = terms.select("term", "asked", F.lit(1.0).alias("weight"), F.lit(len(legs)).alias("leg"))
        legs[f"e_{f}"] = len(legs)
        if f in fuzzy_fields:
            words = documents.select(F.explode(F.array_distinct(text.words(F.col(f)))).alias("term")).distinct()
            near = near_terms(terms, words).join(terms, "term")
            wanted = wanted.union(near.select("near", "asked", "weight", F.lit(len(legs))))
            legs[f"z_{f}"] = len(legs)
        hits = term_scores(documents, wanted, key, f).select(key, "asked", "leg", (F.col("score") * F.col("weight")).alias("score"))
        best = hits if best is None else best.union(hits)
    # one row a document and asked term: its best score in each field and leg
    by_term = best.groupBy(key, "asked").agg(*[F.max(F.when(F.col("leg") == i, F.col("score"))).alias(n) for n, i in legs.items()])
    total = by_term.join(asked.join(terms, "term").select("query_id", "asked"), "asked").groupBy("query_id", key).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in legs])
    boosted = [F.col(f"e_{f}") * boost for f, boost in boosts.items()]
    most = lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0]
    top = most(boosted)
    exact = top + tie * (sum(boosted[1:], boosted[0]) - top)
    loose = fuzzy * most([F.col(f"z_{f}") for f in fuzzy_fields]) if fuzzy_fields else F.lit(0.0)
    return total.select("query_id", key, (F.floor((exact + loose) * 1e6 + 0.5) / 1e6).alias("score"))  # round() goes through decimals, far slower


#: Rows of one block of vectors and of one block of asked vectors: one call holds both, and never a score more than a slice of them.
VECTOR_BLOCK, ASKED_BLOCK, ASKED_SLICE = 16384, 2048, 256


def _matrix(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, and which are whole: of the most common length, without null entries. Others score null."""
    rows = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(sizes[sizes >= 0]).argmax()) if (sizes >= 0).any() else 0
    out, whole = np.zeros((len(rows), dim)), sizes == dim
    values = rows.filter(pa.array(whole)).flatten()
    entries = pc.is_valid(values).to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.ones((int(whole.sum()), 0), bool)
    out[whole] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else 0
    whole[whole] = entries.all(1)
    return out, whole


def _scores(asked: pa.Table, block: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(slice of the asked, scores to five places, which pairs count); pairs of another length or with nulls score below all others."""
    q, q_whole = _matrix(asked["v"])
    c, c_whole = _matrix(block["v"])
    query_ids, ids = asked["query_id"].to_numpy(), block["doc_id"].to_numpy()
    for at in range(0, len(q), ASKED_SLICE):
        part = slice(at, at + ASKED_SLICE)
        score = np.full((len(q[part]), len(c)), -np.inf)
        if q.shape[1] == c.shape[1]:
            raw = q[part] @ c.T * 1e5
            score = np.where(q_whole[part][:, None] & c_whole[None, :], np.copysign(np.floor(np.abs(raw) + 0.5), raw) / 1e5, -np.inf)
        yield part, score, query_ids[part][:, None] != ids[None, :]


def _in_blocks(vectors: DataFrame, asked: DataFrame, extra: list[str]) -> tuple[GroupedData, GroupedData]:
    """Both sides by block of vectors and block of asked vectors; extra: columns of the asked side beside query_id and v."""
    blocks = max(16, -(-vectors.count() // VECTOR_BLOCK))
    asks = max(1, -(-asked.count() // ASKED_BLOCK))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    c = vectors.select("doc_id", "v", "label", place("doc_id", blocks).alias("block"), all_of(asks).alias("ask"))
    own = [F.col(x).alias(x) for x in ("query_id", "v", "label", *extra)]  # both sides may stem from one table
    q = asked.select(*own, place("query_id", asks).alias("ask"), all_of(blocks).alias("block"))
    return c.groupBy("block", "ask"), q.groupBy("block", "ask")


def nearest(vectors: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(query_id, doc_id, score, rank, good): the n nearest vectors of each asked one by inner product to five places, exactly; good: of the same label.

    vectors: doc_id, v, label; asked: query_id, v, label. Each pair of blocks is one product of matrices, of which the n best rows a query go on.
    """

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(block) or not len(asked):  # an empty side comes without columns
            return none
        block, found = block.sort_by("doc_id"), []
        ids, of_block, of_asked = block["doc_id"].to_numpy(), block["label"].to_pandas(), asked["label"].to_pandas()
        for part, score, counts in _scores(asked, block):
            key = np.where(np.isnan(score), np.inf, score)
            if len(ids) > n + 1:  # the row's own vector may be among them
                least = np.partition(np.where(counts, key, -np.inf), len(ids) - n, axis=1)[:, len(ids) - n]
                counts &= key >= least[:, None]
            row, col = np.nonzero(counts)
            order = np.lexsort((col, -key[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, row, "left")
            kept = np.arange(len(row)) - first < n
            row, col = row[kept], col[kept]
            value = score[row, col]
            good = of_asked.to_numpy()[part][row] == of_block.to_numpy()[col]
            found.append(pa.table({"query_id": asked["query_id"].to_numpy()[part][row], "doc_id": ids[col], "score": pa.array(value, mask=value == -np.inf), "good": good}))
        return pa.concat_tables(found) if found else none

    none = pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "good": pa.array([], pa.bool_())})
    c, q = _in_blocks(vectors, asked, [])
    return ranked(c.cogroup(q).applyInArrow(best, "query_id long, doc_id long, score double, good boolean"), "doc_id", n)


def first_good(vectors: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(query_id, first, at): the rank of the nearest vector of the same label among all, and how many of the n nearest have it.

    Where none of the n nearest has it, the best that has is sought, and the vectors before it are counted, block by block: no pair leaves its task.
    """
    near = staged(nearest(vectors, asked, n), "nearest")
    seen = near.groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).cast("long").alias("first"), F.count_if("good").alias("at"))
    late = staged(asked.join(seen.where("first is null").select("query_id"), "query_id", "left_semi"), "asked")
    if late.isEmpty():
        return seen

    def best_good(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(block) or not len(asked):
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        block = block.sort_by("doc_id")
        ids, of_block, of_asked = block["doc_id"].to_numpy(), block["label"].to_pandas().to_numpy(), asked["label"].to_pandas().to_numpy()
        out = {"query_id": [], "doc_id": [], "score": []}
        for part, score, counts in _scores(asked, block):
            counts &= of_asked[part][:, None] == of_block[None, :]
            key = np.where(counts, np.where(np.isnan(score), np.inf, score), -np.inf)
            some = np.flatnonzero(counts.any(1))
            # where nothing but null scores counts, the smallest id of those that count
            col = np.where(np.isinf(key[some].max(1)) & (key[some].max(1) < 0), counts[some].argmax(1), key[some].argmax(1))
            out["query_id"] += asked["query_id"].to_numpy()[part][some].tolist()
            out["doc_id"] += ids[col].tolist()
            out["score"] += key[some, col].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]))

    def before(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(block) or not len(asked):
            return pa.table({"query_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        ids, out = block["doc_id"].to_numpy(), {"query_id": asked["query_id"].to_numpy(), "n": np.zeros(len(asked), np.int64)}
        for part, score, counts in _scores(asked, block):
            key, least, own = np.where(np.isnan(score), np.inf, score), asked["least"].to_numpy()[part][:, None], asked["own"].to_numpy()[part][:, None]
            out["n"][part] = (counts & ((key > least) | ((key == least) & (ids[None, :] < own)))).sum(1)
        return pa.table(out)

    c, q = _in_blocks(vectors, late, [])
    good = c.cogroup(q).applyInArrow(best_good, "query_id long, doc_id long, score double").groupBy("query_id").agg(F.max_by(F.struct("score", "doc_id"), F.struct("score", -F.col("doc_id"))).alias("g"))
    sought = staged(late.join(good, "query_id").select("query_id", "v", "label", F.col("g.score").alias("least"), F.col("g.doc_id").alias("own")), "sought")
    c, q = _in_blocks(vectors, sought, ["least", "own"])
    ranks = c.cogroup(q).applyInArrow(before, "query_id long, n long").groupBy("query_id").agg((F.sum("n") + 1).alias("later"))
    return seen.join(ranks, "query_id", "left").select("query_id", F.coalesce("first", "later").alias("first"), "at")


def ranked(scores: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fuse(legs: list[DataFrame], key: str, k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked legs."""
    rows = legs[0].select("query_id", key, "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", key, "rank"))
    return rows.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def era_factor(doc_type: Column, outdated: Column, start: Column, end: Column, seen: Column, current: Column, as_of: Column, history: Column, mode: Column, timeline: Column) -> Column:
    """How well a hit's time fits the question's: outdated, as-of, history, and current questions."""
    days = F.date_diff(seen, as_of)
    dated = F.when((start.isNull() | (start <= as_of)) & (end.isNull() | (end >= as_of)), 1.6).otherwise(0.45)
    undated = F.when(seen.isNull(), 1.0).when(days > 120, 0.8).when(days > -365, 1.1).otherwise(1.0)
    return (
        F.when(outdated, 0.3)
        .when(as_of.isNotNull(), F.when(start.isNull() & end.isNull(), undated).otherwise(dated))
        .when(history, F.when(timeline, 1.6).when((doc_type == "fact") & start.isNotNull(), 1.3).otherwise(1.0))
        .when(doc_type != "fact", 1.0)
        .when(mode == "current", F.when(current, 1.25).otherwise(0.4))
        .otherwise(F.when(current, 1.0).otherwise(0.6))
    )
