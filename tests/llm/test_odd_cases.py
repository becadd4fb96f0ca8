"""The classifier against a plain version of itself, exact prefixes, and odd rows of the earlier operators."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import context_tree, cotraining, packing, quality_rules, suffix_dedup, token_files

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(21)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word():
    return "".join(RNG.choice("th er on an re he in ed nd ha at en es or".split()) for _ in range(RNG.randint(1, 3)))


def prose(n):
    return " ".join(word() + RNG.choice(["", "", ",", "."]) for _ in range(n))


# -- co-training ----------------------------------------------------------------------------------


def fitted(x, y, penalty, steps):
    """Ridge logistic regression, both classes alike, by the same accelerated steps in plain doubles."""
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w, b
    rate = 1 / (0.25 * (share * ((x**2).sum(1) + 1)).sum() + penalty)
    for t in range(steps):
        g = share * (1 / (1 + np.exp(-(x @ vw + vb))) - y)
        nw, nb = vw - rate * (x.T @ g + penalty * vw), vb - rate * g.sum()
        vw, vb = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def brute_view(names, dense, rows, good):
    """A view by words themselves instead of hashes: its margin for any rows."""
    n1, n0 = good.sum(), (~good).sum()
    picked = []
    for name in sorted(set().union(*(names[i] for i in rows))):
        inside = np.array([name in names[i] for i in rows])
        a, b = (inside & good).sum(), (inside & ~good).sum()
        p = (a + b) / (n1 + n0)
        z = abs(a / n1 - b / n0) / np.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        if a + b >= 5 and z > 3:
            picked.append(name)
    center, scale = dense[rows].mean(0), dense[rows].std(0) + 1e-6
    matrix = lambda at: np.concatenate([np.array([[n in names[i] for n in picked] for i in at], float).reshape(len(at), len(picked)), (dense[at] - center) / scale], 1)
    w, b = fitted(matrix(rows), good, 1e-4, 250)
    return lambda at: matrix(at) @ w + b


def brute_co_training(texts, meta, good_of, pool):
    names = [[{w for x in re.findall(r"[^\x20\x09-\x0D]+", t) if True for w in [re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", x).lower()]} for t in texts], [set(m) for m in meta]]
    chunk = pa.array(texts)
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    size = np.log1p(np.diff(offs)).astype(float)[:, None]
    dense = [quality_rules.rule_stats(data, offs)[1], np.concatenate([size, size**2 / 10], 1)]
    assert len(chunk) == len(texts)
    labelled = np.random.default_rng(3).permutation(np.array(sorted(good_of)))
    good = np.array([good_of[i] for i in labelled])
    held = np.arange(len(labelled)) % 3 == 2
    calib, calib_good = labelled[held], good[held]
    sets = [(labelled[~held], good[~held])] * 2
    left = np.array(pool)
    for step in range(cotraining.ROUNDS + 1):
        raw = [brute_view(names[v], dense[v], *sets[v]) for v in (0, 1)]
        sure = []
        for v in (0, 1):
            w, b = fitted(raw[v](calib)[:, None], calib_good, 1e-6, 500)
            sure.append(lambda at, v=v, w=w, b=b: w[0] * raw[v](at) + b)
        if step == cotraining.ROUNDS or not len(left):
            break
        taken = set()
        for v in (0, 1):
            p = 1 / (1 + np.exp(-sure[v](left)))
            for verdict, q in ((True, p), (False, 1 - p)):
                top = [i for i in np.argsort(-q, kind="stable")[: cotraining.EXCHANGED] if q[i] >= cotraining.CONFIDENCE]
                rows, labels = sets[1 - v]
                sets[1 - v] = np.concatenate([rows, left[top]]), np.concatenate([labels, np.full(len(top), verdict)])
                taken |= set(top)
        left = np.array([x for i, x in enumerate(left) if i not in taken], int)
    both = np.stack([s(calib) for s in sure], 1)
    w, b = fitted(both, calib_good, 1e-3, 250)
    w = np.maximum(w, 0)
    fine = np.sort(both[calib_good] @ w + b)
    cut = min(0.0, fine[int(len(fine) * cotraining.GOOD_LOSS)])
    every = np.arange(len(texts))
    views = [s(every) for s in sure]
    total = w[0] * views[0] + w[1] * views[1] + b
    return views, total, total - cut


def test_cotraining_equals_brute_force(spark):
    texts, meta, good = [], [], {}
    for i in range(260):
        bad = i % 3 == 0
        texts.append(prose(RNG.randint(20, 60)) + (" Zorg, blast!" if bad and i % 7 else " calm" if RNG.random() < 0.6 else ""))
        meta.append((f"s:{'junk' if bad and i % 2 else 'site' + str(i % 3)}", f"l:{['en', 'de'][i % 2]}"))
        if i < 170:
            good[i] = not bad
    rows = [(i, t, m[1][2:], m[0][2:], len(t)) for i, (t, m) in enumerate(zip(texts, meta, strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in good.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.classify(df, labels).collect()}
    views, total, above = brute_co_training(texts, meta, good, list(range(170, 260)))
    p = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for i in range(260):
        assert abs(got[i]["p_text"] - p(views[0][i])) < 0.02 and abs(got[i]["p_meta"] - p(views[1][i])) < 0.02 and abs(got[i]["score"] - p(total[i])) < 0.02
        assert got[i]["kept"] == (above[i] >= 0) or abs(above[i]) < 0.05
    assert 0 < sum(r["kept"] for r in got.values()) < 260


def test_cotraining_odd_rows(spark):
    """Repeated rows and ids, one very long text, ties, null metadata, columns of the operator's own names."""
    made = [(i, prose(40) + (" zorg blast" if i % 4 == 0 else ""), "en", "s", 1) for i in range(120)]
    long_ = " ".join([prose(2000)] * 60)
    made += [made[5], made[5], (5, "other text " + prose(30), None, None, None), (None, made[4][1], "en", "s", 1), (500, long_, "en", "s", 1), (501, "", None, None, 0), (502, None, "en", "s", 0)]
    df = spark.createDataFrame(made, SCHEMA).selectExpr("*", "0.5D AS p_text", "0.1D AS p_meta", "'x' AS score", "false AS kept", "7 AS own_0", "8 AS good", "9 AS quality").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)] + [(5, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(df, labels).collect()
    assert len(got) == len(made)
    same = [(r["p_text"], r["p_meta"], r["score"], r["kept"]) for r in got if r["doc_id"] == 5]
    assert len(same) == 4 and len(set(same)) <= 2  # three equal rows score alike
    kept = cotraining.filter_by_classifier(df, labels)
    assert kept.columns == df.columns and dict(kept.dtypes) == dict(df.dtypes)
    texts = collections.Counter(r["text"] for r in kept.collect())
    assert texts[long_] <= 1 and not any(t and t.endswith("zorg blast") for t in texts)
    alike = spark.createDataFrame([(i, "same words all over", "en", "s", 1) for i in range(60)], SCHEMA)  # ties: nothing tells good from bad
    flat = cotraining.classify(alike, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")).collect()
    assert len({(r["p_text"], r["score"], r["kept"]) for r in flat}) == 1


# -- suffix arrays --------------------------------------------------------------------------------


def test_common_prefixes_are_exact():
    """Each suffix's common prefix with its predecessor equals a byte by byte comparison, the end of the text included."""
    rng = np.random.default_rng(9)
    for alphabet in (1, 2, 4, 26):
        for n in (1, 2, 17, 300):
            raw = rng.integers(97, 97 + alphabet, n, dtype=np.uint8).tobytes()
            order = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8))
            assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))
            prefixes = suffix_dedup.common_prefixes(np.frombuffer(raw, np.uint8), order, np.array([0]), n + 8)
            for a, b in zip(order, order[1:], strict=False):
                k = 0
                while max(a, b) + k < n and raw[a + k] == raw[b + k]:
                    k += 1
                assert min(int(prefixes[b]), n - max(a, b)) == k


# -- odd rows of other operators --------------------------------------------------------------------


def test_token_files_of_one_id(spark):
    """Many rows of one id, a null id and clashing columns: the rows follow each other, counted from the ids before them."""
    rows = [(7, prose(RNG.randint(1, 30))) for _ in range(300)] + [(3, "first"), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS n_tokens", "'x' AS ids").repartition(5)
    got = token_files.round_trip(df, P.path("byte_bpe_50k.json")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {7: 300, 3: 1, 9: 2}
    ordered = sorted(got, key=lambda r: (r["doc_id"], r["start"]))
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]


def test_quality_rules_clashing_columns(spark):
    made = [(i, prose(60), "en", "s", 1) for i in range(40)] + [(0, prose(60), "en", "s", 1), (None, prose(60), "en", "s", 1)]
    df = spark.createDataFrame(made, SCHEMA).selectExpr("*", "true AS kept", "0.1D AS anomaly", "3 AS n_words", "4 AS quality")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality_rules.score_rules(df, labels).count() == len(made)
    kept = quality_rules.filter_by_rules(df, labels)
    assert kept.columns == df.columns and kept.count() > 20


def test_context_tree_very_long_and_repeated(spark):
    """A very long text, repeated rows and one common byte pair score like any other text: code length adds up over equal rows."""
    base = "e " * 30_000 + prose(500)
    rows = [(i, prose(50)) for i in range(20)] + [(30, base), (31, base), (31, base), (32, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'k' AS key").repartition(3)
    got = context_tree.score_texts(df).collect()
    assert len(got) == len(rows)
    same = {(round(r["score"], 6), r["n_tokens"]) for r in got if r["doc_id"] in (30, 31)}
    assert len(same) == 1 and all(r["score"] < 0 for r in got)


def test_packing_groups_of_real_lengths():
    """Lengths as texts have them fill a group by the differencing alone, at 99 % and more."""
    lengths = []
    while sum(lengths) < packing.GROUP_WINDOWS * packing.CAPACITY:
        lengths.append(int(RNG.lognormvariate(6.2, 1.1)) + 1)
    windows = packing.pack(lengths)
    assert sum(lengths) >= 0.99 * len(windows) * packing.CAPACITY


# -- the pipeline -----------------------------------------------------------------------------------

EXTRA = ["1 AS kept", "'x' AS score", "2 AS own_0", "0.5D AS anomaly", "3 AS component_id", "4 AS start", "5 AS text_key"]


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", *EXTRA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_with_labels(spark, tmp_path):
    """With labels the models drop junk and toxic texts, keep clean ones, and every stage returns the columns of documents, whatever they are called."""
    import corpus_pipeline

    rows, bad = [], set()
    for i in range(400):
        toxic = i % 5 == 0
        bad |= {i} if toxic else set()
        rows.append((i, prose(RNG.randint(70, 120)) + (" zorg blast" * 3 if toxic else ""), "en", f"s{i % 3}", 1))
    junk = lambda: " ".join("".join(RNG.choice("#*$%&|<>xq") for _ in range(9)) for _ in range(90))
    rows += [(k, junk(), "en", "s0", 1) for k in range(600, 625)]  # labelled as bad, so that the cut-off knows what junk looks like
    rows += [(1000, junk(), "en", "s0", 1), (1001, "few words", "en", "s0", 1), (1002, None, None, None, None), (1003, rows[1][1], "en", "s1", 1)]
    folder = str(tmp_path)
    write(spark, folder, rows, [(i, 1, int(i in bad)) for i in range(300)] + [(k, 0, 0) for k in range(600, 625)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen[name] = ids
        assert name == "packing" or docs.columns == columns
    clean = set(range(400)) - bad
    assert not {1000, 1001, 1002, *range(600, 625)} & seen["quality_rules"] and len(clean & seen["quality_rules"]) >= 0.97 * len(clean)
    assert len(bad & seen["quality_classifier"]) <= 0.05 * len(bad) and len(clean & seen["quality_classifier"]) >= 0.95 * len(clean)
    assert len({1, 1003} & seen["minhash_near_dedup"]) == 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == seen["packing"] == seen["minhash_near_dedup"]


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    write(spark, str(tmp_path), [], [(1, 1, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
