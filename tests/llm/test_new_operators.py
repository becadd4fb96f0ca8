"""Whitening, token counts and importance resampling against brute force, with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lorekeep.llm import importance, token_counts, whitening

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(11)
SYLLABLES = "th er on an re he in ed nd ha at en es or te of st ti hi as é ß 日 本 😀 ▁ < s > \n".split(" ")


def prose(n):
    return " ".join("".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4))) for _ in range(n))


# -- whitening ------------------------------------------------------------------------------------


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    monkeypatch.setattr(whitening, "FAN", 2)
    gen = np.random.default_rng(3)
    vectors = (gen.normal(size=(150, 12)) @ gen.normal(size=(12, 12)) * 0.1).astype(np.float32)
    made = [(i, v.tolist()) for i, v in enumerate(vectors)]
    made += [(3, made[3][1]), (None, made[4][1]), (200, None), (201, [float("nan")] * 12), (202, [None] * 12), (203, [float("inf")] + [0.0] * 11), (204, []), (205, [1.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "'x' AS component").repartition(5)
    got = whitening.whiten(df, components=8).collect()
    used = [(i, v) for i, v in made if v and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in used]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes / np.sqrt(values)
    assert len(got) == 8 * n
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    for j in range(8):
        mine = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in got if r["component"] == j + 1)
        theirs = sorted((i if i is not None else -1, d, w) for (i, _), d, w in zip(used, deviation, want[:, j], strict=True))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    for r in got:
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [0.001 * i, 0.001 * i]) for i in range(10)], schema)).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 2} == {True} and all(r["identity_error"] < 1e-9 for r in line)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 3.0])], schema)).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge} == {None}


def test_exact_sums_beyond_a_long(spark):
    rows = [(i, [2.0**60, -(2.0**60), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    assert whitening.exact_sums(df, 3, 5) == (40, [40 * (2**60 + 5), 40 * (5 - 2**60), 40 * 8])


# -- token counts ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


ODD = ["", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\n b\r\n", "<s> x </s> <0x0A> <unk>", "▁", "a▁b ▁ c", "日本語 テキスト", "ab\x00c", "é ﬁ Ａ", "👩‍👩‍👧 x", "\t\tx\t y", "\x85  　z", "=" * 500, " " * 300, "x" + " " * 77 + "y"]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (7, 3), (1 << 16, 512)])
def test_token_counts(spark, pieces, chunk, overlap):
    texts = [*ODD, None, *(prose(RNG.randint(1, 120)) for _ in range(25)), "aaab" * 200, "日本" * 150, "the " + "=" * 700 + " end of it", "word" + " " * 400 + "word", prose(40).replace(" ", "")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "a "), (None, "null id"), (7, prose(150)), (25, texts[25])]
    rows += [(900, rows[-2][1]), (900, rows[-2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "7 AS chunk", "1 AS n_tokens", "2 AS n_bytes").repartition(3)
    got = token_counts.count_tokens(df, P.path("piece_bpe_32k.model"), 50, chunk, overlap).collect()
    want = sorted(((-1 if i is None else i), len((t or "").encode()), n := len(pieces.encode(t or "")), n > 50) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_token_counts_empty(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0


def test_splices_are_proven(pieces):
    """Whatever the border, what two chunks agree on splices to the encoding of the whole."""
    count = token_counts.counter(P.path("piece_bpe_32k.model"))
    alphabet = ["the", " ", "  ", "日", "本語", "a", "aa", "ing", "=", "==", "\n", "é", "😀", "s", "er", "\x00"]
    checked = 0
    for _ in range(1500):
        text = "".join(RNG.choice(alphabet) for _ in range(RNG.randint(10, 60)))
        at = RNG.randint(1, len(text) - 1)
        end = RNG.randint(at, len(text))
        zones = []
        for body, begin, lo in ((text[:end], 0, at), (text[at:], at, 0)):
            parts = count.parts(body)
            numbers = count.counts(parts)
            zones.append((sum(numbers), {t[:3]: t[3] for t in count.tokens(parts, numbers, lo, lo + end - at, begin)}))
        (left, a), (right, b) = zones
        for common in a.keys() & b.keys():
            checked += 1
            assert a[common] + right - b[common] == len(pieces.encode(text)), (text, at, end, common)
    assert checked > 2000


# -- importance resampling ------------------------------------------------------------------------


def runs_of(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, bench, n, buckets, seed, min_words, percent):
    def sums(texts):
        s = [0] * buckets
        for t in texts:
            for f in runs_of(t, n)[1]:
                s[zlib.crc32(f.encode()) % buckets] += 1
        return s

    s, t = sums(x for _, x in rows), sums(bench)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        words, found = runs_of(x, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    ranked = sorted((r for r in out if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(ranked[: percent * len(ranked) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("n", "chunk"), [(1, 1 << 18), (1, 50), (3, 40), (2, 1)])
def test_importance(spark, n, chunk):
    texts = [None, "", " .,- ", "one", "A" * 300 + " b", "Word word WORD wörd Ünï 日本", "x-y_z 1a2 " * 30, "é" * 100, *(prose(RNG.randint(1, 90)) + RNG.choice(["", "!", "日"]) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose(30)), (12, prose(25))]
    bench = [prose(RNG.randint(5, 40)) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'r' AS row", "2 AS own", "3 AS rank").repartition(5)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = importance.resample(df, target, n, 500, "2024", 20, 30, chunk)
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == brute(rows, bench, n, 500, "2024", 20, 30)
    assert {t for c, t in got.dtypes} == {"bigint"}


def test_importance_ties_and_empty(spark):
    schema = "doc_id long, text string"
    target = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert importance.resample(spark.createDataFrame([], schema), target).count() == 0
    same = " ".join(["alpha"] * 25)
    got = importance.resample(spark.createDataFrame([(4, same)] * 10 + [(2, same)] * 10, schema), target.limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len({r["doc_id"] for r in got if r["rank"]}) == 1


def test_buckets_are_crc32():
    texts = ["Plain words, 12 ab-cd", "x" * 5000 + " y", "ÄÖ äö 日本"]
    body = "".join(texts).encode()
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends, first = importance.word_spans(np.frombuffer(body, np.uint8), offs)
    last = np.repeat(first[1:], np.diff(first))
    found = [(int(a), int(b)) for at, bucket in importance.run_buckets(np.frombuffer(body, np.uint8), starts, ends, last, 2, 10000) for a, b in zip(at, bucket, strict=True)]
    want = [zlib.crc32(f.encode()) % 10000 for k in (1, 2) for t in texts for f in [" ".join(runs_of(t, 1)[0][i : i + k]) for i in range(len(runs_of(t, 1)[0]) - k + 1)]]
    assert [b for _, b in found] == want
