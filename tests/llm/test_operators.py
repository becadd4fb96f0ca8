"""The ten operators against brute force, on texts with every odd case."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import byte_bpe, compact_windows, context_tree, cotraining, exact_search, minhash_dedup, packing, quality_rules, suffix_dedup, token_files
from lorekeep.llm.tokens import PieceEncoder

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(4)
SYLLABLES = "th er on an re he in ed nd ha at en es or te of st ti hi as é ß".split()


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4)))


def prose(n):
    return " ".join(word() + RNG.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(RNG.randint(20, 260)) for _ in range(30)]
    passage = prose(75)
    texts = [*base, base[0], base[0], base[1].upper(), None, "", "   \n\t ", "one", "one", "a b", "Orre " * 300, passage + " " + base[2], base[3] + "\n" + passage, base[4] + " " + passage + " " + base[5]]
    for k in range(6):  # near copies
        w = base[6].split(" ")
        w[RNG.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts.append(prose(9000))
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns that clash with the operators' own names
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("key", "row_key").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 4 > 0), 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_minhash(docs, rows, empty):
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs, 4, 80).collect()}
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {i: (len(s), top(i), top(i) == i) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() < len(rows)


def test_minhash_residual_groups(spark, monkeypatch):
    """Blocks of two rows: a large bucket still loses no link."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    base = prose(120).split(" ")
    made = []
    for i in range(12):
        w = list(base)
        for j in range(0, i):
            w[(7 * j + i) % len(w)] = f"z{i}_{j}"
        made.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4, 80).collect()}
    sets = {i: shingles(t, 4) for i, t in made}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert all(got[a] == got[b] for a, b in links)
    assert sum(got[i] != i for i in got) <= len(links)


@pytest.mark.parametrize(("run_slices", "ranges"), [(1500, 4096), (2, 4096), (2, 1)])
def test_suffix_dedup(docs, rows, empty, monkeypatch, run_slices, ranges):
    monkeypatch.setattr(suffix_dedup, "RUN_SLICES", run_slices)
    monkeypatch.setattr(suffix_dedup, "MOST_RANGES", ranges)
    count = collections.Counter()
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    for t in raw.values():
        count.update(t[p : p + 200] for p in range(len(t) - 199))
    want = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), sum(gone), sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.repeated_spans(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    if ranges == 1:
        assert suffix_dedup.repeated_spans(empty).count() == 0
        cleaned = suffix_dedup.remove_repeats(docs)
        assert cleaned.columns == docs.columns
        texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
        assert texts[33] is None and len(texts) == len(rows) and texts[0] == ""


def test_suffix_dedup_repeated_rows(spark):
    t = prose(80)
    df = spark.createDataFrame([(1, t), (1, t), (1, "other"), (None, "n")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeated_spans(df).collect())
    n = len(t.encode())
    assert got == sorted([(1, n, n), (1, n, n), (1, 5, 0), (-1, 1, 0)])


def test_suffix_array_order():
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = rng.integers(97, 99, 300, dtype=np.uint8)
        raw = text.tobytes()
        order = suffix_dedup.suffix_array(text)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
        prefixes = suffix_dedup.common_prefixes(text, order, np.array([0]), 320)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert min(int(prefixes[b]), len(raw) - max(a, b)) == n  # beyond a text's end nothing is compared


def test_quality_rules(docs, rows, labels, empty):
    def brute(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        grams, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [s for s in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        return len(w), sum(map(len, w)), sum((x or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = {r["doc_id"]: r for r in quality_rules.score_rules(docs, labels).collect()}
    for i, t, *_ in rows:
        r, want = got[i], brute(t)
        assert tuple(r[c] for c in quality_rules.STATS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.score_rules(empty, labels).count() == 0
    assert quality_rules.filter_by_rules(docs, labels.limit(0)).columns == docs.columns


def test_forest_finds_outsiders():
    rng = np.random.default_rng(1)
    good, odd = rng.normal(0, 0.1, (400, 3)), rng.normal(3, 0.1, (40, 3))
    both = np.concatenate([good, odd])
    forest = quality_rules.grow_forest(good, both.min(0), both.max(0))
    cut = quality_rules.calibrate(quality_rules.anomaly(forest, both), np.arange(440) < 400)
    assert (quality_rules.anomaly(forest, odd) >= cut).mean() > 0.9 and (quality_rules.anomaly(forest, good) >= cut).mean() < 0.05


def test_cotraining(spark, empty):
    made = []
    for i in range(400):
        bad = i % 4 == 0
        made.append((i, prose(80) + (" idiot moron" if bad else ""), "en", "junk" if bad and i % 3 else f"src{i % 5}", 400, "x"))
    df = spark.createDataFrame(made, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in cotraining.classify(df, labels).collect()}
    held_out = range(300, 400)
    assert np.mean([got[i] == (i % 4 != 0) for i in held_out]) > 0.95
    assert cotraining.classify(empty, labels).count() == 0
    assert cotraining.filter_by_classifier(df, labels.limit(0)).count() == 400
    nulls = spark.createDataFrame([(1, None, None, None, None, "k"), (2, "", "en", "s", 0, "k")], SCHEMA)
    assert cotraining.classify(nulls, labels).count() == 2
    assert cotraining.filter_by_classifier(df, labels).columns == df.columns


def encoded(rows, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}


def test_packing(docs, rows, empty):
    ids = encoded(rows, "word_bpe_49k.json")
    spans, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        spans[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, size in [*((p, len(ids[d])) for d, p in spans.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == size if size is not None else 0 < at <= packing.CAPACITY
    assert set(spans) == set(ids)
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_differencing_is_near_equal():
    sizes = [RNG.randint(1, 900) for _ in range(300)]
    loads = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 32)]
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) < 60
    windows = packing.pack([RNG.randint(1, 9000) for _ in range(200)])
    used = sum(n for w in windows for _, _, n in w)
    assert len(windows) * packing.CAPACITY < used * 1.02 + packing.CAPACITY


@pytest.mark.parametrize(
    ("name", "draw"),
    [
        ("texts", lambda: int(RNG.lognormvariate(6.1, 1.2)) + 1),
        ("short", lambda: RNG.randint(1, 900)),
        ("tiny", lambda: RNG.randint(1, 60)),
        ("long", lambda: RNG.randint(3000, 9000)),
        ("equal", lambda: 2049),
        ("exact", lambda: 4096),
        ("mostly one", lambda: 1 if RNG.random() < 0.9 else 4095),
    ],
)
def test_differencing_decides_every_group(monkeypatch, name, draw):
    """Whatever the lengths, a full group's windows are those of the last differencing, with under 1 % of padding; the count rises by one at a time."""
    seen, lengths = [], []
    part = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: seen.append((k, part(sizes, k), sizes)) or seen[-1][1])
    while sum(lengths) < packing.GROUP_WINDOWS * packing.CAPACITY:
        lengths.append(draw())
    windows = packing.pack(lengths)
    loads = [sum(n for _, _, n in w) for w in windows]
    assert max(loads) <= packing.CAPACITY and len(windows) * packing.CAPACITY < sum(lengths) * 1.01 + packing.CAPACITY
    if seen:
        counts = [k for k, _, _ in seen]
        assert counts == list(range(counts[0], counts[0] + len(counts))) and counts[0] == -(-sum(n % packing.CAPACITY for n in lengths) // packing.CAPACITY)
        _, split, sizes = seen[-1]
        assert sorted(sum(sizes[i] for i in w) for w in split if w) == sorted(loads)[: sum(map(bool, split))]
    pieces = sorted(p for w in windows for p in w)
    ends = collections.defaultdict(int)
    for d, s, n in pieces:
        assert s == ends[d] and n > 0
        ends[d] += n
    assert [ends[d] for d in range(len(lengths))] == lengths


def test_window_count_rises(monkeypatch):
    """Capacity is exceeded: the count rises by one, and from the second time on the parts are halved."""
    seen = []
    part = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: seen.append((k, max(sizes))) or part(sizes, k))
    windows = packing.pack([4095, 1] * 200 + [2730] * 3 + [2])  # total just below a multiple of the capacity
    assert len(seen) > 2 and all(b[0] == a[0] + 1 and b[1] <= a[1] for a, b in zip(seen, seen[1:], strict=False)) and seen[-1][1] < seen[0][1]
    assert max(sum(n for _, _, n in w) for w in windows) <= packing.CAPACITY


def test_packing_odd_rows(spark):
    """Ties, repeated ids, a null id and columns of the operator's own names."""
    rows = [(1, "same words here", 5, 6)] * 40 + [(1, "other", 5, 6), (None, "no id", 5, 6), (2, None, 5, 6), (2, "", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, length int").selectExpr("*", "1 AS offset", "2 AS sequence_id").repartition(2)
    got = packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()
    assert sum(r["start"] == 0 for r in got) == len(rows) and sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert collections.Counter(r["doc_id"] for r in got)[None] == 1 and sum(r["doc_tokens"] == 1 for r in got) == 2


def test_token_files(docs, rows, empty):
    ids = encoded(rows, "byte_bpe_50k.json")
    at = 0
    for r in token_files.round_trip(docs, P.path("byte_bpe_50k.json")).orderBy("doc_id").collect():
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert token_files.round_trip(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_token_ranges(spark, docs, rows, tmp_path):
    """Parts of documents from the runs of their blocks alone."""
    ids, path = encoded(rows, "byte_bpe_50k.json"), f"file://{tmp_path}/blocks"
    token_files.write_token_blocks(docs, P.path("byte_bpe_50k.json"), path)
    asked = [(i, n // 3, n - 2 * (n // 3)) for i, n in ((i, len(x)) for i, x in ids.items())]
    got = token_files.read_ids(spark, path, spark.createDataFrame(asked, "doc_id long, start long, length long")).collect()
    assert {(r["doc_id"], bytes(r["ids"])) for r in got} == {(i, ids[i][a : a + n].tobytes()) for i, a, n in asked} and len(got) == len(asked)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for t in range(150):
        v = rng.integers(0, 1 << int(rng.integers(1, 64)), int(rng.integers(0, 500)), dtype=np.uint64)
        if t % 3 == 0:
            v[rng.random(len(v)) < 0.7] = 0
        words, _, escapes = token_files.pack_words(v)
        assert (token_files.unpack_words(words, len(v), escapes) == v).all()
    assert len(token_files.pack_words(np.zeros(1200, np.uint64))[0]) == 10


ODD = ["it's  we'll\n\n'tis", "<|endoftext|> a <|endoftext|>b  <|endoftext|>", "", "   ", "a\x1cb \x1f c", " 1²½ ª µ ß À ſ K ,,, '' ''s 's", "日本語 テキスト 12３", "DON'T we'Re", "a\r\n b\t c", "\xa0x　y"]


def test_piece_encoder():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = PieceEncoder(P.path(name))
        for x in [*ODD, prose(50)]:
            assert np.frombuffer(e.encode([x])[0], "<u4").tolist() == e._tokenizer.encode(x, add_special_tokens=False).ids


def test_byte_bpe(docs, rows, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = byte_bpe.BytePairEncoder(path)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    bits = [" ", "  ", "\n", "'", "'s", "'re", "'ll", "ab", "é", "1", "２", "!", "，", "日", "\xa0", "　", "̈"]
    texts = ODD + ["".join(RNG.choice(bits) for _ in range(RNG.randint(0, 14))) for _ in range(1500)]
    for lo, hi, data, offs in byte_bpe.text_chunks(pa.array(texts)):
        starts = byte_bpe.token_starts(data, offs)
        ids, first = e.encode(data, starts), np.searchsorted(starts, offs)
        for k in range(hi - lo):
            assert np.frombuffer(b"".join(ids[first[k] : first[k + 1]]), "<u4").tolist() == ref.encode_ordinary(texts[lo + k])
    begin = time.perf_counter()
    for t in ["a" * 1_000_000, "=" * 200_001, "".join(RNG.choice("abcdefgh") for _ in range(50_000)), "日本語テキスト" * 3000]:
        assert np.frombuffer(e.merge(t.encode()), "<u4").tolist() == ref.encode_ordinary(t) or "日" in t
    assert time.perf_counter() - begin < 60
    for t in (prose(40).replace(" ", "")[:n] for n in (101, 150, 333)):
        monkey = byte_bpe.LONG_SLICE
        byte_bpe.LONG_SLICE = 10**9
        slow = e.merge(t.encode())
        byte_bpe.LONG_SLICE = monkey
        assert e.merge(t.encode()) == slow
    for r in byte_bpe.digests(docs, path).collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        own = np.array(ref.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.digests(empty, path).count() == 0


@pytest.mark.parametrize("queries", [8192, 3])
def test_exact_search(spark, monkeypatch, queries):
    """Odd vectors, huge components, repeated ids and columns of the operator's own names; in one pass and in many."""
    monkeypatch.setattr(exact_search, "PASS_QUERIES", queries)
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(300)]
    made += [(300, None), (301, [float("nan")] * 16), (302, [float("inf")] + [0.0] * 15), (303, [None] * 16), (304, []), (350, made[0][1]), (351, made[0][1]), (352, [0.5] * 8)]
    made += [(400, [1.0e7, 1.0]), (401, [3.0e7, -1.0]), (402, [1.0e300, 0.0]), (450, [2.0, -1.0e300]), (403, [9.1e15, 7.0]), (7, made[7][1])]
    df = spark.createDataFrame([(*r, 1.0, 1) for r in made], "vec_id long, embedding array<double>, score double, v int")
    low, high = -(2**63), 2**63 - 1024
    own = [(i, [min(max(math.floor(256 * x), low), high) for x in v]) for i, v in made if v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in own:
        if q % 50 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(x, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in own if i != q and len(v) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in exact_search.top_k(df).collect()) == sorted(want)
    assert exact_search.top_k(df.limit(0)).count() == 0


def test_context_tree(docs, rows, spark, empty, monkeypatch):
    small = [r for r in rows if len(r[1] or "") < 400]
    for slots in (22, 8):
        monkeypatch.setattr(context_tree, "GRAM_SLOTS", slots)
        monkeypatch.setattr(context_tree, "WORD_SLOTS", min(slots, 20))
        got = {r["doc_id"]: r for r in context_tree.score_texts(spark.createDataFrame(small, SCHEMA)).collect()}
        tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
        held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
        words, nodes = collections.Counter(), collections.defaultdict(lambda: [0, 0])

        def events(t):
            b = b"\xff" * context_tree.DEPTH + (t or "").encode() + b"\xff"
            for p in range(context_tree.DEPTH, len(b)):
                prefix = 1
                for k in range(7, -1, -1):
                    bit = b[p] >> k & 1
                    yield [(b[p - d : p], prefix) for d in range(context_tree.DEPTH + 1)], bit
                    prefix = 2 * prefix + bit

        for i, t, *_ in small:
            if not held(i):
                words.update(tokens(t))
                for path, bit in events(t):
                    for n in path:
                        nodes[n][bit] += 1
        kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        below, beta = collections.defaultdict(float), {}
        for n in sorted(nodes, key=lambda n: -len(n[0])):
            own, leaf = kt(*nodes[n]), len(n[0]) == context_tree.DEPTH
            weight = own if leaf else float(np.logaddexp(own, below[n])) - math.log(2)
            beta[n] = math.inf if leaf else own - below[n]
            if n[0]:
                below[n[0][1:], n[1]] += weight
        total, distinct = sum(words.values()), len(words)
        for i, t, *_ in small:
            r, own = got[i], tokens(t)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(words[w] > 0 for w in own), total)
            assert math.isclose(r["base_score"], sum(math.log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), rel_tol=1e-9)
            score = 0.0
            for path, bit in events(t):
                p = 0.5
                for n in reversed(path):
                    if n in nodes:
                        c = nodes[n]
                        share = 1 / (1 + math.exp(-min(max(beta[n], -700), 700)))
                        p = share * (c[bit] + 0.5) / (sum(c) + 1) + (1 - share) * p
                    else:
                        p = 0.5
                score += math.log10(p)
            assert math.isclose(r["score"], score, rel_tol=1e-6)
    assert context_tree.score_texts(empty).count() == 0


def test_compact_windows(docs, rows, empty):
    hashes = np.random.default_rng(1).integers(0, 1 << 60, 400, dtype=np.uint64)
    seen = set()
    for a, c, b in zip(*compact_windows.compact_windows(hashes, np.array([0, 400]), 1), strict=True):
        assert hashes[c] == hashes[a : b + 1].min() and (a == 0 or hashes[a - 1] <= hashes[c]) and (b == 399 or hashes[b + 1] <= hashes[c])
        seen.add(int(c))
    assert len(seen) == 400
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(docs).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    low = {r[0]: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")] for r in rows}
    where = collections.defaultdict(set)
    for i, w in low.items():
        for p in range(len(w) - 49):
            where[tuple(w[p : p + 50])].add((i, p))
    need = {(i, p) for v in where.values() if len({i for i, _ in v}) > 1 for i, p in v}
    assert need and all(any(a <= p and p + 50 <= b for a, b in got[i]) for i, p in need)
    clean = [r[0] for r in rows[7:30] if r[0] not in {i for i, _ in need}]
    assert clean and not any(i in got for i in clean)
    assert compact_windows.near_duplicate_passages(empty).count() == 0


def test_minhash_null_and_repeated_rows(spark):
    """Rows with null or repeated ids are documents of their own; of equal rows one stays."""
    a, b, c, d = (prose(120) for _ in range(4))
    near = " ".join([*b.split(" ")[:-1], "edit"])
    made = [(1, a), (1, a), (1, a), (None, c), (None, c), (None, near), (None, None), (None, ""), (2, b), (3, d), (3, a + " tail"), (4, None), (4, None), (5, c + " z")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    kept = collections.Counter(tuple(r) for r in minhash_dedup.drop_near_duplicates(df).collect())
    assert kept == collections.Counter([(1, a), (None, None), (None, ""), (2, b), (3, d), (4, None), (5, c + " z")])
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True)}


def test_compact_windows_edited_passages(spark):
    """50-word passages with the 26th word changed (Jaccard 41/51), at odd places: each is found on both sides."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    made, places, low = [], {}, {}
    for k in range(150):
        passage, edited = fresh(50), None
        edited = [*passage[:25], "edit", *passage[26:]]
        for i, w in ((2 * k, passage), (2 * k + 1, edited)):
            head = fresh(rng.randint(440, 540) if k % 2 else rng.randint(0, 90))
            low[i] = [*head, *w, *fresh(rng.randint(0, 90))]
            made.append((i, " ".join(low[i])))
            places[i] = len(head)
    grams = lambda w: {tuple(w[p : p + 5]) for p in range(len(w) - 4)}
    need = set()
    for i, p in places.items():
        x, y = grams(low[i][p : p + 50]), grams(low[i ^ 1][places[i ^ 1] : places[i ^ 1] + 50])
        if 5 * len(x & y) >= 4 * len(x | y):
            need.add((i, p))
    assert len(need) == 300
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(spark.createDataFrame(made, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    missed = [(i, p) for i, p in need if not any(a <= p and p + 50 <= b for a, b in got[i])]
    assert not missed


def grams(w):
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)}


def test_compact_windows_near_passages(spark):
    """Passages at Jaccard 0.8 to 0.95, edits 20 to 60 words apart wherever they lie: substituted, put in or left out."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    made, places = [], []
    while len(places) < 200:
        passage = fresh(rng.choice([60, 90, 120, 240, 400]))
        edited, at = list(passage), rng.randint(8, 60)
        while at < len(edited) - 8:
            kind = rng.randrange(3)
            edited[at : at + (kind != 1)] = [] if kind == 2 else fresh(1)
            at += rng.randint(20, 60)
        x, y = grams(passage), grams(edited)
        if 5 * len(x & y) >= 4 * len(x | y) and len(x & y) < 0.95 * len(x | y):
            i = len(made)
            for k, w in enumerate((passage, edited)):
                head = fresh(rng.randint(0, 90))
                made.append((i + k, " ".join([*head, *w, *fresh(rng.randint(0, 90))])))
                places.append((i + k, len(head), len(w)))
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    covered = [max((min(b, p + n) - max(a, p) for a, b in got[i]), default=0) / n for i, p, n in places]
    assert np.mean(np.array(covered) >= 0.8) >= 0.95 and min(covered) > 0


@pytest.mark.parametrize("fragment", [8, 30])
def test_compact_windows_amid_fragments(spark, fragment):
    """Exact runs whose parts also stand in unrelated texts lose no link, whichever text leads a group."""
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    made, places = [], []
    for _ in range(12):
        passage = fresh(60)
        for _ in range(2):
            head = fresh(rng.randint(0, 60))
            places.append((len(made), len(head)))
            made.append((len(made), " ".join([*head, *passage, *fresh(rng.randint(0, 60))])))
        for k in range(0, 60 - fragment + 1, 3):
            made.append((len(made), " ".join([*fresh(rng.randint(20, 80)), *passage[k : k + fragment], *fresh(rng.randint(20, 80))])))
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"], r["class_id"]))
    for (i, p), (j, q) in zip(places[::2], places[1::2], strict=True):
        assert {c for a, b, c in got[i] if a <= p and p + 60 <= b} & {c for a, b, c in got[j] if a <= q and q + 60 <= b}
    assert set(got) == {i for i, _ in places}


@pytest.mark.parametrize(("sharers", "middle"), [(0, True), (16, False), (80, True)])
def test_compact_windows_near_passages_amid_fragments(spark, sharers, middle):
    """Near passages (91 words, one edit) lose no link, though 34 words of each half stand in unrelated texts as well."""
    rng = random.Random(sharers)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    made, pairs = [], []
    for _ in range(15):
        passage = fresh(91)
        edited = list(passage)
        edited[45 if middle else rng.randint(5, 85)] = "edit"
        sides = []
        for w in (passage, edited):
            head = fresh(rng.randint(0, 60))
            sides.append((len(made), len(head)))
            made.append((len(made), " ".join([*head, *w, *fresh(rng.randint(0, 60))])))
        pairs.append(sides)
        for half in (passage[:45], passage[46:]):
            for at in (rng.randint(0, 11) for _ in range(sharers)):
                made.append((len(made), " ".join([*fresh(rng.randint(10, 50)), *half[at : at + 34], *fresh(rng.randint(10, 50))])))
    rng.shuffle(made)
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"], r["class_id"]))
    linked = [{c for a, b, c in got[i] if a <= p + 9 and b >= p + 82} & {c for a, b, c in got[j] if a <= q + 9 and b >= q + 82} for (i, p), (j, q) in pairs]
    assert all(linked) and set(got) == {i for sides in pairs for i, _ in sides}


def test_compact_windows_near_repeats_inside_one_text(spark):
    """A near repeat in the same text is found at any distance from its first."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    made, where = [], {}
    for n in (55, 80, 130):
        for gap in (3, 10, 30, 60, 85, 120):
            for _ in range(3):
                passage = fresh(n)
                edited = list(passage)
                edited[rng.randint(5, n - 5)] = "edit"
                head = fresh(rng.randint(0, 100))
                where[len(made)] = (n, len(head), len(head) + n + gap)
                made.append((len(made), " ".join([*head, *passage, *fresh(gap), *edited, *fresh(rng.randint(0, 100))])))
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(spark.createDataFrame(made, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    assert all(max(min(b, at + n) - max(a, at) for a, b in got[i]) >= 0.8 * n for i, (n, *places) in where.items() for at in places)


def test_compact_windows_odd_rows(spark):
    """Copies, repeated rows and ids, repeats inside a text, a very long text, a hot passage, columns of the operator's own names."""
    rng = random.Random(14)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    hot, twin, long_ = fresh(60), " ".join(fresh(80)), fresh(30_000)
    made = [(k, " ".join([*fresh(9), *hot, *fresh(9)])) for k in range(300)]
    inner = fresh(55)
    made += [(900, twin), (901, twin), (901, twin), (None, twin), (902, None), (902, ""), (903, " ".join([*inner, *fresh(30), *inner])), (904, " ".join(long_)), (905, " ".join(long_[9000:9070])), (905, twin)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in made], "doc_id long, text string, text_key int, a int, copies int").repartition(7)
    got = collections.defaultdict(list)
    for r in compact_windows.near_duplicate_passages(df).collect():
        got[r["doc_id"]].append((r["start_word"], r["n_words"], r["class_id"]))
    assert len({c for k in range(300) for _, _, c in got[k]}) == 1 and all(got[k] == [(9, 60, got[0][0][2])] for k in range(300))
    assert [x[:2] for x in got[900]] == [(0, 80)] and got[900] == got[901]
    assert sorted(x[:2] for x in got[903]) == [(0, 55), (85, 55)] and len({x[2] for x in got[903]}) == 1
    assert [x[:2] for x in got[904]] == [(9000, 70)] and sorted(x[:2] for x in got[905]) == [(0, 70), (0, 80)]
    assert set(got) == {*range(300), 900, 901, 903, 904, 905}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force; without labels no model drops a row, and the rules are the base rule alone."""
    import corpus_pipeline

    shared, base = prose(60), [prose(120) for _ in range(9)]
    near = " ".join([*base[1].split(" ")[:-1], "edit"])
    made = [(1, base[0]), (1, base[0]), (1, base[8]), (2, base[1]), (3, near), (None, base[2]), (None, base[2]), (None, base[0]), (4, None), (None, ""), (5, "few words"), (6, "a b c " * 90)]
    made += [(7, base[3] + " " + shared + " " + base[4]), (8, base[5] + " " + shared + " " + base[6]), (None, base[7])]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stage, bag = dict(corpus_pipeline.STAGES), lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())

    def passes(t):
        w = (t or "").split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    docs = stage["quality_rules"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    want = [(i, t) for i, t in made if passes(t)]
    assert bag(docs) == collections.Counter(want)
    docs = stage["quality_classifier"](spark, docs, folder)
    assert bag(docs) == collections.Counter(want)

    kept = []
    for i, t in sorted(want, key=lambda x: (x[0] is None, x[0] or 0)):  # no chains of links here
        s = shingles(t, 5)
        if all(100 * len(s & shingles(u, 5)) < 80 * len(s | shingles(u, 5)) for _, u in kept):
            kept.append((i, t))
    docs = stage["minhash_near_dedup"](spark, docs, folder)
    assert bag(docs) == collections.Counter(kept)

    count = collections.Counter(t.encode()[p : p + 200] for _, t in kept for p in range(len(t.encode()) - 199))
    clean = []
    for i, t in kept:
        raw = t.encode()
        gone = {p + j for p in range(len(raw) - 199) if count[raw[p : p + 200]] > 1 for j in range(200)}
        clean.append((i, bytes(b for p, b in enumerate(raw) if p not in gone).decode(errors="replace")))
    assert clean != kept
    docs = stage["suffix_array_dedup"](spark, docs, folder)
    assert bag(docs) == collections.Counter(clean)

    ids = [e for _, e in sorted(encoded([(n, t) for n, (_, t) in enumerate(clean)], "word_bpe_49k.json").items())]
    for packed in (stage["packing"](spark, docs, folder), corpus_pipeline.run(spark, folder)):
        got = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
        assert got == collections.Counter((i, 0, len(e), zlib.crc32(e.tobytes())) for (i, _), e in zip(clean, ids, strict=True))
