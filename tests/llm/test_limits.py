"""What the check's limits rest on: memory, disk and work that don't come back."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lorekeep.llm import compact_windows, minhash_dedup, packing, tokens
from lorekeep.session import staged


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def test_staged_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    wide = spark.range(2000).repartition(7, "id").groupBy((F.col("id") % 13).alias("k")).count()
    tables = [staged(wide, "left-over"), staged(wide, "left-over")]
    assert _shuffle_files(spark) <= before
    assert [t.agg(F.sum("count")).first()[0] for t in tables] == [2000, 2000]


def test_differencing_holds_loads_of_merged_items_only():
    sizes = [64 + 7 * i % 448 for i in range(4000)]
    tracemalloc.start()
    windows = packing.differencing(sizes, 320)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(i for w in windows for i in w) == list(range(4000))
    assert peak < 5 << 20


def test_encoder_with_a_small_cache_stays_small_and_equal():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{i * j % 7919}x né" for j in range(200)) for i in range(1, 40)]
    small = tokens.PieceEncoder(path, 1 << 14)
    got = [small.encode([t])[0] for t in texts]
    assert got == tokens.PieceEncoder(path).encode(texts)
    assert len(small._known._past) + len(small._known.now) < 600


def test_plain_texts_are_encoded_in_one_pass(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["A plain text, with 3 words it's met before.", "A plain text, été\n\n  twice", ""]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokens.PieceEncoder(path)._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def searched(found):
        raise AssertionError("a second search")

    monkeypatch.setattr(tokens, "_places_of_none", searched)
    assert tokens.PieceEncoder(path).encode(texts) == expected


def test_minhash_keeps_unwanted_texts_from_the_shuffle(spark):
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("row_key"))
    wanted = rows.where("id % 50 = 0").select("row_key")
    kept = {r["id"] for r in minhash_dedup._maybe(rows, wanted).collect()}
    assert {i for i in range(0, 3000, 50)} <= kept and len(kept) < 70


def test_minhash_compares_a_pair_in_its_first_bucket_only(spark, monkeypatch):
    """Four texts, all in the same 32 buckets and under the threshold, are marked once, not in every bucket."""
    regs = np.arange(len(minhash_dedup._SEEDS), dtype=np.uint16)
    keys = minhash_dedup.band_keys(regs[None, :])[0].tolist()
    rows = spark.createDataFrame([(k, d, d) for k in keys for d in range(4)], "key long, doc_id long, label long")
    sigs = spark.createDataFrame([(d, bytearray(regs.tobytes()), 9) for d in range(4)], "doc_id long, regs binary, n_shingles long")
    sets = spark.createDataFrame([(d, bytearray(np.arange(9 * d, 9 * d + 9, dtype=np.uint64).tobytes())) for d in range(4)], "doc_id long, s binary")
    marked = []

    def counted(df, name):
        out = staged(df, name)
        marked.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "staged", counted)
    assert minhash_dedup._cross_links(rows, sigs, sets, 80).count() == 0
    assert marked == [4]


def test_compact_windows_makes_longer_keys_of_many_texts_at_once():
    rng = np.random.default_rng(3)
    sizes = [0, 30, 200, 45, 90]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.integers(0, 1 << 62, begin[-1], dtype=np.uint64)
    _, text, _, lo, hi = compact_windows.signatures(x, begin)
    got = compact_windows.longer_keys(x, begin, text, lo, hi)
    want = []
    for k, n in enumerate(sizes):
        own = text == k
        key, _, *run = compact_windows.longer_keys(x[begin[k] : begin[k + 1]], np.array([0, n]), np.zeros(own.sum(), np.int64), lo[own], hi[own])
        want += zip(key.tolist(), [k] * len(key), *(c.tolist() for c in run))
    assert want and [*zip(*(c.tolist() for c in got))] == want
    places = compact_windows.repeated_runs(begin, lo + begin[text], hi + begin[text], np.ones(len(lo), bool))
    assert places.tolist() == [p for k, n in enumerate(sizes) for p in range(begin[k], begin[k] + n - compact_windows.MIN_SHINGLES + 1)]


def test_compact_windows_moves_a_run_as_one_number():
    at, lo, hi = np.array([5, 70_019, 9]), np.array([5, 70_000, 3]), np.array([5, 70_019, 9])
    for got, want in zip(compact_windows.unpacked(compact_windows.packed(at, lo, hi)), (at, lo, hi), strict=True):
        assert got.tolist() == want.tolist()
    assert len(compact_windows.SEED) == 5


def test_compact_windows_leaves_out_seeds_less_than_a_passage_apart():
    places = np.array([0, 20, 300])
    rows = [np.full(3, 8), np.full(3, 1), compact_windows.packed(places, places, places)]
    seeds = [b for b in compact_windows._gathered(iter([rows]), apart=True) if b.column("kind")[0].as_py() == 1]
    assert [r["b_run"] >> 16 for b in seeds for r in b.to_pylist()] == [300]


def test_minhash_filters_texts_before_they_are_shuffled(spark, tmp_path):
    spark.range(200).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 40) as text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    keyed = minhash_dedup._keyed(docs)
    wanted = staged(keyed.where("doc_id < 20").selectExpr("doc_id + 1000 as doc_id", "row_key", "1L as n_rows"), "wanted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the wanted rows are many
    try:
        found = minhash_dedup._sets(docs, wanted, 4)
        assert {r["doc_id"] for r in found.collect()} == set(range(1000, 1020))
        lines = found._jdf.queryExecution().sparkPlan().toString().split("\n")
        place = next(k for k, x in enumerate(lines) if "BroadcastHashJoin" in x)
        assert not any("SortMergeJoin" in x for x in lines[place:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
