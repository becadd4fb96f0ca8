"""Models that are fitted on all rows, against plain versions over more rows than a bounded sample held."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import quality_rules


def test_forest_and_cut_off_come_from_all_labelled_rows(spark):
    rng = random.Random(5)
    made = [(i, " ".join(rng.choice(("so", "Long", "a1", "x!", "rain#", "tree")) for _ in range(rng.randint(50, 70)))) for i in range(7_000)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    labels = df.select("doc_id", (F.col("doc_id") % 9 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    forest, cut = quality_rules.fit(df, labels)
    held = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).select("doc_id").collect()}
    assert abs(float(forest["norm"]) - float(quality_rules._expected(np.array(sum(i % 9 > 0 and i not in held for i, _ in made))))) < 1e-9
    odd = {r["doc_id"]: r["anomaly"] for r in quality_rules.score_rules(df, labels).collect()}
    fine = np.array([odd[i] for i in held if i % 9 > 0])
    assert cut == quality_rules.calibrate(np.append(fine, 1.0), np.append(np.ones(len(fine), bool), False))
    scores = spark.createDataFrame([(float(s),) for s in fine], "score double")
    assert [quality_rules.ranked_score(scores, k) for k in (0, 700, len(fine) - 1)] == [np.sort(fine)[k] for k in (0, 700, len(fine) - 1)]
