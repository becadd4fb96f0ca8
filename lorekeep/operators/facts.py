"""Facts in time: as-of filters, periods, timelines, consolidation, authority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import rules


def as_of(df: DataFrame, day: str, end: str, start_col: str = "valid_from", end_col: str = "valid_to") -> DataFrame:
    """Rows valid on a day; open ends pass. end says whether the end date is the first day after ("exclusive") or the last valid one."""
    d = F.lit(day).cast("timestamp")
    upper = F.col(end_col) > d if end == "exclusive" else F.col(end_col) >= d
    return df.where((F.col(start_col).isNull() | (F.col(start_col) <= d)) & (F.col(end_col).isNull() | upper))


def authority(predicate: Column, kind: Column) -> Column:
    """How much a kind of source counts for a predicate: the first family of predicates that fits decides."""
    table = lambda ranks: F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[kind]
    chain = None
    for pattern, ranks in rules.AUTHORITY_BY_KIND:
        chain = F.when(predicate.rlike(pattern), table(ranks)) if chain is None else chain.when(predicate.rlike(pattern), table(ranks))
    return F.coalesce(chain.otherwise(table(rules.AUTHORITY)), F.lit(0))


def timelines(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One text per subject with two dated steps or more: "A (Jul 2022 - Jun 2025) -> B (since Jul 2025)"."""
    month = lambda c: F.date_format(c, "MMM yyyy")
    period = F.when(F.col("valid_to").isNull(), F.concat(F.lit("since "), month("valid_from"))).otherwise(F.concat(month("valid_from"), F.lit(" - "), month("valid_to")))
    step = F.concat("value", F.lit(" ("), period, F.lit(")"))
    steps = facts.where("valid_from is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("valid_from", "fact_id", step.alias("text")))).alias("s"))
    return steps.where(F.size("s") >= 2).select(*keys, F.array_join(F.transform("s", lambda x: x["text"]), " -> ").alias("timeline"))


def consolidate(facts: DataFrame) -> DataFrame:
    """Dated versions of each (subject, predicate) put in order: duplicates folded, open ends closed, old values superseded.

    Folding depends on what was folded before, so the versions of one subject and predicate are walked in order, once, with the next
    version of each value and the next that stands at hand; one row per version comes back: fact_id, valid_to, status, action.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["valid_from", "fact_id"], kind="stable")
        ids, values, starts, ends, status = (pdf[c].tolist() for c in ("fact_id", "value", "valid_from", "valid_to", "status"))
        n = len(ids)
        action, left = [""] * n, list(range(n + 1))  # left: where to look for the next version that is not folded
        places: dict = {}
        for i, fact in enumerate(ids):
            places.setdefault(fact, []).append(i)
        follower, later_start, seen = [n] * n, [n] * n, {}
        for i in reversed(range(n)):
            if values[i] == values[i]:
                follower[i], seen[values[i]] = seen.get(values[i], n), i
            if i + 1 < n:
                later_start[i] = i + 1 if starts[i + 1] > starts[i] else later_start[i + 1]
        folded: set[int] = set()

        def unfolded(i: int) -> int:
            while left[i] != i:
                left[i] = left[left[i]]
                i = left[i]
            return i

        for i in range(n):
            if ids[i] in folded:
                continue
            same = follower[i]
            # starts rise: where the next version of this value begins too late, all others do
            if same < n and (pd.isna(ends[i]) or starts[same] <= ends[i]) and "superseded" in (status[i], status[same]):
                dup = i if status[i] == "superseded" else same
                if ids[dup] not in folded:
                    folded.add(ids[dup])
                    for k in places[ids[dup]]:
                        left[k] = k + 1
                    status[dup], action[dup] = "rejected", "folded"
                    if dup == i:
                        continue
            following = unfolded(later_start[i])
            if following == n or not starts[following] > starts[i]:  # rows without a start come last
                continue
            if pd.isna(ends[i]) or ends[i] > starts[following]:
                ends[i], action[i] = starts[following], "closed"
            if status[i] == "accepted" and values[i] != values[following]:
                status[i], action[i] = "superseded", (action[i] + " superseded").strip()
        return pd.DataFrame({"fact_id": ids, "valid_to": pd.Series(ends, dtype=pdf["valid_from"].dtype), "status": status, "action": action})

    return facts.groupBy("subject", "predicate").applyInPandas(walk, "fact_id long, valid_to timestamp, status string, action string")


def best_claims(claims: DataFrame) -> DataFrame:
    """The claim per subject and predicate from the source that counts most; ties go to the smallest value."""
    ranked = claims.withColumn("rank", authority(F.col("predicate"), F.col("kind")))
    order = Window.partitionBy("subject", "predicate").orderBy(F.desc("rank"), "value", "kind")
    return ranked.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
