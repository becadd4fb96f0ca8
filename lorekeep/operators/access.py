"""Access: readable lists, secured tables, reader coverage, visible variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.session import staged


def reachable(start: DataFrame, edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(root, node): what each start reaches over (child, parent) edges, itself included; cycles end by themselves.

    start has a column root. Only newly found pairs go into the next round; each round is written out.
    """
    seen = staged(start.select("root", F.col("root").alias("node")).distinct(), "reach")
    fresh = seen
    for _ in range(max_rounds):
        step = fresh.join(edges, fresh["node"] == edges["child"]).select("root", F.col("parent").alias("node")).distinct()
        fresh = staged(step.join(seen, ["root", "node"], "left_anti"), "reach")
        if fresh.isEmpty():
            return seen
        seen = seen.union(fresh)
    raise RuntimeError(f"closure did not end in {max_rounds} rounds")


def secured(df: DataFrame, acl: str, readable: DataFrame) -> DataFrame:
    """Rows without a list, and rows whose list is readable: put around the scan, before any other filter."""
    allowed = readable.select(F.col("acl_id").alias("readable_acl")).distinct()
    marked = df.join(allowed, df[acl] == allowed["readable_acl"], "left")  # one scan; the lists are distinct, so no row is doubled
    return marked.where(F.col(acl).isNull() | F.col("readable_acl").isNotNull()).drop("readable_acl")


def readable_lists(entries: DataFrame, principals: DataFrame) -> DataFrame:
    """(root, acl_id): the lists that name one of a reader's principals."""
    return principals.join(entries, principals["node"] == entries["principal"]).select("root", "acl_id").distinct()


def covers(holders: DataFrame, lists: DataFrame, principals: DataFrame) -> DataFrame:
    """(wide, narrow): lists where every principal of narrow is admitted by wide, itself or through a group.

    Counting instead of nested tests: narrow's entries that wide admits are as many as narrow's entries.
    """
    narrow = holders.select(F.col("acl_id").alias("narrow"), F.col("principal").alias("who"))
    admitted = narrow.join(principals.select(F.col("root").alias("who"), "node"), "who")
    met = admitted.join(lists.select(F.col("acl_id").alias("wide"), F.col("principal").alias("node")), "node").select("wide", "narrow", "who").distinct()
    size = holders.groupBy(F.col("acl_id").alias("narrow")).agg(F.count_distinct("principal").alias("size"))
    return met.groupBy("wide", "narrow").agg(F.count_distinct("who").alias("hits")).join(size, "narrow").where("hits = size and wide <> narrow").select("wide", "narrow")


def personal_data(files: DataFrame) -> DataFrame:
    """doc_id, kinds, masked (sorted and distinct): files whose texts hold personal data.

    SSNs, bank numbers and birth dates anywhere in a text, and a pay column beside a person column in the
    first line with bars (the header of a table).
    """
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    line = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    header = F.transform(F.split(F.get(line, F.lit(0)), r"\|"), lambda h: F.trim(h))
    pay = F.get(F.filter(header, lambda h: h.rlike(rules.PAY_COLUMN)), F.lit(0))
    beside = pay.isNotNull() & F.exists(header, lambda h: h.rlike(rules.PERSON_COLUMN))
    hits = {
        "ssn": F.transform(every(rules.SSN), lambda x: F.concat(F.substring(x, 1, 3), F.lit("-**-****"))),
        "bank_account": F.transform(every(rules.BANK_NUMBER), text.mask_digits),
        "birth_date": F.transform(every(rules.BIRTH_DATE), lambda x: F.regexp_replace(x, r"\d", "#")),
        "personal_pay": F.when(beside, F.array(F.concat(F.lit('column "'), pay, F.lit('" next to people')))).otherwise(F.array().cast("array<string>")),
    }
    tagged = lambda kind: F.transform(hits[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("masked")))
    found = files.where("text is not null").select("doc_id", F.explode(F.concat(*map(tagged, hits))).alias("hit"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("hit.kind")).alias("kinds"), F.array_sort(F.collect_set("hit.masked")).alias("masked"))
