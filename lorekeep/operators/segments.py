"""Cutting texts, tables and transcripts into passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_windows(rows: DataFrame, file: str, order: list[str], line: Column, size: int = 12) -> DataFrame:
    """(file, n, row_start, row_end, content): windows of `size` rows in reading order."""
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1)
    cut = numbered.select(file, F.floor(F.col("r") / size).alias("n"), "r", line.alias("line"))
    grouped = cut.groupBy(file, "n").agg(F.min("r").alias("row_start"), F.max("r").alias("row_end"), F.sort_array(F.collect_list(F.struct("r", "line"))).alias("ls"))
    return grouped.select(file, "n", "row_start", "row_end", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


def greedy(pieces: Column, limit: int, glue: str) -> Column:
    """Pieces merged in order as long as they fit the limit: an array of merged pieces (a fold over one text)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + len(glue) + F.length(p) <= limit
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(glue), p))
        closed = F.array_append(acc["done"], acc["open"])
        return F.when((acc["open"] == "") | fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(closed.alias("done"), p.alias("open")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def text_passages(documents: DataFrame, limit: int = 1000) -> DataFrame:
    """(doc_id, n, content): paragraphs merged to about `limit` characters, long ones cut at sentences."""
    lines = F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > 1600, F.split(x, r"(?<=[.!?])\s+")).otherwise(F.array(x))))
    # an outer explode is not preceded by a filter that folds each text once more
    return documents.select("doc_id", F.posexplode_outer(greedy(sentences, limit, "\n")).alias("n", "content")).where("n is not null")


def transcript_windows(turns: DataFrame, limit: int = 1600) -> DataFrame:
    """(conv_id, n, content): the turns of a conversation in windows under `limit` characters."""
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("ls"))
    return ordered.select("conv_id", F.posexplode(greedy(F.transform("ls", lambda x: x["line"]), limit, "\n")).alias("n", "content"))


def overlaps(scenes: DataFrame, speech: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of a scene and a speech that overlap in time: both dealt into time buckets, joined there, made distinct."""
    span = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(b), F.col(a) + 1) / bucket))))
    joined = span(scenes, "s_start", "s_end").join(span(speech, "p_start", "p_end"), [key, "bucket"])
    met = joined.where((F.col("p_end") > F.col("s_start")) & (F.col("p_start") < F.greatest("s_end", F.col("s_start") + 1)))
    return met.drop("bucket").distinct()
