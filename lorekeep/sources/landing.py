"""Landing raw objects: format detection, delimiters, write-once keys, upserts and stale rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_format(body: Column, name: Column) -> Column:
    """A file's format from its first bytes, then from what its text looks like."""
    hexed = F.hex(F.substring(body, 1, 16))
    # Leading bytes of binary formats.
    magic = [("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("D0CF11E0A1B11AE1", "ole2"), ("53514C69746520666F726D6174203300", "sqlite"), ("FFD8FF", "jpeg"), ("89504E47", "png"), ("47494638", "gif"), ("494433", "mp3"), ("FFFB", "mp3"), ("7B5C727466", "rtf")]
    found = F.when(F.length(body) == 0, "empty")
    for lead, kind in magic:
        found = found.when(hexed.startswith(lead), kind)
    found = found.when(F.substring(hexed, 9, 8) == "66747970", "mp4")
    found = found.when(hexed.startswith("52494646") & (F.hex(F.substring(body, 9, 4)) == "57415645"), "wav")
    sample = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    control = F.length(F.regexp_replace(sample, r"[^\x00-\x08\x0E-\x1F]", ""))
    trimmed = F.ltrim(sample)
    lower = F.lower(F.substring(trimmed, 1, 512))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        found.when(control >= 0.02 * F.length(sample), "unknown")
        .when(trimmed.rlike(r"(?i)^from \S+") & sample.rlike("(?i)\n(date|from|subject):"), "mbox")
        .when(lower.startswith("begin:vcalendar"), "ics")
        .when(lower.rlike(r"^<!doctype html|<html[\s>]"), "html")
        .when(F.substring(trimmed, 1, 400).rlike("(?im)^(received|return-path|message-id|mime-version|from|date|subject|to):") & sample.rlike("\n\r?\n") & ~ext.isin("txt", "md"), "eml")
        .when(trimmed.rlike(r"^[\[{]") & (ext == "json"), "json")
        .when(ext.isin("md", "markdown"), "markdown")
        .when(ext.isin("csv", "tsv"), "csv")
        .otherwise("text")
    )


def choose_delimiter(lines: DataFrame, key: str, line: str, number: str) -> DataFrame:
    """(key, delimiter): the candidate whose most usual width over the first 50 records is most consistent."""
    tried = lines.where(F.col(number) < 50).select(key, line, F.explode(F.array(*[F.lit(d) for d in (",", "\t", ";", "|")])).alias("delimiter"))
    width = F.size(F.split(F.col(line), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))))
    counted = tried.withColumn("width", width).where("width > 1").groupBy(key, "delimiter", "width").agg(F.count("*").alias("n"))
    score = (F.col("n") * 1000 + F.col("width")).alias("score")
    return counted.select(key, "delimiter", score).groupBy(key).agg(F.max_by("delimiter", F.struct("score", "delimiter")).alias("delimiter"))


def put_if_absent(stored: DataFrame, arriving: DataFrame, key: str, digest: str) -> DataFrame:
    """arriving with its outcome: created, exists, or conflict where the key holds other bytes."""
    have = stored.select(key, F.col(digest).alias("held"))
    outcome = F.when(F.col("held").isNull(), "created").when(F.col("held") == F.col(digest), "exists").otherwise("conflict")
    return arriving.join(have, key, "left").withColumn("outcome", outcome).drop("held")


def upsert_changed(current: DataFrame, produced: DataFrame, key: str, digest: str) -> DataFrame:
    """The table after an upsert that touches only rows whose digest differs, with what became of each row."""
    c = current.select(key, F.col(digest).alias("old"))
    p = produced.select(key, F.col(digest).alias("new"))
    joined = c.join(p, key, "full_outer")
    action = F.when(F.col("new").isNull(), "stale").when(F.col("old").isNull(), "inserted").when(~F.col("old").eqNullSafe(F.col("new")), "updated").otherwise("kept")
    return joined.select(key, F.coalesce("new", "old").alias(digest), action.alias("action"))
