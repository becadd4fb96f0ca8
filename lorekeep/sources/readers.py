"""Readers for raw files: mailboxes, delimited text, office packages, archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import rules


def split_mailbox(body: Column) -> Column:
    """The messages of a mailbox: each starts at a line "From ..."; ">From " inside one is unescaped."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(body, "\r\n", "\n")), r"\n(?=From \S+)")
    return F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, r"(?m)^>(>*From )", "$1"))


def mail_header(message: Column, name: str) -> Column:
    head = F.split_part(message, F.lit("\n\n"), F.lit(1))
    return F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1))


def header_row(rows: DataFrame, file: str, number: str, cells: str) -> DataFrame:
    """(file, header_at): the first of the first 30 rows that fills half the cells of the fullest one."""
    filled = rows.where(F.col(number) < 30).select(file, number, F.size(F.filter(cells, lambda c: F.trim(c) != "")).alias("filled"))
    most = filled.groupBy(file).agg(F.max("filled").alias("most"))
    return filled.join(most, file).where("filled * 2 >= most").groupBy(file).agg(F.min(number).alias("header_at"))


def summary_rows(cells: str) -> Column:
    """Whether a row is a total, an export stamp or a page mark."""
    return F.exists(cells, lambda c: F.trim(c).rlike(rules.REPORT_ROW))


def date_columns(df: DataFrame, columns: list[str], parse, share: float = 0.8) -> DataFrame:  # noqa: ANN001
    """(column, share): text columns of whose filled values at least `share` read as dates."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    found = long.where("value is not null and trim(value) <> ''").groupBy("column").agg(F.avg(parse(F.col("value")).isNotNull().cast("double")).alias("share"))
    return found.where(F.col("share") >= share)


_TAG = re.compile(r"\{.*?\}")


def office_text(body: bytes) -> str:
    """Text of a word-processing, spreadsheet or slide package, sheet by sheet; empty for other bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            names = z.namelist()
            shared: list[str] = []
            if "xl/sharedStrings.xml" in names:
                root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
                shared = ["".join(t.text or "" for t in item.iter() if _TAG.sub("", t.tag) == "t") for item in root]
            out = []
            for name in sorted(n for n in names if re.match(r"(word/document|xl/worksheets/sheet\d+|ppt/slides/slide\d+)\.xml$", n)):
                root = ElementTree.fromstring(z.read(name))
                if name.startswith("xl/"):
                    for row in (e for e in root.iter() if _TAG.sub("", e.tag) == "row"):
                        cells = []
                        for c in (e for e in row if _TAG.sub("", e.tag) == "c"):
                            value = "".join(v.text or "" for v in c.iter() if _TAG.sub("", v.tag) in ("v", "t"))
                            cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                        out.append("\t".join(cells))
                else:
                    for p in (e for e in root.iter() if _TAG.sub("", e.tag) == "p"):
                        out.append("".join(t.text or "" for t in p.iter() if _TAG.sub("", t.tag) == "t"))
            return "\n".join(x for x in out if x.strip())
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError):
        return ""


def read_office(files: DataFrame) -> DataFrame:
    """(path, text) of a binaryFile DataFrame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [office_text(bytes(b)) for b in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def unpack(files: DataFrame) -> DataFrame:
    """(path, member, content): members of archives one level down; system folders are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, body in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(body))) as z:
                        members = [i for i in z.infolist() if not i.is_dir() and "__MACOSX" not in i.filename]
                        for m in members:
                            yield pd.DataFrame({"path": [path], "member": [m.filename], "content": [z.read(m)]})
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")
