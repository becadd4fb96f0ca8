from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lorekeep.operators import aliases
from lorekeep.sources import readers


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_text(spark):
    sheet = '<w xmlns="u"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></w>'
    book = package({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<s xmlns="u"><si><t>Name</t></si></s>'})
    letter = package({"word/document.xml": '<d xmlns="u"><p><r><t>Dear </t><t>you</t></r></p></d>'})
    files = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(letter)), ("c", bytearray(b"no zip"))], "path string, content binary")
    assert {r["path"]: r["text"] for r in readers.read_office(files).collect()} == {"a": "Name\t7", "b": "Dear you", "c": ""}


def test_unpack(spark):
    files = spark.createDataFrame([("a", bytearray(package({"x.txt": "1", "__MACOSX/x": "2"})))], "path string, content binary")
    assert [(r["member"], bytes(r["content"])) for r in readers.unpack(files).collect()] == [("x.txt", b"1")]


def test_mailbox(spark):
    box = "From a Mon\nFrom: a@x\n\nhi\n>From there\nFrom b Tue\nFrom: b@x\n\nyo\n"
    parts = spark.range(1).select(F.explode(readers.split_mailbox(F.lit(box))).alias("m")).select("m", readers.mail_header(F.col("m"), "From").alias("f")).collect()
    assert [r["f"] for r in parts] == ["a@x", "b@x"] and "\nFrom there" in parts[0]["m"]


def test_initialisms(spark):
    known = spark.createDataFrame([(1, "Big Blue Tank"), (2, "Other")], "entity long, name string")
    passages = spark.createDataFrame([(1, "the BBT leaks"), (2, "BBT again")], "passage long, text string")
    assert [tuple(r) for r in aliases.initialisms(passages, known).collect()] == [(1, "BBT", 2)]
