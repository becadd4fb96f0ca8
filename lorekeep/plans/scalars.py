"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import dates, text
from lorekeep.plans.registry import query, table


@query(
    "name_normalize",
    r"""WITH n AS (SELECT DISTINCT concat('The ', p_name, ' (', p_brand, ') & Co., Inc.') AS name FROM part)
    SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\(.*?\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9 ]+', ' ', 'g'),
      '\b(the|inc|llc|l l c|co|corp|corporation|company|ltd|limited|lp|llp|pllc)\b', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM n""",
)
def name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Names without punctuation and legal suffixes."""
    names = table(spark, sf, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" ("), "p_brand", F.lit(") & Co., Inc.")).alias("name")).distinct()
    return names.select("name", text.normalize_name(F.col("name")).alias("normal"))


@query(
    "phrase_normalize",
    r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat(c_name, '''s ', c_mktsegment, ' o''clock')), '[’'']s\b', '', 'g'), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM customer""",
)
def phrase_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases as the linker compares them."""
    raw = F.concat("c_name", F.lit("'s "), "c_mktsegment", F.lit(" o'clock"))
    return table(spark, sf, "customer").select("c_custkey", text.normalize_phrase(raw).alias("phrase"))


_SUBJECT = "concat(CASE turn % 4 WHEN 0 THEN 'RE: Fwd: [EXT] ' WHEN 1 THEN 'Re[2]: ' WHEN 2 THEN '[list] aw: ' ELSE '' END, substr(text, 1, 24))"


@query(
    "subject_normalize",
    rf"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(lower({_SUBJECT})), '^((\s*(re|fw|fwd|aw|wg|sv|tr)\s*(\[\d+\])?\s*:\s*)|(\s*\[[^\]]{{1,20}}\]\s*))+', ''), '\s+', ' ', 'g')) AS subject FROM conversations""",
)
def subject_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Mail subjects without reply and list prefixes."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normalize_subject(F.expr(_SUBJECT)).alias("subject"))


@query(
    "multi_value_split",
    """SELECT p_partkey, unnest(list_filter(list_transform(regexp_split_to_array(concat(p_brand, '; ', p_type, ' | N/A ; ', p_size), '\\s*[;|]\\s*|\\s*,\\s*'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('n/a', '0'))) AS value FROM part""",
)
def multi_value_split(spark: SparkSession, sf: str) -> DataFrame:
    """Values of cells that hold several, placeholders dropped."""
    cell = F.concat("p_brand", F.lit("; "), "p_type", F.lit(" | N/A ; "), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.explode(text.split_multi(F.lit("Codes"), cell)).alias("value"))


@query(
    "code_tokens",
    r"""SELECT c_custkey, list_filter(regexp_extract_all(concat(c_name, ' since 1999 quote Q-', 10000 + c_custkey), '\b([A-Za-z]*[-#]?\d[A-Za-z0-9-]{2,})\b', 1), lambda t: NOT regexp_full_match(t, '(19|20)[0-9]{2}')) AS codes FROM customer""",
)
def code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that look like document numbers; bare years are left out."""
    raw = F.concat("c_name", F.lit(" since 1999 quote Q-"), (10000 + F.col("c_custkey")).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.code_tokens(raw).alias("codes"))


@query(
    "says_value",
    """WITH p AS (SELECT doc_id, item_id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^a-z0-9]+'), lambda w: w <> '')) AS asked,
        list_filter(regexp_split_to_array(lower(d.text), '[^a-z0-9]+'), lambda w: w <> '') AS have FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id)
    SELECT doc_id, item_id, len(asked) > 0 AND len(list_filter(asked, lambda w: regexp_matches(w, '[0-9]') AND NOT list_contains(have, w))) = 0
        AND len(list_filter(asked, lambda w: list_contains(have, w))) >= 0.6 * len(asked) AS says FROM p""",
)
def says_value(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text states a value: its numbers, and most of its words."""
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("text", "value")
    return d.join(b, d["doc_id"] % 40 == b["item_id"]).select("doc_id", "item_id", text.says_value(F.col("value"), F.col("text")).alias("says"))


@query(
    "best_window",
    """WITH w AS (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 40)) AS i FROM documents),
    s AS (SELECT doc_id, i, substr(text, i, 260) AS win, len(list_filter(['the', 'that', 'with', 'der', 'une'], lambda x: contains(substr(lower(text), i, 260), x))) AS hits FROM w)
    SELECT doc_id, arg_max(win, hits * 1000000 - i) AS win FROM s GROUP BY doc_id""",
)
def best_window(spark: SparkSession, sf: str) -> DataFrame:
    """The stretch of each text with the most query words."""
    asked = F.array(*[F.lit(w) for w in ("the", "that", "with", "der", "une")])
    return table(spark, sf, "documents").select("doc_id", text.best_window(F.col("text"), asked).alias("win"))


@query(
    "pii_scan",
    r"""SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails,
      len(regexp_extract_all(text, '\+?\d[\d ()-]{7,}\d')) AS numbers, len(regexp_extract_all(text, '(?i)(token|key|secret|password)\s*[:=]\s*[''"]?[A-Za-z0-9_./+-]{8,}')) AS secrets,
      len(regexp_extract_all(text, '(?i)\b(routing|aba|account)\s*(number|no\.?|#)?\s*[:#]?\s*\d{6,17}\b')) AS banks FROM documents) WHERE emails + numbers + secrets + banks > 0""",
)
def pii_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data and secrets by kind; a cheap filter goes before the exact patterns."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"[@\d]|(?i)(token|key|secret|password)"))
    found = d.select(
        "doc_id",
        F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).cast("long").alias("emails"),
        F.regexp_count("text", F.lit(r"\+?\d[\d ()-]{7,}\d")).cast("long").alias("numbers"),
        F.regexp_count("text", F.lit("(?i)(token|key|secret|password)\\s*[:=]\\s*['\"]?[A-Za-z0-9_./+-]{8,}")).cast("long").alias("secrets"),
        F.regexp_count("text", F.lit(rules.BANK_NUMBER)).cast("long").alias("banks"),
    )
    return found.where("emails + numbers + secrets + banks > 0")


@query("digits_masked", "SELECT c_custkey, concat('acct ', repeat('*', length(CAST(100000000 + c_custkey AS VARCHAR)) - 4), right(CAST(100000000 + c_custkey AS VARCHAR), 4)) AS masked FROM customer")
def digits_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with all but their last four digits hidden."""
    return table(spark, sf, "customer").select("c_custkey", text.mask_digits(F.concat(F.lit("acct "), (100000000 + F.col("c_custkey")).cast("string"))).alias("masked"))


@query("money_parse", "SELECT o_orderkey, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS bad FROM orders")
def money_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts written with currency signs and separators; anything else is null."""
    written = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return table(spark, sf, "orders").select("o_orderkey", text.money(written).alias("amount"), text.money(F.lit("n/a")).alias("bad"))


@query(
    "field_labels",
    """SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'PM agreement term' WHEN 1 THEN 'Named QC program manager' WHEN 2 THEN 'Invoice PO id' ELSE 'Unit' END AS label FROM part WHERE p_size % 4 <> 2
    UNION SELECT 'Invoice PO ID' FROM part WHERE p_size % 4 = 2""",
)
def field_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Stored field names as labels."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("pm_agreement_term", "named qc program manager", "invoice_po_id", "unit")]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(text.field_label(name).alias("label")).distinct()


@query("clock_format", "SELECT event_id, CASE WHEN event_id >= 3600 THEN printf('%d:%02d:%02d', event_id // 3600, (event_id // 60) % 60, event_id % 60) ELSE printf('%d:%02d', event_id // 60, event_id % 60) END AS at FROM events")
def clock_format(spark: SparkSession, sf: str) -> DataFrame:
    """Media offsets as h:mm:ss."""
    return table(spark, sf, "events").select("event_id", text.clock(F.col("event_id") * 1000).alias("at"))


@query(
    "loose_dates",
    """WITH s AS (SELECT o_orderkey, o_orderdate, o_orderkey % 4 AS kind FROM orders)
    SELECT o_orderkey, CASE WHEN kind = 3 THEN NULL WHEN kind = 1 AND year(o_orderdate) < 2000 THEN CAST(o_orderdate + INTERVAL 100 YEAR AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day FROM s""",
)
def loose_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates in several spellings; two-digit years count from 2000."""
    kind = F.col("o_orderkey") % 4
    written = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).when(kind == 1, F.date_format("o_orderdate", "M/d/yy")).when(kind == 2, F.date_format("o_orderdate", "MMM d, yyyy")).otherwise("soon")
    )
    day = dates.loose_date(written)
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"))


@query("human_periods", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(strftime(ts, '%b %-d, %Y'), ' to ', strftime(ts + INTERVAL 40 DAY, '%b %-d, %Y')) WHEN event_id % 3 = 1 THEN concat('since ', strftime(ts, '%b %-d, %Y')) ELSE concat('until ', strftime(ts + INTERVAL 40 DAY, '%b %-d, %Y')) END AS period FROM events""")
def human_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Periods in words."""
    day = F.to_date("ts")
    kind = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", dates.human_period(F.when(kind < 2, day), F.when(kind != 1, F.date_add(day, 40))).alias("period"))


# Questions and how they read on 2026-10-05.
TIME_CASES = [
    ("what was the rate in 2023?", "as_of", "2023-07-01"),
    ("what were terms as of march 2025", "as_of", "2025-03-15"),
    ("who managed it before june 2024?", "as_of", "2024-05-31"),
    ("price after jan 2022", "as_of", "2022-01-31"),
    ("on 2024-02-10 who was the owner", "as_of", "2024-02-10"),
    ("before 2024-02-10 who was the owner", "as_of", "2024-02-09"),
    ("what is the current rate", "current", "2026-10-05"),
    ("last year revenue", "as_of", "2025-07-01"),
    ("this year revenue", "current", "2026-10-05"),
    ("last month invoices", "as_of", "2026-09-15"),
    ("what did we pay two years ago", "as_of", "2024-07-01"),
    ("how has the fee changed", "change", None),
    ("how did it evolve since 2020", "change", "2020-12-31"),
    ("how has it changed since 2020", "change", "2020-12-31"),
    ("who handled it before the sale closed?", "as_of", None),
    ("who handles it now after tom left?", "current", None),
    ("what is the warranty policy", "none", None),
    ("until 2021 what applied", "as_of", "2020-12-31"),
    ("as of 2026", "as_of", "2026-10-05"),
]
_cases = ", ".join("('" + q.replace("'", "''") + f"', '{m}', " + (f"DATE '{d}'" if d else "CAST(NULL AS DATE)") + ")" for q, m, d in TIME_CASES)


@query("time_intent", f"SELECT * FROM (VALUES {_cases}) AS t(question, mode, as_of)")
def time_intent(spark: SparkSession, sf: str) -> DataFrame:
    """What point in time a question asks for."""
    asked = spark.createDataFrame([(q,) for q, _, _ in TIME_CASES], "question string")
    read = asked.select("question", dates.time_intent(F.col("question"), F.lit("2026-10-05").cast("date")).alias("t"))
    return read.select("question", "t.mode", "t.as_of")


@query("retry_backoff", "SELECT DISTINCT CAST(p_size AS INT) AS attempts, CAST(least(600, 5 * pow(2, p_size)) AS DOUBLE) AS seconds FROM part")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds to wait after so many attempts."""
    return table(spark, sf, "part").select(F.col("p_size").alias("attempts"), F.least(F.lit(600.0), 5 * F.pow(F.lit(2.0), "p_size")).alias("seconds")).distinct()


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Digests that tell contents apart."""
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("vector_dot", "SELECT a.vec_id AS a, b.vec_id AS b, round(CAST(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DOUBLE), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_dot(spark: SparkSession, sf: str) -> DataFrame:
    """Inner products of neighbours in id order."""
    e = table(spark, sf, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    dot = F.aggregate(F.zip_with("embedding", "eb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.join(b, F.col("b") == F.col("vec_id") + 1).select(F.col("vec_id").alias("a"), "b", F.round(dot, 5).alias("dot"))
