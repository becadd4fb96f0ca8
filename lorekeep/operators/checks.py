"""Guards and data checks: the read-only SQL path, typed assertions, optional filters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_LIMIT = 200


def _nodes(plan: object) -> Iterator[object]:
    """All nodes of a parsed plan, those of subqueries in expressions included."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for inner in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [inner.apply(i) for i in range(inner.size()) if hasattr(inner.apply(i), "children")]


def _refused(spark: SparkSession, statement: str, allowed: set[str]) -> str | None:
    """Why a statement may not run, judged by its parsed plan: anything but one query, or a query that reads other tables."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:  # the parser's own error, for text that is no single statement
        return f"no single statement: {str(e).splitlines()[0][:120]}"
    is_a = lambda node, name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}").isInstance(node)
    names = set(allowed)
    nodes = list(_nodes(plan))
    for node in nodes:
        if is_a(node, "Command") or is_a(node, "ParsedStatement"):
            return f"reading only: {node.nodeName()}"
        if node.nodeName() == "UnresolvedWith":
            pairs = node.cteRelations()
            names |= {pairs.apply(i)._1().lower() for i in range(pairs.size())}
    for node in nodes:
        if node.nodeName() == "UnresolvedRelation" and node.tableName().lower() not in names:
            return f"no such table: {node.tableName()}"
    if re.search(r"(?i)'(reflect|java_method|try_reflect)\(", plan.toString()):
        return "no calls into the engine"
    return None


def guarded_sql(spark: SparkSession, statement: str, views: dict[str, DataFrame]) -> DataFrame:
    """A single query over the given (secured) tables, ROW_LIMIT rows at most; no other table or file can be read, nothing can be written.

    The parsed plan is judged, not words: columns may have any name, and comments and literals hold what they like.
    """
    why = _refused(spark, statement, {name.lower() for name in views})
    if why:
        raise ValueError(why)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(statement).limit(ROW_LIMIT)  # names are resolved here, so the views may go
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def optional_filter(df: DataFrame, equals: dict[str, object], contains: dict[str, str | None] | None = None) -> DataFrame:
    """Only the conditions that are set; a missing parameter adds nothing to the plan."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    for column, part in (contains or {}).items():
        if part is not None:
            df = df.where(F.contains(F.lower(column), F.lit(part.lower())))
    return df


@dataclass
class Assertion:
    """A typed expectation: its kind and the parameters of that kind."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)


def _outcome(a: Assertion, tables: dict[str, DataFrame]) -> Column | DataFrame:
    p = a.params
    if a.kind == "entity_count":
        return tables[p["table"]].agg((F.count("*") == p["count"]).alias("passed"))
    if a.kind == "fact_value":
        rows = tables[p["table"]].where(F.col(p["key"]) == p["id"])
        return rows.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_or(F.col(p["column"]).cast("string") == str(p["value"])), F.lit(False)).alias("hit")).select((F.col("some") & F.col("hit")).alias("passed"))
    if a.kind == "relation_exists":
        return tables[p["table"]].where((F.col(p["src"]) == p["from"]) & (F.col(p["dst"]) == p["to"])).agg((F.count("*") > 0).alias("passed"))
    raise ValueError(f"unknown kind {a.kind}")


def run_assertions(assertions: list[Assertion], tables: dict[str, DataFrame]) -> DataFrame:
    """(name, kind, passed): every assertion as a small aggregation, all in one plan."""
    out = None
    for a in assertions:
        row = _outcome(a, tables).select(F.lit(a.name).alias("name"), F.lit(a.kind).alias("kind"), "passed")
        out = row if out is None else out.union(row)
    return out
