"""Structured load of the commerce tables: two lists of companies and a third that spells their names its own way, parts, places, orders, shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.load import Graph, Link, Mapping, load_structured
from lorekeep.plans.registry import query, table

MAPPINGS = [
    Mapping("nation", "entities", "Country", "geo", "n_nationkey", "n_nationkey", "n_name"),
    Mapping("customer", "entities", "Company", "sales", "c_custkey", "c_custkey", "c_name", ("c_mktsegment",), (Link("c_nationkey", "located_in", "Country", "geo"),)),
    Mapping("supplier", "entities", "Company", "purchasing", "s_suppkey", "s_suppkey", "s_name", (), (Link("s_nationkey", "located_in", "Country", "geo"),)),
    Mapping("part", "entities", "Part", "catalogue", "p_partkey", "p_partkey", "p_name", ("p_brand", "p_type")),
    Mapping("accounts", "entities", "Company", "crm", "line", "acc_id", "acc_name"),
    Mapping("orders", "events", "Order", "sales", "o_orderkey", "o_orderkey", None, ("o_orderstatus",), (Link("o_custkey", "placed_by", "Company", "sales"), Link("o_orderpriority", "has_priority", "Priority", None, "name")), "o_orderdate", "o_totalprice"),
    Mapping("lineitem", "events", "Shipment", "sales", "l_linenumber", "l_orderkey", None, (), (Link("l_orderkey", "of", "Order", "sales"), Link("l_suppkey", "shipped_by", "Company", "purchasing"), Link("l_partkey", "contains", "Part", "catalogue")), "l_shipdate", "l_extendedprice"),
]


def source_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    tables = {m.table: table(spark, sf, m.table) for m in MAPPINGS if m.table != "accounts"}
    acc_id = F.when(F.col("c_custkey") % 10 == 3, "shared").otherwise(F.concat(F.lit("A"), "c_custkey"))
    acc_name = F.when(F.col("c_custkey") % 7 == 1, "N/A").otherwise(F.concat(F.upper("c_name"), F.lit(", Inc.")))
    tables["accounts"] = tables["customer"].where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("line"), acc_id.alias("acc_id"), acc_name.alias("acc_name"))
    return tables


def rows_of(graph: Graph) -> DataFrame:
    """The whole graph as rows: part, a, b, c, d."""
    pairs = F.sort_array(F.transform(F.map_entries("properties"), lambda p: F.concat(p["key"], F.lit("="), p["value"])))
    none = F.lit(None).cast("string").alias("d")
    return (
        graph.entities.select(F.lit("entity").alias("part"), F.col("entity").alias("a"), F.col("type").alias("b"), F.col("name").alias("c"), F.concat_ws(", ", F.col("origin"), pairs).alias("d"))
        .union(graph.identifiers.select(F.lit("identifier"), "entity", "system", "value", none))
        .union(graph.aliases.select(F.lit("alias"), "entity", "alias", none, none))
        .union(graph.links.select(F.lit("link"), "source", "relationship", "target", none))
        .union(graph.evidence.select(F.lit("evidence"), "entity", "source_table", "source_row", none))
    )


def _id(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 32)"


_COUNTRY = _id("'Country'", "'id'", "'geo'", "{}")
_SALES, _BOUGHT, _CRM = (_id("'Company'", "'id'", f"'{s}'", "{}") for s in ("sales", "purchasing", "crm"))
_PART = _id("'Part'", "'id'", "'catalogue'", "{}")
_ORDER, _SHIPMENT = _id("'Order'", "'id'", "'sales'", "{}"), _id("'Shipment'", "'id'", "'sales'", "{}")
_PRIORITY = _id("'Priority'", "'name'", "trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9 ]+', ' ', 'g'))")


@query(
    "structured_load",
    f"""WITH acc AS (SELECT c_custkey AS k, c_custkey % 10 <> 3 AS has_id, c_custkey % 7 <> 1 AS named, upper(c_name) || ', Inc.' AS spelled, c_name FROM customer WHERE c_custkey % 3 = 0),
    acc_of AS (SELECT *, CASE WHEN named THEN {_SALES.format('k')} ELSE {_CRM.format("lower('A' || k)")} END AS e FROM acc WHERE has_id OR named),
    line AS (SELECT l_orderkey AS k, count(*) AS n, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(38,6))), 2) AS DECIMAL(38,2)) AS amount, min(struct_pack(a := l_linenumber, b := CAST(l_shipdate AS VARCHAR))).b AS d FROM lineitem GROUP BY 1),
    parts AS (SELECT p_partkey, p_brand, p_type, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ' · ' || p_partkey ELSE p_name END AS name FROM part),
    new_parts AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)), new_supp AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)),
    new_orders AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), new_cust AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    SELECT 'entity' AS part, {_COUNTRY.format('n_nationkey')} AS a, 'Country' AS b, n_name AS c, 'structured, source_system=geo' AS d FROM nation
    UNION ALL SELECT 'entity', {_SALES.format('c_custkey')}, 'Company', c.c_name, concat('structured, c_mktsegment=', c_mktsegment, ', source_system=', CASE WHEN acc.named THEN 'crm' ELSE 'sales' END) FROM customer c LEFT JOIN acc ON k = c_custkey
    UNION ALL SELECT 'entity', {_BOUGHT.format('s_suppkey')}, 'Company', s_name, 'structured, source_system=purchasing' FROM supplier
    UNION ALL SELECT 'entity', {_PART.format('p_partkey')}, 'Part', name, concat('structured, p_brand=', p_brand, ', p_type=', p_type, ', source_system=catalogue') FROM parts
    UNION ALL SELECT 'entity', e, 'Company', 'A' || k, concat('structured, Description=Known only as "A', k, '" in crm, source_system=crm') FROM acc_of WHERE NOT named
    UNION ALL SELECT 'entity', {_ORDER.format('o_orderkey')}, 'Order', 'Order ' || o_orderkey, concat('event, amount=', CAST(CAST(o_totalprice AS DECIMAL(38,6)) AS DECIMAL(38,2)), ', date=', CAST(o_orderdate AS VARCHAR), ', o_orderstatus=', o_orderstatus, ', source_system=sales') FROM orders
    UNION ALL SELECT 'entity', {_SHIPMENT.format('k')}, 'Shipment', 'Shipment ' || k, concat('event, amount=', amount, ', date=', d, CASE WHEN n > 1 THEN ', lines=' || n ELSE '' END, ', source_system=sales') FROM line
    UNION ALL SELECT DISTINCT 'entity', {_PRIORITY}, 'Priority', o_orderpriority, 'link' FROM orders
    UNION ALL SELECT 'entity', {_PART.format('k')}, 'Part', CAST(k AS VARCHAR), 'link' FROM new_parts UNION ALL SELECT 'entity', {_BOUGHT.format('k')}, 'Company', CAST(k AS VARCHAR), 'link' FROM new_supp
    UNION ALL SELECT 'entity', {_ORDER.format('k')}, 'Order', CAST(k AS VARCHAR), 'link' FROM new_orders UNION ALL SELECT 'entity', {_SALES.format('k')}, 'Company', CAST(k AS VARCHAR), 'link' FROM new_cust
    UNION ALL SELECT 'identifier', {_COUNTRY.format('n_nationkey')}, 'geo', CAST(n_nationkey AS VARCHAR), NULL FROM nation
    UNION ALL SELECT 'identifier', {_SALES.format('k')}, 'sales', CAST(k AS VARCHAR), NULL FROM (SELECT c_custkey AS k FROM customer UNION SELECT k FROM new_cust)
    UNION ALL SELECT 'identifier', {_BOUGHT.format('k')}, 'purchasing', CAST(k AS VARCHAR), NULL FROM (SELECT s_suppkey AS k FROM supplier UNION SELECT k FROM new_supp)
    UNION ALL SELECT 'identifier', {_PART.format('k')}, 'catalogue', CAST(k AS VARCHAR), NULL FROM (SELECT p_partkey AS k FROM part UNION SELECT k FROM new_parts)
    UNION ALL SELECT 'identifier', e, 'crm', 'A' || k, NULL FROM acc_of WHERE has_id
    UNION ALL SELECT 'identifier', {_ORDER.format('k')}, 'sales', CAST(k AS VARCHAR), NULL FROM (SELECT o_orderkey AS k FROM orders UNION SELECT k FROM new_orders)
    UNION ALL SELECT 'identifier', {_SHIPMENT.format('k')}, 'sales', CAST(k AS VARCHAR), NULL FROM line
    UNION ALL SELECT 'alias', e, spelled, NULL, NULL FROM acc_of WHERE named
    UNION ALL SELECT 'link', {_SALES.format('c_custkey')}, 'located_in', {_COUNTRY.format('c_nationkey')}, NULL FROM customer WHERE c_nationkey <> 0
    UNION ALL SELECT 'link', {_BOUGHT.format('s_suppkey')}, 'located_in', {_COUNTRY.format('s_nationkey')}, NULL FROM supplier WHERE s_nationkey <> 0
    UNION ALL SELECT 'link', {_ORDER.format('o_orderkey')}, 'placed_by', {_SALES.format('o_custkey')}, NULL FROM orders WHERE o_custkey <> 0
    UNION ALL SELECT 'link', {_ORDER.format('o_orderkey')}, 'has_priority', {_PRIORITY}, NULL FROM orders
    UNION ALL SELECT DISTINCT 'link', {_SHIPMENT.format('l_orderkey')}, 'of', {_ORDER.format('l_orderkey')}, NULL FROM lineitem WHERE l_orderkey <> 0
    UNION ALL SELECT DISTINCT 'link', {_SHIPMENT.format('l_orderkey')}, 'shipped_by', {_BOUGHT.format('l_suppkey')}, NULL FROM lineitem WHERE l_suppkey <> 0
    UNION ALL SELECT DISTINCT 'link', {_SHIPMENT.format('l_orderkey')}, 'contains', {_PART.format('l_partkey')}, NULL FROM lineitem WHERE l_partkey <> 0
    UNION ALL SELECT 'evidence', {_COUNTRY.format('n_nationkey')}, 'nation', CAST(n_nationkey AS VARCHAR), NULL FROM nation
    UNION ALL SELECT 'evidence', {_SALES.format('c_custkey')}, 'customer', CAST(c_custkey AS VARCHAR), NULL FROM customer
    UNION ALL SELECT 'evidence', {_BOUGHT.format('s_suppkey')}, 'supplier', CAST(s_suppkey AS VARCHAR), NULL FROM supplier
    UNION ALL SELECT 'evidence', {_PART.format('p_partkey')}, 'part', CAST(p_partkey AS VARCHAR), NULL FROM part
    UNION ALL SELECT 'evidence', e, 'accounts', CAST(k AS VARCHAR), NULL FROM acc_of""",
)
def structured_load(spark: SparkSession, sf: str) -> DataFrame:
    """All tables as one graph: entities with their last properties, identifiers, aliases, links, and the rows they come from.

    A cell "0" is a placeholder by the rules and links to nothing.
    """
    return rows_of(load_structured(spark, source_tables(spark, sf), MAPPINGS))
