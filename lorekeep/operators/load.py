"""Structured load: mapped tables become entities, identifiers, aliases, links and evidence.

Tables are taken in dependency order: lists before events, lists with ids of their own first. Each is resolved as a
whole against what is known so far (two keyed lookups, by identifier and by name), its new things are keyed, named
and added, and then its links are resolved the same way; what a link names and nobody knows becomes an entity too.
What is known is a set of projections of tables that each step writes once, so that plans stay short and nothing of the
data reaches the driver. Rows of events are grouped and linked by their keys as they are stored; what a cell names is looked
up once a distinct cell, and digests are made where rows leave, so that none is shuffled for a row. Ids are digests of what a thing is known by (its id in a system, else its name, else its
row), so that a load on top of an earlier one finds the same things and changes nothing.

Defined results: cells are trimmed, null counts as empty; a row without a name and an id is skipped; an id that rows of one
table give to different names identifies none of them, and an id that two entities use finds neither; rows of one name
but several rows are told apart by their id, link or row; names, properties and quotes are whole, however long; an empty table adds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.session import staged


@dataclass(frozen=True)
class Link:
    """A column whose values name other things; system None: an id of any system."""

    column: str
    relationship: str
    target_type: str
    system: str | None = None
    match: str = "id"


@dataclass(frozen=True)
class Mapping:
    """How the rows of a table become things: kind "entities" (a thing a row) or "events" (rows grouped by id_column).

    row_column orders the rows and names them; in lists it must be unique.
    """

    table: str
    kind: str
    type: str
    system: str
    row_column: str
    id_column: str | None = None
    name_column: str | None = None
    property_columns: tuple[str, ...] = ()
    links: tuple[Link, ...] = ()
    date_column: str | None = None
    amount_column: str | None = None


class Graph(NamedTuple):
    """What a load gives."""

    entities: DataFrame  # entity, type, name, origin, properties
    identifiers: DataFrame  # entity, system, value
    aliases: DataFrame  # entity, alias
    links: DataFrame  # relationship, source, target
    evidence: DataFrame  # entity, source_table, source_row, quote


_PARTS = {
    # a line per mention of an entity: its order decides which one names it, and which property is the last
    "mentions": "entity string, type string, step int, ord string, name string, origin string, properties map<string,string>",
    "ids": "type string, system string, value string, entity string",
    "names": "type string, norm string, entity string, step int, ord string",
    "identifiers": "entity string, system string, value string",
    "aliases": "entity string, alias string",
    "links": "relationship string, source string, target string",
    "evidence": "entity string, source_table string, source_row string, quote string",
}


def name_fits(a: Column, b: Column, person: bool = False) -> Column:
    """Could two normal names be of one thing? The same first word, or one's letters in order in the other; people by surname and first initial."""
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    last = lambda c: F.split_part(c, F.lit(" "), F.lit(-1))
    fits = ((F.length(first(a)) >= 2) & (first(a) == first(b))) | text.in_order(a, b) | text.in_order(b, a)
    return fits | (a.contains(" ") & (last(a) == last(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))) if person else fits


def strong_system(column: str) -> str | None:
    """The identifier system of a column whose values mean the same thing everywhere (a serial number)."""
    return next((system for pattern, system in rules.STRONG_ID_COLUMNS if re.search(pattern, column, re.I)), None)


UNIVERSAL = ["Email", "Initials", *(system for _, system in rules.STRONG_ID_COLUMNS)]


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _entity(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, 32)


def _or_row(key: Column, row: str = "row") -> Column:
    """The key, or one of the row's own where it is empty: empty keys must not meet in one task."""
    return F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(F.concat(F.lit("\x1e"), F.col(row)))


#: Targets of a link that are sent to all tasks; more are joined by a shuffle.
SENT_TARGETS = 400_000


class _Known:
    """The parts collected so far, each a list of tables that cost one pass over what a step wrote."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.parts: dict[str, list[tuple[str | None, DataFrame, bool]]] = {name: [] for name in _PARTS}

    def add(self, part: str, rows: DataFrame, kind: str | None = None, once: bool = False) -> None:
        """Add rows of one kind (their type, or relationship), or of any; once: no key occurs in two of them."""
        names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", _PARTS[part]).split(",")]
        self.parts[part].append((kind, rows.select(*names), once))

    def of(self, part: str, kind: str | None) -> list[DataFrame]:
        """The tables that may hold rows of a kind."""
        return [df for own, df, _ in self.parts[part] if kind is None or own is None or own == kind]

    def once(self, part: str, kind: str | None) -> bool:
        """Whether the rows of a kind are in one table that holds no key twice."""
        return kind is not None and [once for own, _, once in self.parts[part] if own is None or own == kind] == [True]

    def kinds(self, part: str) -> list[str | None]:
        return list(dict.fromkeys(kind for kind, _, _ in self.parts[part]))

    def all(self, part: str, kind: str | None = None) -> DataFrame:
        found = self.of(part, kind)
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], _PARTS[part])

    def distinct(self, part: str) -> DataFrame:
        """All rows of a part once: kind by kind, where each table has one."""
        kinds = self.kinds(part)
        if None in kinds or not kinds:
            return self.all(part).distinct()
        return reduce(DataFrame.union, [self.all(part, k) if self.once(part, k) else self.all(part, k).distinct() for k in kinds])

    def by_id(self, kind: str, system: str | None) -> DataFrame:
        """(value, by_id): ids of a type in a system, else in the universal ones; without a system in any."""
        mine = self.all("ids", kind).where(F.col("type") == kind)
        own = F.lit(True) if system is None else F.col("system") == system
        everywhere = F.col("system").isin(UNIVERSAL)
        if self.once("ids", kind):
            return mine.where(own | everywhere).select("value", F.col("entity").alias("by_id"))

        def one(of: Column) -> Column:
            entity = F.when(of, F.col("entity"))
            return F.when(F.min(entity) == F.max(entity), F.min(entity))

        return mine.where(own | everywhere).groupBy("value").agg(_either(one(own), F.count_if(own) > 0, one(everywhere)).alias("by_id")).where("by_id is not null")

    def by_name(self, kind: str) -> DataFrame:
        """(norm, by_name): the first entity of a type with that normal name."""
        return self.all("names", kind).where(F.col("type") == kind).groupBy("norm").agg(F.min_by("entity", F.struct("step", "ord", "entity")).alias("by_name"))


def _either(own: Column, has_own: Column, everywhere: Column) -> Column:
    """An id that is ambiguous in its own system may still be known everywhere."""
    return F.when(has_own & own.isNotNull(), own).otherwise(everywhere)


def _find(rows: DataFrame, value: str, kind: str, system: str | None, match: str, known: _Known, out: str, norm: str | None = None) -> DataFrame:
    """rows with the entity that a value names: by id or by name first, as the match says. rows have a column row; norm: one with the value's normal name."""
    return _search(rows, value, kind, system, match, known, out, norm)[0]


def _search(rows: DataFrame, value: str, kind: str, system: str | None, match: str, known: _Known, out: str, norm: str | None = None) -> tuple[DataFrame, bool]:
    """The rows of _find, and whether they are read from a written table."""
    found, written = rows, False
    order = ("by_id", "by_name") if match == "id" else ("by_name", "by_id")
    for column in order:
        part = "ids" if column == "by_id" else "names"
        if not known.of(part, kind):
            found = found.withColumn(column, F.lit(None).cast("string"))
            continue
        if part == "names" and match == "id" and known.of("ids", kind):  # names are looked up only if an id is left
            found = staged(found, "load-found")
            if found.where(F.col("by_id").isNull() & (F.col(value) != "")).isEmpty():
                found, written = found.withColumn(column, F.lit(None).cast("string")), True
                continue
        key = _key(F.col(value)) if part == "ids" else F.col(norm) if norm else text.normalize_name(F.col(value))
        table = known.by_id(kind, system).withColumnRenamed("value", "_key") if part == "ids" else known.by_name(kind).withColumnRenamed("norm", "_key")
        found = found.withColumn("_key", _or_row(key)).join(table, "_key", "left").drop("_key")
    return found.withColumn(out, F.when(F.col(value) != "", F.coalesce(*order))).drop("by_id", "by_name"), written


def _fitting(rows: DataFrame, entity: str, norm: str, kind: str, known: _Known) -> DataFrame:
    """rows with `fits`: whether a normal name could be the entity's; one without known names takes any."""
    if not known.of("names", kind):
        return rows.withColumn("fits", F.lit(True))
    names = known.all("names", kind).where(F.col("type") == kind).select(F.col("entity").alias(entity), F.col("norm").alias("_known")).distinct()
    asked = rows.where(F.col(entity).isNotNull()).select("row", entity, F.col(norm).alias("_asked"))
    judged = asked.join(names, entity).groupBy("row").agg(F.bool_or((F.col("_asked") == "") | name_fits(F.col("_asked"), F.col("_known"), kind == "Person")).alias("fits"))
    return rows.join(judged, "row", "left").withColumn("fits", F.coalesce("fits", F.lit(True)))


def _cells(df: DataFrame, m: Mapping) -> DataFrame:
    """row, ord, quote and the columns that the mapping names as trimmed strings."""
    used = {c for c in (m.id_column, m.name_column, m.date_column, m.amount_column) if c} | set(m.property_columns) | {link.column for link in m.links}
    used |= {c for c in df.columns if _first_or_last(c)} | {c for link in m.links if (c := _sibling(df.columns, link))}
    row = F.col(f"`{m.row_column}`")
    quote = F.array_join(F.array(*map(_text, df.columns)), " | ")
    named = [_text(c).alias(f"c_{c}") for c in sorted(used)]
    return df.select(row.cast("string").alias("row"), _ord(row, _whole(df, m.row_column)).alias("ord"), quote.alias("quote"), *named)


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))


def _whole(df: DataFrame, column: str | None) -> bool:
    return column is not None and isinstance(df.schema[column].dataType, T.IntegralType)


def _ord(row: Column, whole: bool) -> Column:
    return F.lpad(row.cast("string"), 20, "0") if whole else row.cast("string")


def _banner(df: DataFrame) -> Column:
    """A report's footer or banner; numbers and dates are none."""
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    first = [c for c in df.columns[:3] if not isinstance(df.schema[c].dataType, plain)]
    return F.exists(F.array(*map(_text, first)), lambda c: c.rlike(rules.REPORT_ROW)) if first else F.lit(False)


def _first_or_last(column: str) -> str | None:
    found = re.fullmatch(r"(first|last) ?name", column, re.I)
    return found[1].lower() if found else None


def _sibling(columns: list[str], link: Link) -> str | None:
    """The column beside an id that is called as the target's type: it holds its name."""
    if link.match != "id":
        return None
    pattern = re.escape(link.target_type.split(" ")[0]) + "( name)?"
    return next((c for c in columns if c != link.column and re.fullmatch(pattern, c, re.I)), None)


def _col(name: str | None) -> Column:
    return F.col(f"`c_{name}`") if name else F.lit("")


def _properties(columns: tuple[str, ...], more: dict[str, Column]) -> Column:
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {**more, **{c: _col(c) for c in columns}}.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def _grouped(rows: DataFrame, by_id: Column, by_name: Column) -> DataFrame:
    """rows with `same`: a key that rows of one thing share, those of one id and those of one name (either may be empty)."""
    keyed = rows.withColumn("_i", _or_row(by_id)).withColumn("_n", F.when(by_name != "", by_name))
    of_id = keyed.groupBy("_i").agg(F.min("_n").alias("_of_id"))
    return keyed.join(of_id, "_i").withColumn("same", F.coalesce(F.concat(F.lit("n\x1f"), F.coalesce("_n", "_of_id")), F.concat(F.lit("i\x1f"), "_i"))).drop("_i", "_n", "_of_id")


class _Source(NamedTuple):
    """Rows that hold links: the columns by tell what they are of, entity is the entity that those make, ord orders them."""

    rows: DataFrame
    by: list[str]
    entity: Column
    whole: bool  # ord is a number


def _load_list(df: DataFrame, m: Mapping, step: int, known: _Known) -> _Source:
    """The rows of a list with their entities; new entities, ids, aliases and evidence are added."""
    rows = _cells(df, m)
    raw, ext = _col(m.name_column), _col(m.id_column)
    named = F.when(raw.rlike("(?i)[a-z0-9]") & ~raw.rlike(rules.PLACEHOLDER), raw).otherwise("")
    parts = {p: c for c in df.columns if (p := _first_or_last(c))}
    if len(parts) == 2:
        whole = F.trim(F.concat_ws(" ", _col(parts["first"]), _col(parts["last"])))
        named = F.when(((named == "") | named.contains("@")) & (whole != ""), whole).otherwise(named)
    rows = rows.withColumn("raw", raw).withColumn("name", named).withColumn("own_id", ext)
    # an id that rows give to different names identifies none of them
    shared = rows.where("own_id <> '' and raw <> ''").groupBy("own_id").agg(F.count_distinct("raw").alias("n")).where("n > 1").select(F.col("own_id").alias("_own"), F.lit(True).alias("shared"))
    rows = rows.withColumn("_own", _or_row(F.col("own_id"))).join(shared, "_own", "left").withColumn("ext", F.when(F.col("shared"), "").otherwise(F.col("own_id"))).drop("_own", "shared", "own_id")
    counts = rows.where("raw <> ''").groupBy(F.col("raw").alias("_raw")).agg(F.count("*").alias("n"))
    unnamed = df.where(_text(m.name_column) == "").count() if m.name_column else df.count()
    rows = rows.withColumn("_raw", _or_row(F.col("raw"))).join(counts, "_raw", "left").withColumn("n", F.coalesce("n", F.lit(unnamed))).drop("_raw")
    rows = rows.where("name <> '' or ext <> ''")
    telling = [c for c in m.property_columns if re.search("type|description|make|manufacturer|model", c, re.I)]
    told = F.array_join(F.slice(F.filter(F.array(*map(_col, telling)) if telling else F.array().cast("array<string>"), lambda c: c != ""), 1, 2), " ")
    rows = rows.withColumn("name", F.when(F.col("name") == "", told).otherwise(F.col("name")))
    beside = F.coalesce(*[F.when(c != "", c) for c in (F.col("ext"), *(_col(link.column) for link in m.links))], F.concat(F.lit("row "), "row"))
    rows = rows.withColumn("name", F.when((F.col("name") != "") & (F.col("n") > 1), F.concat("name", F.lit(" · "), beside)).otherwise(F.col("name")))
    rows = staged(rows.withColumn("norm", text.normalize_name(F.col("name"))), "load-list")

    for c, of in (("alone", "name"), ("alone_norm", "norm")):
        rows = rows.withColumn(c, F.when(F.col("n") == 1, F.col(of)).otherwise(""))
    rows = _find(rows, "ext", m.type, m.system, "id", known, "e_id")
    rows = _find(rows, "alone", m.type, None, "name", known, "e_name", "alone_norm")
    rows = rows.withColumn("entity", F.coalesce("e_id", "e_name"))
    rows = _fitting(rows, "entity", "norm", m.type, known).withColumn("entity", F.when(F.col("fits"), F.col("entity"))).drop("fits")
    rows = _fitting(rows, "e_name", "norm", m.type, known).withColumn("entity", F.coalesce("entity", F.when(F.col("fits"), F.col("e_name")))).drop("fits", "e_id", "e_name")
    rows = _grouped(rows, _key(F.col("ext")), F.col("alone_norm"))
    heads = rows.groupBy("same").agg(F.min_by("entity", F.when(F.col("entity").isNotNull(), F.col("ord"))).alias("met"), F.min_by(F.struct("ext", "norm", "row"), F.struct(F.col("name") == "", "ord")).alias("head"))
    named_by = F.when(F.startswith(F.col("same"), F.lit("n\x1f")), F.col("head.norm"))
    fresh = F.when(F.col("head.ext") != "", _entity(m.type, "id", m.system, _key(F.col("head.ext")))).when(named_by.isNotNull(), _entity(m.type, "name", named_by)).otherwise(_entity(m.type, "row", m.table, F.col("head.row")))
    rows = rows.join(heads.select("same", "met", fresh.alias("fresh")), "same")
    rows = staged(rows.withColumn("entity", F.coalesce("entity", "met", "fresh")), "load-list")

    only_id = (F.col("name") == "") & (F.col("ext") != "")
    note = F.when(only_id, F.concat(F.lit('Known only as "'), "ext", F.lit(f'" in {m.system}')))
    stated = {"source_system": F.lit(m.system)} | ({} if "Description" in m.property_columns else {"Description": note})
    said = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("ext"))
    base = [F.lit(m.type).alias("type"), F.lit(step).alias("step"), "ord"]
    new = rows
    if known.of("mentions", m.type):
        bare = known.all("mentions", m.type).groupBy("entity").agg(F.bool_and(F.col("origin") == "link").alias("bare"))
        new = rows.join(bare, "entity", "left").where(F.coalesce("bare", F.lit(True)))
    new = new.select("entity", *base, F.when(F.col("name") != "", F.col("norm")).otherwise(text.normalize_name(F.col("ext"))).alias("norm")).where("norm <> ''")
    known.add("names", staged(new, "load-names"), m.type)
    known.add("aliases", rows.where("name <> ''").select("entity", F.col("name").alias("alias")), m.type)
    ids = [F.struct(F.lit(m.system).alias("system"), F.col("ext").alias("value"))]
    ids += [F.struct(F.lit(system).alias("system"), _col(c).alias("value")) for c in m.property_columns if (system := strong_system(c))]
    held = rows.select("entity", F.inline(F.array(*ids))).where("value <> ''")
    known.add("identifiers", held, m.type)
    known.add("ids", held.select("entity", F.lit(m.type).alias("type"), "system", _key(F.col("value")).alias("value")), m.type)
    known.add("evidence", rows.select("entity", F.lit(m.table).alias("source_table"), F.col("row").alias("source_row"), "quote"))
    known.add("mentions", rows.select("entity", *base, said.alias("name"), F.lit("structured").alias("origin"), _properties(m.property_columns, stated).alias("properties")), m.type)
    return _Source(rows, ["entity"], F.col("entity"), False)


def _load_events(df: DataFrame, m: Mapping, step: int, known: _Known) -> tuple[_Source, _Source]:
    """The rows of an event table with their events, which are the groups of rows of one id, and the events themselves."""
    # cells stay as they are stored where that orders and tells them apart as their text does
    whole, whole_id = _whole(df, m.row_column), _whole(df, m.id_column)
    row = F.col(f"`{m.row_column}`") if whole else F.col(f"`{m.row_column}`").cast("string")
    ext = F.col(f"`{m.id_column}`") if whole_id else F.nullif(_text(m.id_column), F.lit("")) if m.id_column else F.lit(None).cast("string")
    rows = df.where(~_banner(df)).withColumns({"_ext": ext, "_row": F.when(ext.isNull(), row), "_ord": row})
    said = list(dict.fromkeys([*m.property_columns, *([m.date_column] if m.date_column else [])]))
    timed = [c for c in said if isinstance(df.schema[c].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    first = F.min(F.struct("_ord", *[(F.col(f"`{c}`") if c in timed else _text(c)).alias(f"c_{c}") for c in said]))
    events = rows.groupBy("_ext", "_row").agg(first.alias("first"), F.count("*").alias("lines"), F.sum(_amount(df, m.amount_column).cast("decimal(38,6)")).alias("amount"))
    cells = [F.trim(F.coalesce(F.col(f"first.`c_{c}`").cast("string"), F.lit(""))).alias(f"c_{c}") for c in said]
    events = events.select("_ext", "_row", F.col("first._ord").alias("_ord"), *cells, "lines", "amount")
    own, text_row = F.coalesce(F.col("_ext").cast("string"), F.lit("")), F.col("_ord").cast("string")
    # the entity of a key: rows of one id are one event, whatever the case of its letters
    fresh = F.when(F.col("_ext").isNotNull(), _entity(m.type, "id", m.system, _key(F.col("_ext").cast("string")))).otherwise(_entity(m.type, "row", m.table, F.col("_row").cast("string")))
    known_before = bool(known.of("ids", m.type) or known.of("names", m.type))
    if known_before:
        events = _find(events.withColumn("ext", own).withColumn("row", text_row), "ext", m.type, m.system, "id", known, "met").drop("ext", "row")
    events = staged(events, "load-events")
    met = F.col("met") if known_before else F.lit(None).cast("string")
    found = events.select("*", own.alias("ext"), _ord(F.col("_ord"), whole).alias("ord"), (F.coalesce(met, fresh) if known_before else fresh).alias("entity"))
    once = not known_before and whole_id
    stated = {"source_system": F.lit(m.system), "date": _col(m.date_column), "lines": F.when(F.col("lines") > 1, F.col("lines"))}
    if m.amount_column:
        stated["amount"] = F.round("amount", 2).cast("decimal(38,2)")
    name = F.trim(F.concat(F.lit(m.type + " "), F.when(F.col("ext") != "", F.col("ext")).otherwise(_col(m.date_column))))
    base = [F.lit(m.type).alias("type"), F.lit(step).alias("step"), "ord"]
    known.add("mentions", found.select("entity", *base, name.alias("name"), F.lit("event").alias("origin"), _properties(m.property_columns, stated).alias("properties")), m.type, once)
    known.add("names", found.where(met.isNull()).select("entity", *base, text.normalize_name(name).alias("norm")).where("norm <> ''"), m.type)
    held = found.where("ext <> ''").select("entity", F.lit(m.type).alias("type"), F.lit(m.system).alias("system"), F.col("ext").alias("value"))
    known.add("identifiers", held, m.type, once)
    known.add("ids", held.withColumn("value", _key(F.col("value"))), m.type, once)
    if not known_before:
        # a row's event is the digest of its own key
        key = F.lower("_ext") if not whole_id else F.col("_ext")
        return _Source(rows.withColumn("_ext", key), ["_ext", "_row"], fresh, whole), _Source(found.withColumn("_ext", key), ["_ext", "_row"], fresh, whole)
    earlier = found.select(F.col("_ext").alias("_e"), F.col("_row").alias("_r"), "entity")
    of_rows = rows.join(earlier, F.col("_ext").eqNullSafe(F.col("_e")) & F.col("_row").eqNullSafe(F.col("_r"))).drop("_e", "_r")
    return _Source(of_rows, ["entity"], F.col("entity"), whole), _Source(found, ["entity"], F.col("entity"), whole)


def _amount(df: DataFrame, column: str | None) -> Column:
    if column is None:
        return F.lit(0.0)
    plain = isinstance(df.schema[column].dataType, T.DoubleType | T.IntegralType)  # reading the text again gives the same number
    return F.coalesce(F.col(f"`{column}`").cast("double") if plain else text.money(_text(column)), F.lit(0.0))


def _asked(df: DataFrame, m: Mapping, link: Link, of: _Source, beside: str | None) -> DataFrame:
    """The source's rows that have a cell of the link: by, ord, cell, and beside where a column has the name beside it."""
    if m.kind != "events":
        rows = of.rows.select(*of.by, "ord", _col(link.column).alias("cell"), *([_col(beside).alias("beside")] if beside else []))
    else:
        cell = F.col(f"`{link.column}`") if _whole(df, link.column) else F.nullif(_text(link.column), F.lit(""))
        rows = of.rows.select(*of.by, F.col("_ord").alias("ord"), cell.alias("cell"), *([_text(beside).alias("beside")] if beside else []))
    return rows.where("cell is not null" if m.kind == "events" else "cell <> ''")


def _load_link(df: DataFrame, m: Mapping, link: Link, step: int, of: _Source, events: _Source | None, known: _Known) -> None:
    """Links of one column; targets that nobody knows are added with the name beside them, else by their value."""
    beside = _sibling(df.columns, link)
    cells = ["cell", "beside"] if beside else ["cell"]
    if events is not None and link.column == m.id_column and not beside:  # all rows of an event say the same
        asked = events.rows.where("ext <> ''").select(*events.by, F.col("_ord").alias("ord"), F.col("_ext" if _whole(df, m.id_column) else "ext").alias("cell"))
    else:
        asked = _asked(df, m, link, of, beside)
    # one lookup a distinct cell and name beside it, however often they occur
    several = text.split_multi(F.lit(link.column), F.col("cell").cast("string"))
    values = asked.select(*cells).distinct().select(*cells, F.explode(several).alias("value")).withColumn("row", F.col("value"))
    found, written = _search(values, "value", link.target_type, link.system, link.match, known, "target")
    if beside:
        found = _find(found, "beside", link.target_type, None, "name", known, "named")
        found = found.withColumn("target", F.coalesce("target", "named")).drop("named")
    found = found.select(*cells, "value", "target")
    found = found if written and not beside else staged(found, "load-targets")
    targets = found
    if not found.where("target is null").isEmpty():
        named = _make_missing(found, asked, cells, several, link, step, of.whole, known)
        met = F.coalesce("target", "made")
        targets = staged(found.join(named, ["value", *cells[1:]], "left").select(*cells, met.alias("target")), "load-targets")
    # digests of targets are told apart by a shorter one: two cells of one target may give a link twice
    n, kinds = targets.agg(F.count("*"), F.count_distinct(F.xxhash64("target"))).first()
    targets = targets.select(*cells, "target")
    linked = asked.select(*of.by, *cells).distinct().join(F.broadcast(targets) if n <= SENT_TARGETS else targets, cells)
    links = linked.select(F.lit(link.relationship).alias("relationship"), of.entity.alias("source"), "target")
    links = links.where("target <> source") if link.target_type == m.type else links  # entities of two types are two
    known.add("links", links if n == kinds else links.distinct(), link.relationship, True)


def _make_missing(found: DataFrame, asked: DataFrame, cells: list[str], several: Column, link: Link, step: int, whole: bool, known: _Known) -> DataFrame:
    """(value, made), and beside where the cells have it: the entities that are added for values that nobody knows."""
    beside = F.col("beside") if len(cells) > 1 else F.lit("")
    keys = ["value", *cells[1:]]
    firsts = asked.groupBy(*cells).agg(F.min("ord").alias("ord"))
    firsts = firsts.join(found.where("target is null").select(*cells).distinct(), cells).select(*cells, _ord(F.col("ord"), whole).alias("ord"), F.posexplode(several).alias("nth", "value"))
    lost = found.where("target is null").select(*keys).distinct()
    at = F.concat_ws(".", "ord", F.lpad(F.col("nth").cast("string"), 5, "0"))
    missing = firsts.join(lost, keys).groupBy(*keys).agg(F.min(at).alias("ord")).withColumn("row", F.concat_ws("\x1f", "value", beside))
    has_id = link.match == "id" and link.system is not None
    called = F.when(beside != "", beside).otherwise(F.col("value"))
    missing = missing.withColumn("called", called)
    by_name = text.normalize_name(beside if has_id else F.col("called"))
    missing = staged(_grouped(missing, _key(F.col("value")) if has_id else F.lit(""), by_name), "load-missing")
    heads = missing.groupBy("same").agg(F.min_by(F.struct("value", "called", "ord"), "ord").alias("head"))
    norm = text.normalize_name(F.col("head.called"))
    fresh = _entity(link.target_type, "id", link.system or "", _key(F.col("head.value"))) if has_id else F.when(norm != "", _entity(link.target_type, "name", norm)).otherwise(_entity(link.target_type, "text", _key(F.col("head.called"))))
    made = staged(heads.select("same", fresh.alias("entity"), F.col("head.ord").alias("ord"), F.col("head.called").alias("called")), "load-made")
    base = ["entity", F.lit(link.target_type).alias("type"), F.lit(step).alias("step"), "ord"]
    empty = F.create_map().cast("map<string,string>")
    known.add("mentions", made.select(*base, F.col("called").alias("name"), F.lit("link").alias("origin"), empty.alias("properties")), link.target_type)
    known.add("names", made.select(*base, text.normalize_name(F.col("called")).alias("norm")).where("norm <> ''"), link.target_type)
    named = staged(missing.join(made.select("same", "entity"), "same").select(*keys, F.col("entity").alias("made")), "load-named")
    if has_id:
        held = named.select(F.col("made").alias("entity"), F.lit(link.target_type).alias("type"), F.lit(link.system).alias("system"), "value")
        known.add("identifiers", held, link.target_type)
        known.add("ids", held.withColumn("value", _key(F.col("value"))), link.target_type)
    return named


def _graph(known: _Known) -> Graph:
    # entities of one mention each are what that says; others come from one pass over their mentions, with a column for each property
    alone = [k for k in known.kinds("mentions") if known.once("mentions", k)]
    several = [df for kind, df, _ in known.parts["mentions"] if kind not in alone]
    mentions = reduce(DataFrame.union, several) if several else known.spark.createDataFrame([], _PARTS["mentions"])
    keys = sorted(r["key"] for r in mentions.select(F.explode(F.map_keys("properties")).alias("key")).distinct().collect())
    head = F.min_by(F.struct("type", "name", "origin"), F.struct(F.col("origin") == "link", "step", "ord", "name")).alias("head")
    value = lambda k: F.col("properties")[k]
    last = [F.max_by(value(k), F.when(value(k).isNotNull(), F.struct("step", "ord", value(k).alias("value")))).alias(f"p{i}") for i, k in enumerate(keys)]
    pairs = [F.struct(F.lit(k).alias("key"), F.col(f"p{i}").alias("value")) for i, k in enumerate(keys)]
    props = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if keys else F.create_map().cast("map<string,string>")
    columns = ["entity", "type", "name", "origin", "properties"]
    grouped = staged(mentions.groupBy("entity").agg(head, *last).select("entity", "head.*", props.alias("properties")).select(*columns), "loaded-entities")
    entities = reduce(DataFrame.union, [grouped, *(known.all("mentions", k).select(*columns) for k in alone)])
    # an alias that says no more than the name says nothing
    called = entities if set(known.kinds("aliases")) & {None, *alone} else grouped
    aliases = known.all("aliases").groupBy("entity", F.lower("alias").alias("low")).agg(F.min("alias").alias("alias")).join(called.select("entity", "name"), "entity").where("low <> lower(name)").select("entity", "alias")
    return Graph(entities, known.distinct("identifiers").select("entity", "system", "value"), aliases, known.distinct("links"), known.all("evidence").distinct())


def load_structured(spark: SparkSession, tables: dict[str, DataFrame], mappings: list[Mapping], earlier: Graph | None = None) -> Graph:
    """The graph of mapped tables, on top of an earlier one if there is one."""
    known = _Known(spark)
    if earlier is not None:
        first = [F.lit(0).alias("step"), F.lit("").alias("ord")]
        earlier = Graph(*(staged(table, f"load-earlier-{part}") for part, table in earlier._asdict().items()))
        known.add("mentions", earlier.entities.select("entity", "type", *first, "name", "origin", "properties"))
        types = earlier.entities.select("entity", "type")
        names = earlier.entities.select("entity", "type", F.col("name").alias("said")).union(earlier.aliases.join(types, "entity").select("entity", "type", "alias"))
        known.add("names", staged(names.select("entity", "type", *first, text.normalize_name(F.col("said")).alias("norm")).where("norm <> ''").distinct(), "load-names"))
        known.add("ids", staged(earlier.identifiers.join(types, "entity").select("entity", "type", "system", _key(F.col("value")).alias("value")), "load-ids"))
        for part in ("identifiers", "aliases", "links", "evidence"):
            known.add(part, getattr(earlier, part))
    order = sorted(mappings, key=lambda m: (m.kind == "events", m.id_column is None))
    for step, m in enumerate(order, 1):
        df = tables[m.table]
        of, events = _load_events(df, m, 2 * step, known) if m.kind == "events" else (_load_list(df, m, 2 * step, known), None)
        for link in m.links:
            _load_link(df, m, link, 2 * step + 1, of, events, known)
    return _graph(known)
