"""Relational tables as quads.

A table is declared once (``Mapped``); ``quads`` makes them with one scan a table (an array of the row's
terms, exploded), ``quads_sql`` writes the same as plain SQL.  Quads are a set: where a table's subject
key is not unique the rows are made distinct, else there is nothing to remove and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import LANG_STRING, NAMED_INDIVIDUAL, STRING, TYPE, XSD
from . import store

BASE = "http://example.org/"
COLUMNS = ("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "o_key")


@dataclass(frozen=True)
class Value:
    """A property: ``kind`` iri, bnode or literal; ``sql`` is its text, ``when`` a condition, ``language``
    the SQL of a language tag."""

    p: str
    sql: str
    kind: str = "literal"
    datatype: str = STRING
    when: str | None = None
    language: str | None = None


@dataclass(frozen=True)
class Mapped:
    table: str
    graph: str
    s: str
    s_kind: str
    values: tuple[Value, ...]
    unique: bool = True


def _text(value: str) -> str:
    return f"'{value}'"


def _type(name: str, when: str | None = None) -> Value:
    return Value(TYPE, _text(f"{BASE}class/{name}"), "iri", when=when)


def _lit(table: str, column: str, datatype: str = "string") -> Value:
    return Value(f"{BASE}{table}#{column}", f"cast({column} as string)" if datatype != "string" else column, datatype=XSD + datatype, when=f"{column} is not null")


def _ref(table: str, column: str, to: str) -> Value:
    return Value(f"{BASE}{table}#ref-{column}", f"{_text(BASE + to + '/')} || cast({column} as string)", "iri", when=f"{column} is not null")


def _iri(table: str, key: str) -> str:
    return f"{_text(BASE + table + '/')} || cast({key} as string)"


_LINE = "'li_' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string)"
MAPPING = (
    Mapped("region", "geo", _iri("region", "r_regionkey"), "iri", (_type("Region"), Value(TYPE, _text(NAMED_INDIVIDUAL), "iri"), _lit("region", "r_name"))),
    Mapped("nation", "geo", _iri("nation", "n_nationkey"), "iri", (_type("Nation"), _lit("nation", "n_name"), _ref("nation", "n_regionkey", "region"))),
    Mapped("customer", "parties", _iri("customer", "c_custkey"), "iri", (_type("Customer"), _lit("customer", "c_name"), _lit("customer", "c_mktsegment"), _lit("customer", "c_acctbal", "double"), _ref("customer", "c_nationkey", "nation"))),
    Mapped("supplier", "parties", _iri("supplier", "s_suppkey"), "iri", (_type("Supplier"), _lit("supplier", "s_name"), _lit("supplier", "s_acctbal", "double"), _ref("supplier", "s_nationkey", "nation"))),
    Mapped("orders", "sales", _iri("orders", "o_orderkey"), "iri", (_type("Order"), _lit("orders", "o_orderstatus"), _lit("orders", "o_orderpriority"), _lit("orders", "o_totalprice", "double"), _lit("orders", "o_orderdate", "dateTime"), _ref("orders", "o_custkey", "customer"))),
    Mapped("lineitem", "sales", _iri("orders", "l_orderkey"), "iri", (Value(f"{BASE}orders#hasLine", _LINE, "bnode"),), unique=False),
    Mapped(
        "lineitem", "sales", _LINE, "bnode",
        (_type("LineItem"), _lit("lineitem", "l_quantity", "double"), _lit("lineitem", "l_returnflag"), _lit("lineitem", "l_shipdate", "dateTime"), _ref("lineitem", "l_orderkey", "orders"), _ref("lineitem", "l_partkey", "part"), _ref("lineitem", "l_suppkey", "supplier")),
        unique=False,
    ),
    Mapped("part", "catalog", _iri("part", "p_partkey"), "iri", (_type("Part"), Value(TYPE, "'small'", "bnode", when="p_size = 1"), _lit("part", "p_name"), _lit("part", "p_brand"), _lit("part", "p_type"), _lit("part", "p_size", "integer"), _lit("part", "p_retailprice", "double"))),
    Mapped("events", "events", _iri("events", "event_id"), "iri", (_type("Event"), Value(TYPE, f"{_text(BASE + 'class/')} || event_type || 'Event'", "iri", when="event_type is not null"), _lit("events", "ts", "dateTime"), _lit("events", "value", "double"), _lit("events", "props"), _ref("events", "user_id", "customer"))),
    Mapped("documents", "docs", _iri("documents", "doc_id"), "iri", (_type("Document"), Value(f"{BASE}documents#source", "source", datatype=LANG_STRING, when="source is not null", language="lang"), _lit("documents", "n_chars", "integer"))),
    Mapped("labels", "docs", "'lbl_' || cast(doc_id as string)", "bnode", (_type("Label"), _lit("labels", "quality", "integer"), _lit("labels", "toxic", "integer"), _ref("labels", "doc_id", "documents"))),
)


def _fields(v: Value) -> dict[str, str]:
    """SQL of p, o, o_kind, o_dt, o_lang, o_key."""
    language = f"lower({v.language})" if v.language else "cast(null as string)"
    key = {"iri": f"'<' || {v.sql} || '>'", "bnode": f"'_:' || {v.sql}"}.get(v.kind) or (f"'\"' || {v.sql} || '\"@' || {language}" if v.language else f"'\"' || {v.sql} || '\"^^<{v.datatype}>'")
    return {"p": _text(v.p), "o": v.sql, "o_kind": _text(v.kind), "o_dt": _text(v.datatype) if v.kind == "literal" else "cast(null as string)", "o_lang": language, "o_key": key}


def quads(spark: SparkSession, sf_dir: str, mapping: tuple[Mapped, ...] = MAPPING) -> DataFrame:
    """The quads of the tables in ``sf_dir``."""
    out = None
    for m in mapping:
        rows = spark.read.parquet(f"{sf_dir}/{m.table}.parquet")
        rows = _unique(rows, m) if m.unique else _distinct(rows, m)
        rows = rows.select(F.lit(f"{BASE}graph/{m.graph}").alias("g"), "s", F.lit(m.s_kind).alias("s_kind"), "t.*")
        out = rows if out is None else out.unionByName(rows)
    return out.select(*COLUMNS)


def _unique(rows: DataFrame, m: Mapped) -> DataFrame:
    parts = []
    for v in m.values:
        one = "struct({})".format(", ".join(f"{sql} as {name}" for name, sql in _fields(v).items()))
        parts.append(f"case when {v.when} then {one} end" if v.when else one)
    return rows.select(F.expr(m.s).alias("s"), F.explode(F.expr(f"array({', '.join(parts)})")).alias("t")).where("t is not null")


def _distinct(rows: DataFrame, m: Mapped) -> DataFrame:
    """Only subject, number of the property and value are shuffled; the other terms follow from these."""
    parts = []
    for k, v in enumerate(m.values):
        one = f"struct({k} as k, {v.sql} as o, {v.language or 'cast(null as string)'} as l)"
        parts.append(f"case when {v.when} then {one} end" if v.when else one)
    few = rows.select(F.expr(m.s).alias("s"), F.explode(F.expr(f"array({', '.join(parts)})")).alias("x")).where("x is not null").select("s", "x.k", "x.o", "x.l").distinct()
    own = [Value(v.p, "o", v.kind, v.datatype, None, "l" if v.language else None) for v in m.values]
    cases = " ".join("when {} then struct({})".format(k, ", ".join(f"{sql} as {name}" for name, sql in _fields(v).items())) for k, v in enumerate(own))
    return few.select("s", F.expr(f"case k {cases} end").alias("t"))


def paths(sf_dir: str, mapping: tuple[Mapped, ...] = MAPPING) -> list[str]:
    return sorted({f"{sf_dir}/{m.table}.parquet" for m in mapping})


def stored(spark: SparkSession, sf_dir: str, mapping: tuple[Mapped, ...] = MAPPING) -> DataFrame:
    """The quads, kept as parquet by graph in the shared folder; the tables' files name them."""
    made_of = (COLUMNS, quads_sql(mapping), store.files_of(spark, paths(sf_dir, mapping)))
    return store.kept(spark, "quads", made_of, lambda: quads(spark, sf_dir, mapping), ("g",)).select(*COLUMNS)


def quads_sql(mapping: tuple[Mapped, ...] = MAPPING) -> str:
    """The same as one SELECT."""
    parts = []
    for m in mapping:
        for v in m.values:
            fields = ", ".join(f"{sql} as {name}" for name, sql in _fields(v).items())
            parts.append(f"SELECT '{BASE}graph/{m.graph}' as g, {m.s} as s, '{m.s_kind}' as s_kind, {fields} FROM {m.table}" + (f" WHERE {v.when}" if v.when else ""))
    return "SELECT DISTINCT {} FROM ({})".format(", ".join(COLUMNS), "\nUNION ALL ".join(parts))
