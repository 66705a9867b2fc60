"""The sales tables as a graph: nodes, relations, properties with their times, texts."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import intervals as iv
from tessella.functions.calendar import day_sql
from tessella.functions.values import NO_VALUE, value_sql
from tessella.operators.graph import Graph, Timeline, ancestors

NODE_TYPES = {
    "Thing": (), "Place": ("Thing",), "Region": ("Place",), "Nation": ("Place",), "Party": ("Thing",), "Customer": ("Party",),
    "Supplier": ("Party",), "Part": ("Thing",), "SalesOrder": ("Thing",), "User": ("Thing",), "Document": ("Thing",),
}
REL_TYPES = {"located": (), "inNation": ("located",), "inRegion": ("located",), "placed": (), "hasLine": (), "suppliedBy": ()}
#: Scalar properties by node type: name, column, tag.
PROPERTIES = {
    "Region": [("name", "r_name", "string")],
    "Nation": [("name", "n_name", "string")],
    "Customer": [("name", "c_name", "string"), ("acctbal", "c_acctbal", "number"), ("mktsegment", "c_mktsegment", "string")],
    "Supplier": [("name", "s_name", "string"), ("acctbal", "s_acctbal", "number")],
    "Part": [("name", "p_name", "string"), ("brand", "p_brand", "string"), ("size", "p_size", "integer"), ("retailprice", "p_retailprice", "number")],
    "SalesOrder": [("status", "o_orderstatus", "string"), ("totalprice", "o_totalprice", "number"), ("priority", "o_orderpriority", "string")],
    "Document": [("lang", "lang", "string")],
}
SOURCES = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"), "SalesOrder": ("orders", "o_orderkey"), "Document": ("documents", "doc_id"),
}
PREFIX = {"SalesOrder": "order"}
#: Days of the calendar, and other ways to write them: fiscal quarters that begin in July, ISO weeks, Julian dates, terms.
TIMELINES = (
    Timeline("Calendar", "Calendar", "gregorian"), Timeline("EventTime", "EventTime"),
    Timeline("Quarter", "Calendar", "dates", spec='{"fields": ["year", "quarter"], "quarterStartMonth": 7, "quarterYearLabel": "end"}'),
    Timeline("Week", "Calendar", "dates", spec='{"fields": ["weekYear", "week"]}'), Timeline("Julian", "Calendar", "julian"),
    Timeline("Term", "Calendar", "era", spec='{"periods": [{"name": "First", "since": "1990-01-15"}, {"name": "Second", "since": "1996-08-01"}]}'),
)


def _id(kind: str, column: str) -> str:
    return f"concat('{PREFIX.get(kind, kind.lower())}:', {column})"


def _types(parents: dict, kind: str) -> str:
    return "array(" + ", ".join(f"'{t}'" for t in (kind, *ancestors(parents)[kind])) + ")"


def _anytime() -> str:
    return iv.ANYTIME.sql()


def _order_time(first: str = "o_orderdate") -> str:
    return iv.interval_sql("Calendar", day_sql(first), f"{day_sql(first)} + 120")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class Branch:
    """Rows of one kind: a table, its columns as SQL, and for id columns the prefix and the key column they are made of."""

    table: DataFrame
    columns: dict[str, str]
    keys: dict[str, tuple[str, str]]

    def rows(self, table: DataFrame | None = None) -> DataFrame:
        return (self.table if table is None else table).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    def with_id(self, column: str, ident: str) -> DataFrame | None:
        """The rows whose id has the prefix of this branch, by the table's own key; None if no row can have it."""
        if column not in self.keys:
            return self.rows()
        prefix, key = self.keys[column]
        rest = ident.removeprefix(prefix)
        if not ident.startswith(prefix) or not re.fullmatch(r"-?\d{1,18}", rest):
            return None
        return self.rows(self.table.where(F.col(key) == int(rest)))


#: Paths whose value is a column of the owner's own row.
OWN = tuple(dict.fromkeys([p for ps in PROPERTIES.values() for p, _, _ in ps] + ["quantity", "extendedprice", "discount"]))


def _own(known: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{p}', {known.get(p, NO_VALUE)}" for p in OWN) + ")"


_graphs: dict[tuple[str, str], tuple[tuple, Graph]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """The files or folders of a folder with their lengths and times of change: one listing, no job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def sales_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables of a folder. Its plans are analysed once for a session, until a table changes."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    if key not in _graphs or _graphs[key][0] != state:
        _graphs[key] = (state, _build(spark, sf_dir))
    return _graphs[key][1]


def _build(spark: SparkSession, sf_dir: str) -> Graph:
    """Every branch names its type and path as constants, so a filter on them leaves only the tables that it needs; values in
    `own` are the tables' columns, so filters on them reach the scan, as do ids, by the keys they are made of.
    """

    @functools.cache
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    cast = {"integer": "BIGINT", "number": "DOUBLE", "string": "STRING"}
    nodes: list[Branch] = []
    rels: list[Branch] = []
    props: list[Branch] = []
    texts: list[DataFrame] = []
    for kind, (name, key) in SOURCES.items():
        time = _order_time() if kind == "SalesOrder" else _anytime()
        ident, prefix = _id(kind, key), f"{PREFIX.get(kind, kind.lower())}:"
        values = {p: value_sql(tag, f"CAST({c} AS {cast[tag]})") for p, c, tag in PROPERTIES[kind]}
        columns = {"id": ident, "type_id": f"'{kind}'", "types": _types(NODE_TYPES, kind), "kind": "'Node'", "url": "CAST(NULL AS STRING)", "valid": time, "source": f"'{name}'", "own": _own(values)}
        nodes.append(Branch(t(name), columns, {"id": (prefix, key)}))
        for path, column, tag in PROPERTIES[kind]:
            props.append(Branch(t(name), {"owner": ident, "path": f"'{path}'", "value": values[path], "valid": time, "fallback": "true"}, {"owner": (prefix, key)}))
            if tag == "string":
                texts.append(t(name).where(F.trim(column) != "").selectExpr(f"concat({ident}, '#{path}') AS text_id", f"{ident} AS owner", "'PROPERTY_VALUE' AS kind", f"'{path}' AS path", f"{column} AS text", f"{time} AS valid"))
    texts.append(t("documents").selectExpr("concat('document:', doc_id, '#body') AS text_id", "concat('document:', doc_id) AS owner", "'PARAGRAPH' AS kind", "CAST(NULL AS STRING) AS path", "text", f"{_anytime()} AS valid"))

    # users, whose state changes with every event
    micros = "unix_micros(CAST(ts AS TIMESTAMP))"
    events = t("events").selectExpr("user_id", f"{micros} AS at", "event_type", "value")
    spans = events.groupBy("user_id").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    columns = {"id": "concat('user:', user_id)", "type_id": "'User'", "types": _types(NODE_TYPES, "User"), "kind": "'Node'", "url": "CAST(NULL AS STRING)", "valid": iv.interval_sql("EventTime", "a", "b"), "source": "'events'", "own": _own({})}
    nodes.append(Branch(spans, columns, {"id": ("user:", "user_id")}))
    ordered = events.selectExpr("*", "lead(at) OVER (PARTITION BY user_id ORDER BY at) AS next")
    until = iv.interval_sql("EventTime", "at", "next", True, False)
    for path, column, tag in (("state", "event_type", "string"), ("value", "value", "number")):
        props.append(Branch(ordered, {"owner": "concat('user:', user_id)", "path": f"'{path}'", "value": value_sql(tag, column), "valid": until, "fallback": "false"}, {"owner": ("user:", "user_id")}))

    def rel(df: DataFrame, kind: str, rid: str, src: tuple[str, str], dst: tuple[str, str], time: str, source: str, values: dict | None = None) -> None:
        ends = {"src": f"concat('{src[0]}', {src[1]})", "dst": f"concat('{dst[0]}', {dst[1]})"}
        columns = {"rel_id": rid, **ends, "type_id": f"'{kind}'", "types": _types(REL_TYPES, kind), "label": "CAST(NULL AS STRING)", "valid": time, "source": f"'{source}'", "own": _own(values or {})}
        rels.append(Branch(df, columns, {"src": src, "dst": dst}))

    placed_time = iv.interval_sql("Calendar", day_sql("o_orderdate"), "CAST(NULL AS BIGINT)")
    ship_time = iv.interval_sql("Calendar", day_sql("l_shipdate"), f"{day_sql('l_shipdate')} + 30")
    line = "concat_ws('-', 'line', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))"
    values = {p: value_sql("number", c) for p, c in (("quantity", "l_quantity"), ("extendedprice", "l_extendedprice"), ("discount", "l_discount"))}
    rel(t("customer"), "inNation", "concat('inNation-c', c_custkey)", ("customer:", "c_custkey"), ("nation:", "c_nationkey"), _anytime(), "customer")
    rel(t("supplier"), "inNation", "concat('inNation-s', s_suppkey)", ("supplier:", "s_suppkey"), ("nation:", "s_nationkey"), _anytime(), "supplier")
    rel(t("nation"), "inRegion", "concat('inRegion-', n_nationkey)", ("nation:", "n_nationkey"), ("region:", "n_regionkey"), _anytime(), "nation")
    rel(t("orders"), "placed", "concat('placed-', o_orderkey)", ("customer:", "o_custkey"), ("order:", "o_orderkey"), placed_time, "orders")
    rel(t("lineitem"), "hasLine", line, ("order:", "l_orderkey"), ("part:", "l_partkey"), ship_time, "lineitem", values)
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    rel(supplied, "suppliedBy", "concat_ws('-', 'suppliedBy', l_partkey, l_suppkey)", ("part:", "l_partkey"), ("supplier:", "l_suppkey"), _anytime(), "lineitem")
    for path, value in values.items():
        props.append(Branch(t("lineitem"), {"owner": line, "path": f"'{path}'", "value": value, "valid": ship_time, "fallback": "true"}, {}))
    declared = {(k, p): tag for k, ps in PROPERTIES.items() for p, _, tag in ps} | {("User", "state"): "string", ("User", "value"): "number"}
    declared |= {("hasLine", p): "number" for p in values}
    tables = {"nodes": nodes, "rels": rels, "props": props}

    def narrow(table: str, column: str, ident: str) -> DataFrame:
        found = [x for b in tables[table] if (x := b.with_id(column, ident)) is not None]
        return _union(found) if found else tables[table][0].rows().limit(0)

    every = {name: _union([b.rows() for b in branches]) for name, branches in tables.items()}
    return Graph(
        spark, every["nodes"], every["rels"], every["props"], _union(texts), NODE_TYPES, REL_TYPES,
        {k: {"integer": "number"}.get(v, v) for k, v in declared.items()},
        {"inNation": (("Party",), ("Nation",)), "inRegion": (("Nation",), ("Region",)), "placed": (("Customer",), ("SalesOrder",)), "hasLine": (("SalesOrder",), ("Part",)), "suppliedBy": (("Part",), ("Supplier",))},
        {t.id: t for t in TIMELINES}, own=frozenset(OWN), narrow=narrow,
    )
