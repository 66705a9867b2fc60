"""Registered queries over the sales graph, and DuckDB SQL for the same rows from the tables themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import calendar, temporal, text
from tessella.functions import intervals as iv
from tessella.operators import graph as ops
from tessella.operators import inspect, postings
from tessella.plans import structured as st
from tessella.plans.planner import rows_of
from tessella.sources import bundle, markdown
from tessella.sources.tables import sales_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_DAY = "(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) + 2440588)"
_O = _DAY.format("o_orderdate")
_L = _DAY.format("l_shipdate")


def _flat(df: DataFrame) -> DataFrame:
    """Values that change with time but have one entry as plain columns; validities as rows of intervals."""
    columns = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("array<struct<v:"):
            columns.append(F.expr(f"coalesce(`{f.name}`[0].v.s, CAST(coalesce(`{f.name}`[0].v.d, CAST(`{f.name}`[0].v.i AS DOUBLE)) AS STRING), CAST(`{f.name}`[0].v.b AS STRING))").alias(f.name))
        elif kind.startswith("struct<universal:"):
            columns.append(F.explode(F.expr(iv.rows_sql(f"`{f.name}`"))).alias("_i"))
        else:
            columns.append(F.col(f.name))
    out = df.select(*columns)
    return out.select(*[c for c in out.columns if c != "_i"], "_i.*") if "_i" in out.columns else out


def pattern(name: str, query: str, sql: str | None, **params) -> None:
    """Registers a query of the pattern language."""
    QUERIES[name] = lambda spark, sf_dir: _flat(rows_of(sales_graph(spark, sf_dir), query, params))
    if sql:
        ORACLES[name] = sql


def graph_query(sql: str | None = None, name: str | None = None):
    """Registers a function of (graph, tables)."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(sales_graph(spark, sf_dir), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[key] = sql
        return f

    return add


_PARTY = "(SELECT 'customer:' || c_custkey AS id, c_nationkey AS nk FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier)"

# scans

pattern("scan_type_derived", "MATCH (p:Place) RETURN ID(p) AS id, TYPE(p) AS type", "SELECT 'region:' || r_regionkey AS id, 'Region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation' FROM nation")
pattern("scan_type", "MATCH (p:Party) RETURN ID(p) AS id", f"SELECT id FROM {_PARTY}")


@graph_query("SELECT 'customer:' || c_custkey AS id FROM customer")
def scan_type_exact(g, t):
    return st.run(g, st.GraphQuery(st.Nodes(type="Customer", derived=False), limit=None)).rows.select(F.col("root").alias("id"))


@graph_query("SELECT 'order:' || o_orderkey AS id, 'SalesOrder' AS type_id FROM orders WHERE o_orderkey = 7")
def scan_id(g, t):
    found = st.run(g, st.GraphQuery(st.Nodes(id="order:7"))).rows.select(F.col("root").alias("id"))
    return found.select("id", F.lit("SalesOrder").alias("type_id"))


# joins

pattern("expand_out", "MATCH (c:Customer)-[:placed]->(o:SalesOrder) RETURN ID(c) AS c, ID(o) AS o", "SELECT 'customer:' || o_custkey AS c, 'order:' || o_orderkey AS o FROM orders")
pattern("expand_in", "MATCH (o:SalesOrder)<-[:placed]-(c:Customer) WHERE c.mktsegment = 'BUILDING' RETURN ID(o) AS o, ID(c) AS c", "SELECT 'order:' || o_orderkey AS o, 'customer:' || c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
pattern(
    "expand_either", "MATCH (a:Place)-[r:inRegion]-(b:Place) RETURN ID(a) AS a, ID(b) AS b",
    "SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation",
)
pattern("expand_two_hop", "MATCH (p:Party)-[:inNation]->(n:Nation)-[:inRegion]->(r:Region) RETURN ID(p) AS p, ID(r) AS r, r.name AS name", f"SELECT id AS p, 'region:' || n_regionkey AS r, r_name AS name FROM {_PARTY} JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey")
pattern(
    "join_shared_variable", "MATCH (o:SalesOrder)-[l:hasLine]->(p:Part), (p)-[:suppliedBy]->(s:Supplier) WHERE l.quantity >= 50.0 AND p.size = 1 RETURN ID(o) AS o, ID(p) AS p, ID(s) AS s",
    f"SELECT 'order:' || l.l_orderkey AS o, 'part:' || l.l_partkey AS p, 'supplier:' || s.l_suppkey AS s FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey JOIN part ON p_partkey = l.l_partkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) s ON s.l_partkey = l.l_partkey WHERE l.l_quantity >= 50 AND p_size = 1 AND greatest({_O}, {_L}) <= least({_O} + 120, {_L} + 30)",
)
pattern(
    "join_order", "MATCH (c:Customer), (o:SalesOrder), (c)-[:placed]->(o) WHERE o.totalprice > 300000.0 RETURN ID(c) AS c, ID(o) AS o",
    "SELECT 'customer:' || o_custkey AS c, 'order:' || o_orderkey AS o FROM orders WHERE o_totalprice > 300000",
)
pattern(
    "join_from_middle", "MATCH (c)-[:placed]->(o:SalesOrder)-[l:hasLine]->(p), (c)-[:inNation]->(n), (p:Part) WHERE ID(n) = 'nation:7' AND o.totalprice > 200000.0 RETURN ID(c) AS c, ID(o) AS o, ID(l) AS l, ID(p) AS p",
    f"SELECT 'customer:' || o_custkey AS c, 'order:' || o_orderkey AS o, concat_ws('-', 'line', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS l, 'part:' || l_partkey AS p FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 7 AND o_totalprice > 200000 AND greatest({_O}, {_L}) <= least({_O} + 120, {_L} + 30)",
)
pattern(
    "join_parts", "MATCH (a:Region), (n:Nation)-[:inRegion]->(r:Region), (b:Supplier)-[:inNation]->(n) WHERE a.name = 'ASIA' AND r.name = 'EUROPE' RETURN ID(a) AS a, ID(n) AS n, ID(b) AS b",
    "SELECT 'region:' || a.r_regionkey AS a, 'nation:' || n_nationkey AS n, 'supplier:' || s_suppkey AS b FROM region a, nation JOIN region r ON n_regionkey = r.r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE a.r_name = 'ASIA' AND r.r_name = 'EUROPE'",
)
pattern("join_shared_relation", "MATCH (c:Customer)-[r:placed]->(o), (x)-[r]->(y:SalesOrder) WHERE y.totalprice > 300000.0 RETURN ID(x) AS x, ID(o) AS o, ID(r) AS r", "SELECT 'customer:' || o_custkey AS x, 'order:' || o_orderkey AS o, 'placed-' || o_orderkey AS r FROM orders WHERE o_totalprice > 300000")
pattern("join_cartesian", "MATCH (a:Region), (b:Region) RETURN ID(a) AS a, ID(b) AS b", "SELECT 'region:' || a.r_regionkey AS a, 'region:' || b.r_regionkey AS b FROM region a CROSS JOIN region b")
pattern("join_repeated_variable", "MATCH (c:Customer)-[:inNation]->(n:Nation)<-[:inNation]-(c) RETURN ID(c) AS c, ID(n) AS n", "SELECT 'customer:' || c_custkey AS c, 'nation:' || c_nationkey AS n FROM customer")
_TEMPORAL = f"FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE greatest({_O}, {_L}) <= least({_O} + 120, {_L} + 30)"
pattern(
    "temporal_join", "MATCH (o:SalesOrder)-[l:hasLine]->(p:Part) RETURN ID(o) AS o, ID(l) AS l, VALIDITY() AS v",
    f"SELECT 'order:' || o_orderkey AS o, concat_ws('-', 'line', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS l, 'Calendar' AS axis, CAST(greatest({_O}, {_L}) AS DOUBLE) AS lo, true AS lo_inc, CAST(least({_O} + 120, {_L} + 30) AS DOUBLE) AS hi, true AS hi_inc {_TEMPORAL}",
)

# VALID

_ORDERS = "SELECT 'order:' || o_orderkey AS id FROM orders"
_A, _Z = calendar.day_number("1997-03-01"), calendar.day_number("1997-06-15")
pattern("valid_anytime", "MATCH (n:Nation) VALID ANYTIME RETURN ID(n) AS id", "SELECT 'nation:' || n_nationkey AS id FROM nation")
pattern("valid_anytime_on", "MATCH (n:Thing) VALID ON Calendar ANYTIME RETURN ID(n) AS id", _ORDERS)
pattern("valid_at", 'MATCH (o:SalesOrder) VALID ON Calendar AT "1997-03-01" RETURN ID(o) AS id', f"{_ORDERS} WHERE {_O} <= {_A} AND {_A} <= {_O} + 120")
pattern("valid_overlaps", 'MATCH (o:SalesOrder) VALID ON Calendar OVERLAPS ["1997-03-01", "1997-06-15") RETURN ID(o) AS id', f"{_ORDERS} WHERE {_O} < {_Z} AND {_A} <= {_O} + 120")
pattern("valid_contains", 'MATCH (o:SalesOrder) VALID ON Calendar CONTAINS ["1997-03-01", "1997-06-15"] RETURN ID(o) AS id', f"{_ORDERS} WHERE {_O} <= {_A} AND {_Z} <= {_O} + 120")
pattern("valid_during", 'MATCH (o:SalesOrder) VALID ON Calendar DURING ("1997-03-01", +INF) RETURN ID(o) AS id', f"{_ORDERS} WHERE {_O} > {_A}")
pattern(
    "matched_validity", 'MATCH (o:SalesOrder) VALID ON Calendar OVERLAPS ["1997-03-01", "1997-06-15") RETURN ID(o) AS id, MATCHED_VALIDITY() AS m',
    f"SELECT 'order:' || o_orderkey AS id, 'Calendar' AS axis, CAST(greatest({_O}, {_A}) AS DOUBLE) AS lo, true AS lo_inc, CAST(least({_O} + 120, {_Z}) AS DOUBLE) AS hi, {_O} + 120 < {_Z} AS hi_inc FROM orders WHERE {_O} < {_Z} AND {_A} <= {_O} + 120",
)
pattern(
    "validity_rows", "MATCH (c:Customer)-[r:placed]->(o:SalesOrder) WHERE o.totalprice > 400000.0 RETURN ID(o) AS id, VALIDITY(r) AS v",
    f"SELECT 'order:' || o_orderkey AS id, 'Calendar' AS axis, CAST({_O} AS DOUBLE) AS lo, true AS lo_inc, CAST({_O} + 120 AS DOUBLE) AS hi, true AS hi_inc FROM orders WHERE o_totalprice > 400000",
)

# the same axis in other words: the days of a period come from DuckDB's own calendar

_SPAN = "(SELECT min(d) AS a, max(d) AS b FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS d) WHERE {}) w"
for _name, _clause, _days in (
    ("valid_fiscal_quarter", 'Quarter AT "1997-Q3"', "year(d) = 1997 AND month(d) BETWEEN 1 AND 3"),
    ("valid_iso_weeks", 'Week OVERLAPS ["1997-W52", "1998-W02"]', "strftime(d, '%G-W%V') IN ('1997-W52', '1998-W01', '1998-W02')"),
    ("valid_julian", 'Julian AT "1996-02-29"', "d = DATE '1996-03-13'"),
    ("valid_era", 'Term OVERLAPS ["First 7-07-20", "Second 1-08-01"]', "d BETWEEN DATE '1996-07-20' AND DATE '1996-08-01'"),
):
    pattern(_name, f"MATCH (o:SalesOrder) VALID ON {_clause} RETURN ID(o) AS id", f"{_ORDERS}, {_SPAN.format(_days)} WHERE CAST(o_orderdate AS DATE) <= b AND a <= CAST(o_orderdate AS DATE) + 120")

# predicates

for _name, _test, _sql in (
    ("predicate_eq", "c.mktsegment = 'MACHINERY'", "c_mktsegment = 'MACHINERY'"),
    ("predicate_ne", "c.mktsegment != 'MACHINERY'", "c_mktsegment <> 'MACHINERY'"),
    ("predicate_lt", "c.acctbal < 0", "c_acctbal < 0"),
    ("predicate_le", "c.acctbal <= 1000.5", "c_acctbal <= 1000.5"),
    ("predicate_gt", "c.acctbal > $least", "c_acctbal > 9000"),
    ("predicate_ge", "c.acctbal >= 9000", "c_acctbal >= 9000"),
    ("predicate_starts_ends", "c.name STARTS WITH 'Customer#0000001' AND c.name ENDS WITH '7'", "starts_with(c_name, 'Customer#0000001') AND c_name LIKE '%7'"),
    ("predicate_contains", "c.name CONTAINS '77'", "contains(c_name, '77')"),
    ("predicate_in", "c.mktsegment IN $segments", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("boolean_or_not", "c.acctbal > 9000 OR NOT c.mktsegment = 'BUILDING'", "c_acctbal > 9000 OR NOT c_mktsegment = 'BUILDING'"),
    ("arithmetic", "c.acctbal * 2 - 100.5 > 9000 + c.acctbal / 4", "c_acctbal * 2 - 100.5 > 9000 + c_acctbal / 4"),
    ("exists", "EXISTS(c.acctbal)", "true"),
    ("is_not_missing", "c.acctbal IS NOT MISSING AND c.acctbal IS NOT NULL", "true"),
):
    pattern(_name, f"MATCH (c:Customer) WHERE {_test} RETURN ID(c) AS id", f"SELECT 'customer:' || c_custkey AS id FROM customer WHERE {_sql}", least=9000.0, segments=["BUILDING", "MACHINERY"])
pattern("is_missing", "MATCH (p:Party) WHERE p.mktsegment IS MISSING RETURN ID(p) AS id", "SELECT 'supplier:' || s_suppkey AS id FROM supplier")
pattern("division_absent", "MATCH (p:Part) WHERE NOT EXISTS(1 / (p.size % 3)) RETURN ID(p) AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_size % 3 = 0")
pattern("modulo", "MATCH (p:Part) WHERE p.size % 7 = 3 RETURN ID(p) AS id, p.size % 7 AS m", "SELECT 'part:' || p_partkey AS id, CAST(CAST(p_size % 7 AS DOUBLE) AS VARCHAR) AS m FROM part WHERE p_size % 7 = 3")
pattern(
    "entity_functions", "MATCH (c:Customer)-[r:placed]->(o:SalesOrder) WHERE o.totalprice > 450000.0 RETURN ID(r) AS r, TYPE(r) AS t, KIND(c) AS k, TITLE(c) AS title, SOURCE(o) AS s, START_NODE(r) AS a, END_NODE(r) AS b",
    "SELECT 'placed-' || o_orderkey AS r, 'placed' AS t, 'Node' AS k, 'customer:' || o_custkey AS title, 'orders' AS s, 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders WHERE o_totalprice > 450000",
)
pattern("type_ref", "MATCH (p:Party) WHERE TYPE(p) = TYPE_REF('Supplier') RETURN ID(p) AS id", "SELECT 'supplier:' || s_suppkey AS id FROM supplier")

# values that change with time

_ISLANDS = """WITH e AS (SELECT user_id, epoch_us(ts) AS tm, event_type AS state, value FROM events),
n AS (SELECT *, lead(tm) OVER (PARTITION BY user_id ORDER BY tm) AS nxt FROM e),
p AS (SELECT *, {test} AS hit FROM n),
g AS (SELECT *, count(CASE WHEN NOT hit THEN 1 END) OVER (PARTITION BY user_id ORDER BY tm) AS grp FROM p)
SELECT 'user:' || user_id AS id, 'EventTime' AS axis, CAST(min(tm) AS DOUBLE) AS lo, true AS lo_inc, CAST(CASE WHEN count(*) > count(nxt) THEN max(tm) ELSE max(nxt) END AS DOUBLE) AS hi, count(*) > count(nxt) AS hi_inc
FROM g WHERE hit GROUP BY user_id, grp"""
for _name, _test, _sql in (
    ("predicate_temporal", "u.state = 'click'", "state = 'click'"),
    ("predicate_temporal_and", "u.state = 'click' AND u.value > 20.0", "(state = 'click' AND value > 20)"),
    ("predicate_temporal_or", "u.state = 'click' OR u.value > 50.0", "(state = 'click' OR value > 50)"),
    ("predicate_temporal_not", "NOT (u.state = 'click' OR u.state = 'view')", "(state NOT IN ('click', 'view'))"),
):
    pattern(_name, f"MATCH (u:User) WHERE {_test} RETURN ID(u) AS id, VALIDITY() AS v", _ISLANDS.format(test=_sql))

# text

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')"
_FULL = "MATCH (d:Document) WHERE FULLTEXT(d.body, {}) RETURN ID(d) AS id, SCORE() AS score"
_COUNT = "len([x for x in " + _WORDS + " if x = '%s'])"
_TERM = "list_contains(" + _WORDS + ", '%s')"
pattern("fulltext_terms", _FULL.format('"thing the"'), f"SELECT 'document:' || doc_id AS id, CAST({_COUNT % 'thing'} + {_COUNT % 'the'} AS DOUBLE) AS score FROM documents WHERE {_TERM % 'thing'} AND {_TERM % 'the'}")
pattern(
    "fulltext_or", _FULL.format('"para OR und"'),
    f"SELECT 'document:' || doc_id AS id, CAST(greatest({_COUNT % 'para'}, {_COUNT % 'und'}) AS DOUBLE) AS score FROM documents WHERE {_TERM % 'para'} OR {_TERM % 'und'}",
)
pattern("fulltext_phrase", _FULL.format('"\\"of the\\""'), "SELECT 'document:' || doc_id AS id, CAST(1 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'of the')")
pattern("fulltext_property", "MATCH (p:Part) WHERE FULLTEXT(p.name, \"red bolt\") RETURN ID(p) AS id, p.name AS name", "SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'bolt')")
pattern("fulltext_prefix", "MATCH (p:Part) WHERE FULLTEXT(p.name, \"re* gi*\") RETURN ID(p) AS id, SCORE() AS score", "SELECT 'part:' || p_partkey AS id, CAST(len([x for x in string_split(p_name, ' ') if starts_with(x, 're')]) + len([x for x in string_split(p_name, ' ') if starts_with(x, 'gi')]) AS DOUBLE) AS score FROM part WHERE len([x for x in string_split(p_name, ' ') if starts_with(x, 're')]) > 0 AND len([x for x in string_split(p_name, ' ') if starts_with(x, 'gi')]) > 0")


@graph_query(
    """WITH d AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), s AS (SELECT count(*) AS n, avg(len(w)) AS a, sum(CASE WHEN list_contains(w, 'red') THEN 1 ELSE 0 END) AS r, sum(CASE WHEN list_contains(w, 'bolt') THEN 1 ELSE 0 END) AS b FROM d)
    SELECT 'part:' || p_partkey AS id, round(ln(1 + (n - r + 0.5) / (r + 0.5)) * len([x for x in w if x = 'red']) * 2.2 / (len([x for x in w if x = 'red']) + 1.2 * (0.25 + 0.75 * len(w) / a))
    + ln(1 + (n - b + 0.5) / (b + 0.5)) * len([x for x in w if x = 'bolt']) * 2.2 / (len([x for x in w if x = 'bolt']) + 1.2 * (0.25 + 0.75 * len(w) / a)), 6) AS score FROM d, s"""
)
def bm25(g, t):
    names = t("part").selectExpr("concat('part:', p_partkey) AS id", "p_name AS text")
    return text.bm25(names, "red bolt").select("id", F.round("score", 6).alias("score"))


# projection

pattern("distinct", "MATCH (c:Customer)-[:inNation]->(n:Nation) RETURN DISTINCT ID(n) AS n, TYPE(c) AS t", "SELECT DISTINCT 'nation:' || c_nationkey AS n, 'Customer' AS t FROM customer")
pattern("order_limit", "MATCH (n:Nation) RETURN ID(n) AS id ORDER BY id DESC LIMIT 5", "SELECT 'nation:' || n_nationkey AS id FROM nation ORDER BY id DESC LIMIT 5")
pattern("offset_limit", "MATCH (n:Nation) RETURN ID(n) AS id ORDER BY id OFFSET 3 LIMIT $n", "SELECT 'nation:' || n_nationkey AS id FROM nation ORDER BY id LIMIT 4 OFFSET 3", n=4)

# structured queries

_RICH = st.Property("acctbal", "GREATER_THAN", 9000.0)
_BUILD = st.Property("mktsegment", "EQUALS", "BUILDING")


def structured(name: str, query: st.GraphQuery, sql: str | None, *columns: str, times: bool = False) -> None:
    def make(spark, sf_dir):
        rows = st.run(sales_graph(spark, sf_dir), query).rows
        return _flat(rows.select("root", *columns, "valid")) if times else rows.select("root", *columns)

    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


_CUSTOMERS = "SELECT 'customer:' || c_custkey AS root FROM customer"
structured("structured_and", st.GraphQuery(st.Nodes(type="Customer"), st.And((_RICH, _BUILD)), limit=None), f"{_CUSTOMERS} WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
structured("structured_or", st.GraphQuery(st.Nodes(type="Customer"), st.Or((_RICH, _BUILD)), limit=None), f"{_CUSTOMERS} WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING'")
_NOT_CLICK = """WITH e AS (SELECT user_id, epoch_us(ts) AS tm, event_type AS state FROM events), n AS (SELECT *, lead(tm) OVER (PARTITION BY user_id ORDER BY tm) AS nxt FROM e),
g AS (SELECT *, count(CASE WHEN state = 'click' THEN 1 END) OVER (PARTITION BY user_id ORDER BY tm) AS grp FROM n)
SELECT 'user:' || user_id AS root, 'EventTime' AS axis, CAST(min(tm) AS DOUBLE) AS lo, true AS lo_inc, CAST(CASE WHEN count(*) > count(nxt) THEN max(tm) ELSE max(nxt) END AS DOUBLE) AS hi, count(*) > count(nxt) AS hi_inc FROM g WHERE state <> 'click' GROUP BY user_id, grp"""
structured("structured_not", st.GraphQuery(st.Nodes(type="User"), st.Not(st.Property("state", "EQUALS", "click")), limit=None), _NOT_CLICK, times=True)
structured(
    "structured_relation", st.GraphQuery(st.Nodes(type="Customer"), st.Relation("inNation", target=st.Nodes(type="Nation"), variable="n", expression=st.Relation("inRegion", expression=st.Property("name", "EQUALS", "ASIA"))), limit=None),
    "SELECT 'customer:' || c_custkey AS root, 'nation:' || n_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "n",
)
structured(
    "structured_relation_property", st.GraphQuery(st.Nodes(type="SalesOrder"), st.Relation("hasLine", properties=(st.Property("quantity", "GREATER_THAN_OR_EQUALS", 50.0),), variable="p"), limit=None),
    f"SELECT DISTINCT 'order:' || o_orderkey AS root, 'part:' || l_partkey AS p {_TEMPORAL} AND l_quantity >= 50", "p",
)
_WINDOW = f"SELECT 'order:' || o_orderkey AS root, 'Calendar' AS axis, CAST(greatest({_O}, {_A}) AS DOUBLE) AS lo, true AS lo_inc, CAST(least({_O} + 120, {_Z}) AS DOUBLE) AS hi, {{}} AS hi_inc FROM orders WHERE {_O} {{}} {_Z} AND {_A} <= {_O} + 120"
_ORDERS_Q = st.Nodes(type="SalesOrder")
structured("structured_window_range", st.GraphQuery(_ORDERS_Q, window=st.Window("Calendar", "1997-03-01", "1997-06-15"), limit=None), _WINDOW.format(f"{_O} + 120 < {_Z}", "<"), times=True)
structured("structured_window_closed", st.GraphQuery(_ORDERS_Q, window=st.Window("Calendar", "1997-03-01", "1997-06-15", True), limit=None), _WINDOW.format("true", "<="), times=True)
structured("structured_window_at", st.GraphQuery(_ORDERS_Q, window=st.Window("Calendar", "1997-03-01"), operator="AT", limit=None), f"SELECT 'order:' || o_orderkey AS root FROM orders WHERE {_O} <= {_A} AND {_A} <= {_O} + 120")
structured(
    "structured_contains_query", st.GraphQuery(_ORDERS_Q, window=st.Window("Calendar", "1997-03-01", "1997-06-15", True), operator="ASSERTION_CONTAINS_QUERY", limit=None),
    f"SELECT 'order:' || o_orderkey AS root FROM orders WHERE {_O} <= {_A} AND {_Z} <= {_O} + 120",
)
structured(
    "structured_within_query", st.GraphQuery(_ORDERS_Q, window=st.Window("Calendar", "1997-03-01", "1997-08-15", True), operator="QUERY_CONTAINS_ASSERTION", limit=None),
    f"SELECT 'order:' || o_orderkey AS root FROM orders WHERE {_O} >= {_A} AND {_O} + 120 <= {calendar.day_number('1997-08-15')}",
)
structured("structured_universal_window", st.GraphQuery(st.Nodes(type="Region"), window=st.Window("Calendar", "1997-03-01"), operator="AT"), f"SELECT 'region:' || r_regionkey AS root, 'Calendar' AS axis, CAST({_A} AS DOUBLE) AS lo, true AS lo_inc, CAST({_A} AS DOUBLE) AS hi, true AS hi_inc FROM region", times=True)
structured("structured_text", st.GraphQuery(st.Nodes(type="Part"), st.Text("red bolt", "ALL_TERMS"), limit=None), "SELECT 'part:' || p_partkey AS root FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'bolt')")

# interval algebra over rows

_OPEN = iv.interval_sql("Calendar", calendar.day_sql("o_orderdate"), f"{calendar.day_sql('o_orderdate')} + 30", True, False)


def _order_sets(t):
    return t("orders").selectExpr("o_custkey AS k", f"{_OPEN} AS v").groupBy("k").agg(F.collect_list("v").alias("sets"))


@graph_query(
    f"""WITH i AS (SELECT o_custkey AS k, {_O} AS lo, {_O} + 30 AS hi FROM orders), m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
    g AS (SELECT *, sum(CASE WHEN before >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY lo, hi) AS grp FROM m)
    SELECT k, 'Calendar' AS axis, CAST(min(lo) AS DOUBLE) AS lo, true AS lo_inc, CAST(max(hi) AS DOUBLE) AS hi, false AS hi_inc FROM g GROUP BY k, grp"""
)
def interval_union(g, t):
    return _flat(_order_sets(t).select("k", F.expr(f"CAST({iv.union_all_sql('sets')} AS {iv.VALIDITY})").alias("v")))


@graph_query(
    f"SELECT o_orderkey AS k, 'Calendar' AS axis, CAST(greatest({_O}, {_A}) AS DOUBLE) AS lo, {_O} > {_A} AS lo_inc, CAST(least({_O} + 30, {_Z}) AS DOUBLE) AS hi, false AS hi_inc FROM orders WHERE {_O} < {_Z} AND {_O} + 30 > {_A}"
)
def interval_intersect(g, t):
    window = iv.IntervalSet([iv.Interval.of("Calendar", _A, _Z, False, False)]).sql()
    df = t("orders").selectExpr("o_orderkey AS k", f"{_OPEN} AS a", f"{window} AS b")
    return _flat(df.select("k", F.expr(f"CAST({iv.intersect_sql('a', 'b')} AS {iv.VALIDITY})").alias("v")))


@graph_query(
    f"""SELECT o_orderkey AS k, 'Calendar' AS axis, CAST({_O} AS DOUBLE) AS lo, true AS lo_inc, CAST(least({_O} + 30, {_A}) AS DOUBLE) AS hi, false AS hi_inc FROM orders WHERE {_O} < {_A}
    UNION ALL SELECT o_orderkey, 'Calendar', CAST(greatest({_O}, {_Z}) AS DOUBLE), true, CAST({_O} + 30 AS DOUBLE), false FROM orders WHERE {_O} + 30 > {_Z}"""
)
def interval_subtract(g, t):
    window = iv.IntervalSet([iv.Interval.of("Calendar", _A, _Z, True, False)]).sql()
    df = t("orders").selectExpr("o_orderkey AS k", f"{_OPEN} AS a", f"{window} AS b")
    return _flat(df.select("k", F.expr(f"CAST({iv.subtract_sql('a', 'b')} AS {iv.VALIDITY})").alias("v")))


@graph_query(
    f"""SELECT o_orderkey AS k, CAST(count(*) AS BIGINT) AS days FROM (SELECT o_orderkey, unnest(range({_O}, {_O} + 121)) AS d FROM orders) x
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_L} <= d AND d <= {_L} + 30) GROUP BY o_orderkey"""
)
def fallback_property(g, t):
    """A fallback value holds on the days that no timed value of the same owner and path covers."""
    base = g.nodes.where("type_id = 'SalesOrder'").selectExpr("id AS owner", "'open' AS path", "valid", "true AS fallback")
    timed = g.rels.where("type_id = 'hasLine'").selectExpr("src AS owner", "'open' AS path", "valid", "false AS fallback")
    out = ops.resolve_fallbacks(base.unionByName(timed), g.axes).where("fallback")
    days = "aggregate(valid.ivs, 0L, (a, i) -> a + (i.hi.w + i.hi.s) - (i.lo.w + i.lo.s))"
    return out.selectExpr("CAST(substring(owner, 7) AS BIGINT) AS k", f"{days} AS days").where("days > 0")


# catalogs, checks, listings


_ABOVE = {"customer": ("Customer", "Party"), "supplier": ("Supplier", "Party"), "nation": ("Nation", "Place"), "region": ("Region", "Place"), "part": ("Part",), "orders": ("SalesOrder",), "documents": ("Document",), "events": ("User",)}


@graph_query(" UNION ".join(f"SELECT '{t}' AS type, '{a}' AS ancestor FROM {table}" for table, (t, *up) in _ABOVE.items() for a in (*up, "Thing")))
def ancestors(g, t):
    """The types above that of each node."""
    return g.nodes.select(F.col("type_id").alias("type"), F.explode("types").alias("ancestor")).where("type <> ancestor").distinct()


@graph_query("SELECT 'line' AS kind, concat_ws('-', l_orderkey, l_linenumber) AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_ids(g, t):
    return ops.duplicate_ids(t("lineitem").selectExpr("'line' AS kind", "concat_ws('-', l_orderkey, l_linenumber) AS id"))


@graph_query("SELECT concat_ws('-', l_orderkey, l_linenumber) AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1")
def without_duplicates(g, t):
    return ops.without_duplicates(t("lineitem").selectExpr("'line' AS kind", "concat_ws('-', l_orderkey, l_linenumber) AS id")).select("id")


@graph_query(
    """WITH gone AS (SELECT p_partkey AS k FROM part WHERE p_size > 45)
    SELECT concat_ws('-', 'line', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS rel_id, 'dst' AS "end" FROM lineitem JOIN gone ON l_partkey = k
    UNION ALL SELECT DISTINCT concat_ws('-', 'suppliedBy', l_partkey, l_suppkey), 'src' FROM lineitem JOIN gone ON l_partkey = k"""
)
def dangling_refs(g, t):
    """Relations of parts, where the large ones are no nodes."""
    return ops.dangling(replace(g, nodes=g.nodes.where("type_id <> 'Part' OR own.size.i <= 45")))


@graph_query("SELECT 'user:' || user_id AS ref, CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE 'ok' END AS outcome FROM events LEFT JOIN customer ON c_custkey = user_id")
def references(g, t):
    items = t("customer").selectExpr("concat('user:', c_custkey) AS id", "'Customer' AS kind")
    return ops.references(t("events").selectExpr("concat('user:', user_id) AS ref"), items, "Customer")


@graph_query("SELECT 'inNation-s' || s_suppkey AS rel_id, 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM supplier")
def endpoint_errors(g, t):
    """Suppliers, where only customers are said to be in nations."""
    narrow = replace(g, endpoints={"inNation": (("Customer",), ("Nation",))})
    return ops.endpoint_errors(narrow, "inNation")


@graph_query("SELECT user_id AS k, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) x WHERE n = 1")
def last_per(g, t):
    return ops.last_per(t("events").selectExpr("user_id AS k", "event_type AS state", "ts"), ["k"], "ts").select("k", "state")


@graph_query("SELECT 'nation:' || n_nationkey AS src, 'nation:' || n_nationkey AS title, 'inRegion-' || n_nationkey AS rel_id, 'Anytime' AS validity FROM nation WHERE n_regionkey = 1")
def backlinks(g, t):
    return ops.backlinks(g, "region:1", "inRegion")[0]


@graph_query("SELECT 'in' AS direction, 'inNation-c' || c_custkey AS rel_id, 'inNation' AS type_id, 'customer:' || c_custkey AS other FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'in', 'inNation-s' || s_suppkey, 'inNation', 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'out', 'inRegion-3', 'inRegion', 'region:' || n_regionkey FROM nation WHERE n_nationkey = 3")
def links(g, t):
    return ops.links(g, "nation:3", "both", "located")


@graph_query(
    """SELECT 'Node' AS kind, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) + (SELECT count(DISTINCT user_id) FROM events) AS n
    UNION ALL SELECT 'Relation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
    UNION ALL SELECT 'Property', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM supplier) + 4 * (SELECT count(*) FROM part) + 3 * (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) + 2 * (SELECT count(*) FROM events) + 3 * (SELECT count(*) FROM lineitem)
    UNION ALL SELECT 'Text', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM part) + 2 * (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM documents)"""
)
def stats(g, t):
    return ops.stats(g)


@graph_query(f"SELECT 'order:' || o_orderkey AS id, CASE WHEN {_O} <= {_A} AND {_A} <= {_O} + 120 THEN 'Full' ELSE 'Hidden' END AS visibility FROM orders")
def visibility(g, t):
    return ops.visible_at(g.nodes.where("type_id = 'SalesOrder'"), "Calendar", _A).select("id", "visibility")


@graph_query("SELECT o_orderkey AS k, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders")
def calendar_daynumber(g, t):
    return t("orders").selectExpr("o_orderkey AS k", f"CAST({calendar.day_sql('o_orderdate')} AS BIGINT) AS day")


_STEPS = (temporal.Mapping("A", "B", Fraction(1, 2)), temporal.Mapping("C", "B", Fraction(-4), Fraction(1000)))
_CUTS = temporal.Mapping("Days", "Shifts", segments=(
    temporal.Segment((Fraction(0), Fraction(40)), (Fraction(100), Fraction(120))), temporal.Segment((Fraction(60), Fraction(100)), (Fraction(120), Fraction(100))),
    temporal.Segment((Fraction(90), Fraction(100)), (Fraction(0), Fraction(10))),
))


@graph_query("SELECT o_orderkey AS k, (CAST(o_totalprice AS DOUBLE) / 2 - 1000) / -4 AS at FROM orders")
def convert_affine(g, t):
    """Over two maps, the second against its direction."""
    return t("orders").selectExpr("o_orderkey AS k", f"{temporal.line_sql('o_totalprice', _STEPS, 'A', 'C')} AS at")


@graph_query(
    """SELECT o_orderkey AS k, v AS at FROM (SELECT o_orderkey, unnest(list_distinct([CASE WHEN x <= 40 THEN 100 + x / 2 END, CASE WHEN x >= 60 THEN 150 - x / 2 END, CASE WHEN x >= 90 THEN x - 90 END])) AS v
    FROM (SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) AS x FROM orders)) WHERE v IS NOT NULL"""
)
def convert_segments(g, t):
    """Segments with a gap, one that falls and one that overlaps it."""
    rows = t("orders").selectExpr("o_orderkey AS k", "CAST(o_orderkey % 101 AS DOUBLE) AS x")
    return rows.select("k", F.explode(F.expr(temporal.images_sql("x", _CUTS))).alias("at"))


@graph_query(
    f"""SELECT 'order:' || o_orderkey AS id, CASE WHEN {_O} <= {_A} AND {_A} <= {_O} + 120 THEN 'Full' WHEN {_O} <= {_A} OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_L} <= {_A} AND {_A} <= {_L} + 30) THEN 'AssertionOnly' ELSE 'Hidden' END AS visibility FROM orders"""
)
def view(g, t):
    """Orders in a window; one that is over is still the end of a relation."""
    shown = ops.view(g, iv.IntervalSet([iv.Interval.of("Calendar", _A, _A)]))
    return shown.where("startswith(id, 'order:')")


_SEEN = f"""(SELECT {_O} <= {_A} AND {_A} <= {_O} + 120 AS whole, {_O} <= {_A} OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_L} <= {_A} AND {_A} <= {_L} + 30) AS said FROM orders)"""


@graph_query(
    f"""SELECT 'node' AS what, (SELECT count(*) FROM {_SEEN} WHERE whole OR said) AS n UNION ALL SELECT 'full', (SELECT count(*) FROM {_SEEN} WHERE whole)
    UNION ALL SELECT 'assertion-only', (SELECT count(*) FROM {_SEEN} WHERE said AND NOT whole) UNION ALL SELECT unnest(['media', 'link', 'node-type', 'rel-type', 'timeline', 'warnings', 'errors']), 0"""
)
def summary(g, t):
    """Orders by how they are seen in a window."""
    return inspect.summary(g, types=("SalesOrder",), window=iv.IntervalSet([iv.Interval.of("Calendar", _A, _A)]))


@graph_query(
    "SELECT 'Node' AS kind, 'Place' AS type_id, 0 AS n WHERE false UNION ALL SELECT 'Node', 'Region', count(*) FROM region UNION ALL SELECT 'Node', 'Nation', count(*) FROM nation UNION ALL SELECT 'Link', 'inRegion', count(*) FROM nation"
)
def inventory(g, t):
    """Nodes of a type and those below it, and links."""
    return inspect.inventory(g, types=("Place", "inRegion")).groupBy("kind", "type_id").agg(F.count(F.lit(1)).alias("n"))


# documents made of the parts: ingestion, values of all kinds, yearly times

def parts_graph(spark: SparkSession, sf_dir: str):
    """A graph of documents, one for each part, with a yearly time, a list, a text, a number that may be null, and a link to
    the next part."""
    heads = {
        "Almanac": "kind: Timeline\ncoordinate: gregorian", "Season": "kind: Timeline\nsameAxisAs: Almanac\ncoordinate:\n  kind: calendar-pattern\n  fields: [month, day]\n  repeatsEvery: year",
        "Item": "kind: NodeType\nprops:\n  label: {type: string}\n  size: {type: number}\n  marks: {type: array, items: {type: string}}\n  note: {type: text}", "next": "kind: RelType\nsources: [Item]\ntargets: [Item]",
    }
    fixed = spark.createDataFrame([(f"{k}.md", f"---\nid: {k}\n{v}\n---\n") for k, v in heads.items()], "path string, text string")
    day = "concat(lpad(p_partkey % 12 + 1, 2, '0'), '-', lpad(p_partkey % 28 + 1, 2, '0'))"
    text = f"""concat('---\\nid: i', p_partkey, '\\ntype: Item\\nvalidTime: [{{timeline: Season, from: ', {day}, '}}]\\nprops:\\n  label: ', p_name, '\\n  size: ', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END,
      '\\n  marks: ["', p_brand, '", "', p_type, '"]\\n  note: ', p_type, ' goods\\n---\\n# Item ', p_partkey, '\\n\\nSee @link{{}}[the next](i', p_partkey + 1, ' next).\\n')"""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('i', p_partkey, '.md') AS path", f"{text} AS text")
    return markdown.load(fixed.unionByName(parts))


def ingested(name: str, query: str, sql: str, **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: _flat(rows_of(parts_graph(spark, sf_dir)[0], query, params))
    ORACLES[name] = sql


_ITEMS = "SELECT 'i' || p_partkey AS id FROM part"
ingested("is_null", "MATCH (p:Item) WHERE p.size IS NULL RETURN ID(p) AS id", f"{_ITEMS} WHERE p_size % 5 = 0")
ingested("contains_element", "MATCH (p:Item) WHERE p.marks CONTAINS 'Brand#3' RETURN ID(p) AS id", f"{_ITEMS} WHERE p_brand = 'Brand#3'")
ingested("in_property", "MATCH (p:Item) WHERE $mark IN p.marks AND NOT p.size IS NULL RETURN ID(p) AS id", f"{_ITEMS} WHERE p_type = 'ECONOMY' AND p_size % 5 <> 0", mark="ECONOMY")
ingested("equal_arrays", "MATCH (p:Item) WHERE p.marks = $marks RETURN ID(p) AS id", f"{_ITEMS} WHERE p_brand = 'Brand#1' AND p_type = 'ECONOMY'", marks=["Brand#1", "ECONOMY"])
ingested("unequal_objects", "MATCH (p:Item) WHERE p.note != $note RETURN ID(p) AS id", f"{_ITEMS} WHERE p_type <> 'ECONOMY'", note={"default": "ECONOMY goods"})
ingested(
    "recurrence_window", 'MATCH (p:Item) VALID ON Season OVERLAPS ["02-25", "03-04"] WITHIN ["1999-03-02", "2001-01-01") RETURN ID(p) AS id',
    f"{_ITEMS} WHERE EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(DATE '1999-03-02', DATE '2000-12-31', INTERVAL 1 DAY))::DATE AS d) WHERE month(d) = p_partkey % 12 + 1 AND day(d) = p_partkey % 28 + 1 AND (month(d) = 2 AND day(d) >= 25 OR month(d) = 3 AND day(d) <= 4))",
)


def _documents(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = lambda spark, sf_dir: f(*parts_graph(spark, sf_dir)), sql
        return f

    return add


@_documents("ingested_rels", "SELECT 'i' || p_partkey AS src, 'i' || (p_partkey + 1) AS dst, 'the next' AS label FROM part")
def ingested_rels(g, problems):
    return g.rels.select("src", "dst", "label")


@_documents("ingested_texts", "SELECT 'i' || p_partkey AS owner, 'TITLE' AS kind, 'Item ' || p_partkey AS text FROM part UNION ALL SELECT 'i' || p_partkey, 'PARAGRAPH', 'See the next.' FROM part")
def ingested_texts(g, problems):
    return g.texts.where("kind IN ('TITLE', 'PARAGRAPH')").select("owner", "kind", "text")


@_documents("ingested_diagnostics", "SELECT 'i' || max(p_partkey) || '.md' AS path, 'warning' AS severity, 'ReferenceError' AS category FROM part")
def ingested_diagnostics(g, problems):
    """The last part's link leads to no node."""
    return problems.select("path", "severity", "category")


@_documents("postings", "SELECT 'red' AS term, count(*) AS texts FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def postings_query(g, problems):
    rows, _, _ = postings.build(g.texts.where("kind = 'PROPERTY_VALUE' AND path = 'label'"))
    return rows.where("term = 'red'").groupBy("term").agg(F.count(F.lit(1)).alias("texts"))


# bundles: times by buckets, phrases by places

_KEPT: dict[tuple, str] = {}


def kept_graph(spark: SparkSession, sf_dir: str, index: tuple[str, ...] = ()):
    """Orders, their lines and the documents of the sales graph, as a bundle that was written and is read back; once a session.

    index: the index tables that a query looks into; each is made when the first query needs it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        g = sales_graph(spark, sf_dir)
        some = replace(
            g, nodes=g.nodes.where("type_id IN ('SalesOrder', 'Part', 'Document')"), rels=g.rels.where("type_id = 'hasLine'"),
            props=g.props.where("path = 'totalprice'"), texts=g.texts.where("kind = 'PARAGRAPH'"),
        )
        folder = f"{bundle.scratch(spark)}/kept"
        bundle.write(some, folder, index=False)
        _KEPT[key] = folder
    if index:
        bundle.add_index(spark, _KEPT[key], index)
    return bundle.read(spark, _KEPT[key], check=False)


def bundled(name: str, query: str, sql: str, index: tuple[str, ...] = (), **params) -> None:
    """Registers a query of the pattern language over the bundle."""
    QUERIES[name] = lambda spark, sf_dir: _flat(rows_of(kept_graph(spark, sf_dir, index), query, params))
    ORACLES[name] = sql


bundled("bundle_at", 'MATCH (o:SalesOrder) VALID ON Calendar AT "1997-03-01" RETURN ID(o) AS id', f"{_ORDERS} WHERE {_O} <= {_A} AND {_A} <= {_O} + 120")
bundled(
    "bundle_overlaps", 'MATCH (o:SalesOrder)-[l:hasLine]->(p:Part) WHERE o.totalprice > 200000.0 VALID ON Calendar OVERLAPS ["1997-03-01", "1997-06-15") RETURN ID(o) AS o, ID(p) AS p, MATCHED_VALIDITY() AS v',
    f"SELECT 'order:' || o_orderkey AS o, 'part:' || l_partkey AS p, 'Calendar' AS axis, CAST(greatest({_O}, {_L}, {_A}) AS DOUBLE) AS lo, true AS lo_inc, CAST(least({_O} + 120, {_L} + 30, {_Z}) AS DOUBLE) AS hi, least({_O} + 120, {_L} + 30) < {_Z} AS hi_inc FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 200000 AND greatest({_O}, {_L}) <= least({_O} + 120, {_L} + 30) AND greatest({_O}, {_L}) < {_Z} AND {_A} <= least({_O} + 120, {_L} + 30)",
)
bundled("bundle_contains", 'MATCH (o:SalesOrder) VALID ON Calendar CONTAINS ["1997-03-01", "1997-06-15"] RETURN ID(o) AS id', f"{_ORDERS} WHERE {_O} <= {_A} AND {_Z} <= {_O} + 120")


def bundle_structured_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = st.GraphQuery(st.Nodes(type="SalesOrder"), st.Property("totalprice", "GREATER_THAN", 300000.0), st.Window("Calendar", "1997-03-01", "1997-06-15", True), limit=None)
    return st.run(kept_graph(spark, sf_dir), q).rows.selectExpr("root AS id")


QUERIES["bundle_structured_window"] = bundle_structured_window
ORACLES["bundle_structured_window"] = f"{_ORDERS} WHERE o_totalprice > 300000 AND {_O} <= {_Z} AND {_A} <= {_O} + 120"

_PHRASES = "FROM documents WHERE contains(lower(text), '{}')"
for _name, _phrase in (("bundle_phrase", "the erst"), ("bundle_phrase_signs", "ed. th"), ("bundle_phrase_part", "heron"), ("bundle_phrase_long", "en the an")):
    bundled(_name, f'MATCH (d:Document) WHERE FULLTEXT(d.body, $words) RETURN ID(d) AS id, SCORE() AS score', f"SELECT 'document:' || doc_id AS id, CAST(1 AS DOUBLE) AS score {_PHRASES.format(_phrase)}", ("words",), words=f'"{_phrase}"')


# documents with mistakes, and arrays in front matter and body

_TYPES = {
    "Item": "kind: NodeType\nprops:\n  label: {type: string}\n  size: {type: number}\n  grade: {type: string, enum: [A, B]}\n  marks: {type: array, items: {type: string}}",
    "next": "kind: RelType\nsources: [Item]\ntargets: [Item]", "Count": "kind: Timeline",
}


def _item_documents(spark: SparkSession, sf_dir: str, lines: str, body: str, also: str = "") -> DataFrame:
    """A document for each part: SQL for the rest of its front matter and for its body; also: SQL for more rows (path, text)."""
    fixed = spark.createDataFrame([(f"{k}.md", f"---\nid: {k}\n{v}\n---\n") for k, v in _TYPES.items()], "path string, text string")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("text", F.expr(_item_text(lines, body)))
    out = fixed.unionByName(parts.selectExpr("'i' || p_partkey || '.md' AS path", "text"))
    return out.unionByName(parts.where(also).selectExpr("'copy' || p_partkey || '.md' AS path", "text")) if also else out


def _item_text(lines: str, body: str) -> str:
    """SQL of both engines for a part's document."""
    return f"('---' || chr(10) || 'id: i' || p_partkey || chr(10) || 'type: Item' || chr(10) || 'props:' || chr(10) || '  label: ' || p_name || chr(10) || {lines} || chr(10) || '---' || chr(10) || '# Item' || chr(10) || {body} || chr(10))"


_FAULTS = """(CASE p_partkey % 6 WHEN 0 THEN '  colour: red' WHEN 1 THEN '  size: big' WHEN 3 THEN '  grade: C' WHEN 4 THEN '  marks: ["a", "b"' ELSE '  size: 1' END)"""
_FAULTY_BODY = "(CASE WHEN p_partkey % 6 = 2 THEN 'See @link{}[it](gone' || p_partkey || ' next).' ELSE 'Text.' END)"
_NEEDLE = """(CASE p_partkey % 6 WHEN 0 THEN 'colour' WHEN 1 THEN 'big' WHEN 2 THEN 'gone' || p_partkey WHEN 3 THEN 'C' WHEN 4 THEN '["a", "b"' ELSE 'i' || p_partkey END)"""
_BEFORE = """(CASE p_partkey % 6 WHEN 3 THEN 'grade: ' WHEN 5 THEN 'id: ' ELSE '' END)"""


def ingested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mistake of each category, and the stretch of its document that it is about."""
    g, problems = markdown.load(_item_documents(spark, sf_dir, _FAULTS, _FAULTY_BODY, "p_partkey % 6 = 5"))
    return problems.select("path", "category", "line", F.col("start").alias("begin"), F.col("end").alias("finish"))


QUERIES["ingested_ranges"] = ingested_ranges
ORACLES["ingested_ranges"] = f"""
WITH d AS (SELECT p_partkey, {_item_text(_FAULTS, _FAULTY_BODY)} AS text, {_NEEDLE} AS needle, {_BEFORE} AS lead FROM part),
r AS (SELECT *, strpos(text, lead || needle) - 1 + length(lead) AS a FROM d)
SELECT unnest(CASE WHEN p_partkey % 6 = 5 THEN ['i', 'copy'] ELSE ['i'] END) || p_partkey || '.md' AS path,
  ['SchemaError', 'TypeError', 'ReferenceError', 'ConstraintError', 'SyntaxError', 'DuplicateId'][p_partkey % 6 + 1] AS category,
  CAST(length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')) + 1 AS INTEGER) AS line, CAST(a AS INTEGER) AS "begin", CAST(a + length(needle) AS INTEGER) AS finish FROM r
"""

_MARKS = "('  marks: [\"' || p_brand || '\", {value: old, validTime: [{timeline: Count, from: 1, to: 2}]}, {value: keep, validTime: [{timeline: Count, from: 5, to: 6}]}]')"
_MORE = "(CASE p_partkey % 3 WHEN 0 THEN 'Text.' WHEN 1 THEN '@props{marks=[\"' || p_type || '\"]}' ELSE '@props{marks=[{value=\"' || p_type || '\", validTime=[{timeline=Count, to=2, from=1}]}]}' END)"


def ingested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the body take the place of those with the same times."""
    g, _ = markdown.load(_item_documents(spark, sf_dir, _MARKS, _MORE))
    return g.props.where("startswith(path, 'marks.')").selectExpr("owner AS id", "path", "value.s AS value", "CASE WHEN NOT valid.universal THEN valid.ivs[0].lo.w END AS since")


QUERIES["ingested_arrays"] = ingested_arrays
ORACLES["ingested_arrays"] = """
SELECT 'i' || p_partkey AS id, 'marks.' || i AS path, [CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE p_brand END, CASE WHEN p_partkey % 3 = 2 THEN p_type ELSE 'old' END, 'keep'][i + 1] AS value,
  [NULL, 1, 5][i + 1]::BIGINT AS since FROM part, (SELECT unnest([0, 1, 2]) AS i)
"""


def yearly_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a week of every year, in a window with a year of 53 weeks."""
    fixed = {
        "Almanac": "kind: Timeline\ncoordinate: gregorian", "Weeks": "kind: Timeline\nsameAxisAs: Almanac\ncoordinate:\n  kind: calendar-pattern\n  fields: [week]\n  repeatsEvery: year", "Item": "kind: NodeType",
    }
    types = spark.createDataFrame([(f"{k}.md", f"---\nid: {k}\n{v}\n---\n") for k, v in fixed.items()], "path string, text string")
    text = "concat('---\nid: i', p_partkey, '\ntype: Item\nvalidTime: [{timeline: Weeks, from: W', lpad(p_partkey % 53 + 1, 2, '0'), '}]\n---\n')"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('i', p_partkey, '.md') AS path", f"{text} AS text")
    query = 'MATCH (p:Item) VALID ON Weeks OVERLAPS ["W51", "W02"] WITHIN ["1998-03-02", "1999-12-22") RETURN ID(p) AS id, MATCHED_VALIDITY() AS v'
    return _flat(rows_of(markdown.load(types.unionByName(parts))[0], query))


QUERIES["yearly_weeks"] = yearly_weeks
ORACLES["yearly_weeks"] = f"""
WITH d AS (SELECT unnest(generate_series(DATE '1998-03-02', DATE '1999-12-21', INTERVAL 1 DAY))::DATE AS d),
w AS (SELECT isoyear(d) AS y, week(d) AS w, min({_DAY.format("d")}) AS lo, max({_DAY.format("d")}) AS hi FROM d WHERE week(d) >= 51 OR week(d) <= 2 GROUP BY ALL)
SELECT 'i' || p_partkey AS id, 'Almanac' AS axis, CAST(lo AS DOUBLE) AS lo, true AS lo_inc, CAST(hi + 1 AS DOUBLE) AS hi, false AS hi_inc FROM part JOIN w ON w.w = p_partkey % 53 + 1
"""


def flagship(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    query = 'MATCH (c:Customer)-[:placed]->(o:SalesOrder) WHERE o.totalprice >= $least VALID ON Calendar AT "1998-06-01" RETURN ID(c) AS id, ID(o) AS order_id ORDER BY id, order_id'
    return rows_of(sales_graph(spark, sf_dir), query + (f" LIMIT {limit}" if limit else ""), {"least": 1000.0})


QUERIES["flagship"] = flagship
ORACLES["flagship"] = (
    f"SELECT 'customer:' || o_custkey AS id, 'order:' || o_orderkey AS order_id FROM orders WHERE o_totalprice >= 1000 AND {_O} <= {calendar.day_number('1998-06-01')} AND {calendar.day_number('1998-06-01')} <= {_O} + 120"
)
