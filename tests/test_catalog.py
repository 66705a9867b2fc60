"""Registered queries against DuckDB on the small tables, and what their plans must not hold."""

from __future__ import annotations

import duckdb
import pytest

from tessella.plans import catalog
from tessella.plans.planner import rows_of
from tessella.sources.tables import sales_graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def clean(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert clean(df.select(*[f"`{n}`" for n in names]).collect()) == clean(want.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    g = sales_graph(spark, SF)
    text = plan(rows_of(g, "MATCH (c:Customer)-[:placed]->(o:SalesOrder) WHERE o.totalprice > 1000.0 RETURN ID(c) AS c"))
    physical = text[text.index("== Physical Plan =="):]
    assert "Python" not in physical and "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    # only the tables that the types and paths need are read
    assert "lineitem" not in physical and "supplier" not in physical and "part.parquet" not in physical
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in physical


@pytest.mark.parametrize("query", [
    "MATCH (c:Customer), (o:SalesOrder), (c)-[:placed]->(o) RETURN ID(c) AS c, ID(o) AS o",
    "MATCH (o:SalesOrder), (n:Nation), (c)-[:inNation]->(n), (c:Customer)-[:placed]->(o) RETURN ID(c) AS c, ID(n) AS n",
    "MATCH (c:Customer)-[r:placed]->(o), (x)-[r]->(y) RETURN ID(x) AS x, ID(y) AS y",
    "MATCH (r:Region), (p)-[:suppliedBy]->(s)-[:inNation]->(n)-[:inRegion]->(r), (p:Part) RETURN ID(p) AS p, ID(r) AS r",
])
def test_connected_patterns_need_no_nested_loop(spark, query):
    text = plan(rows_of(sales_graph(spark, SF), query))
    physical = text[text.index("== Physical Plan =="):]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical and "Cross" not in physical


def test_order_of_patterns(spark):
    """The node of which most is known comes first, then what hangs on it; parts without a common variable meet last."""
    from tessella.plans import planner

    def order(query):
        p = planner.Plan(sales_graph(spark, SF), planner.S.parse(query), {}, "REFERENCE")
        p.plan_conditions() if p.q.where is not None else None
        return [[[x.var for x in half[::2]] for half in p.joinable(g)] for g in planner.connected(p.q.patterns)]

    assert order("MATCH (c:Customer), (o:SalesOrder), (c)-[:placed]->(o) WHERE o.totalprice > 5.0 RETURN ID(c) AS c") == [[["o"], ["o", "c"], ["c"]]]
    assert order("MATCH (c:Customer)-[:placed]->(o:SalesOrder) RETURN ID(c) AS c") == [[["c", "o"]]]
    assert order("MATCH (p)-[:suppliedBy]->(s)-[:inNation]->(n) WHERE ID(s) = 'supplier:1' RETURN ID(p) AS p") == [[["s", "n"], ["s", "p"]]]
    assert order("MATCH (a:Region), (n:Nation)-[:inRegion]->(r), (b:Supplier)-[:inNation]->(n), (c:Part) RETURN ID(a) AS a") == [[["a"]], [["n", "r"], ["n", "b"]], [["c"]]]


def test_mistakes_in_patterns_come_in_written_order(spark):
    from tessella.plans.planner import run

    g = sales_graph(spark, SF)
    code = lambda q: run(g, q).diagnostics[0].code
    assert code("MATCH (a:Nothing), (b:SalesOrder)-[:nothing]->(c) RETURN ID(a) AS a") == "GMQL2001"
    assert code("MATCH (b:SalesOrder)-[:nothing]->(c), (a:Nothing) RETURN ID(a) AS a") == "GMQL2002"
    assert code("MATCH (b)-[b:placed]->(c) RETURN ID(c) AS c") == "GMQL2003"
    assert code("MATCH (a:Region), (b:SalesOrder)-[:inNation]->(c) RETURN ID(a) AS a") == "GMQL3005"


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("predicate_ge", "GreaterThanOrEqual(c_acctbal,9000.0)"), ("predicate_eq", "EqualTo(c_mktsegment,MACHINERY)"), ("predicate_starts_ends", "StringStartsWith(c_name,Customer#0000001)"),
        ("predicate_in", "c_mktsegment"), ("flagship", "GreaterThanOrEqual(o_totalprice,1000.0)"), ("scan_id", "EqualTo(o_orderkey,7)"), ("links", "EqualTo(c_nationkey,3)"),
        ("structured_and", "GreaterThan(c_acctbal,9000.0)"), ("join_shared_variable", "GreaterThanOrEqual(l_quantity,50.0)"),
    ],
)
def test_conditions_reach_the_scan(spark, name, pushed):
    text = plan(catalog.QUERIES[name](spark, SF))
    found = [x for x in text[text.index("== Physical Plan =="):].split("PushedFilters: [")[1:]]
    assert any(pushed in x.split("ReadSchema")[0] for x in found)


def test_conditions_need_no_join(spark):
    """A condition on an entity's own value filters its rows; no table of properties is read."""
    text = plan(catalog.QUERIES["predicate_ge"](spark, SF))
    physical = text[text.index("== Physical Plan =="):]
    assert "Join" not in physical and "Exchange" not in physical


def test_what_a_binding_used(spark):
    """The assertions behind a row: the relation, and its property with the time in which it holds."""
    from tessella.plans import structured as st

    line = st.Relation("hasLine", properties=(st.Property("quantity", "GREATER_THAN", 40.0),), variable="p")
    rows = st.run(sales_graph(spark, SF), st.GraphQuery(st.Nodes(type="SalesOrder"), line, limit=None)).rows.collect()
    assert rows
    for r in rows:
        lines = {x for x in r["matched"] if x.startswith("line-") and "#" not in x}
        assert lines and {x.split("#")[0] for x in r["matched"] if "#quantity#Calendar: [" in x} == lines
