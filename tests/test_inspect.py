"""Listings, forms and commands."""

from __future__ import annotations

import io
import json

import pytest

from tessella import cli
from tessella.operators import inspect
from tests.test_markdown import SOUND, ids, railway  # noqa: F401


def test_listings(railway):  # noqa: F811
    g, problems = railway
    assert [tuple(r)[:4] for r in inspect.listing(g).collect()] == [("Node", "harbour", "Stop", "Harbour Street"), ("Node", "mill", "Stop", "Mill Halt"), ("Node", "shed", "Stop", "shed")]
    assert [r["id"] for r in inspect.listing(g, at=("Works", 91)).collect()] == ["shed"] and inspect.listing(g, type_id="Site", subtypes=False).count() == 0
    assert inspect.show(g, "harbour")[1] == "ok" and inspect.show(g, "nowhere")[1] == "unknown"
    assert [r["value"] for r in inspect.properties(g, "harbour", ("Works", 80)).where("path = 'tracks'").collect()] == ["6.0"]
    assert inspect.lint(problems)[1] == 1
    assert inspect.metadata(g) == {"nodeTypes": ["Site", "Stop"], "relationTypes": ["trackTo"], "timelines": ["Civil", "Works"]}


def test_inventory(railway):  # noqa: F811
    """Everything by kind, id and source; with types or a window, what has times."""
    from tessella.functions.intervals import Interval, IntervalSet

    g, problems = railway
    rows = [(r["kind"], r["id"]) for r in inspect.inventory(g).collect()]
    assert [k for k, _ in rows] == sorted((k for k, _ in rows), key=inspect.KIND_ORDER.index) and rows[:3] == [("Node", "harbour"), ("Node", "mill"), ("Node", "shed")]
    assert {("NodeType", "Site"), ("NodeType", "Stop"), ("RelType", "trackTo"), ("Timeline", "Works"), ("Timeline", "Civil")} <= set(rows)
    assert sum(k == "Link" for k, _ in rows) == g.rels.count()
    assert {r["kind"] for r in inspect.inventory(g, types=("Site", "trackTo")).collect()} == {"Node", "Link"} and inspect.inventory(g, types=("Site",), subtypes=False).count() == 0
    late = IntervalSet([Interval.of("Works", 99, 99)])
    assert [(r["id"], r["visibility"]) for r in inspect.inventory(g, ("Node", "Link"), window=late).where("kind = 'Node'").collect()] == [("shed", "Full")]
    counts = {r["what"]: r["n"] for r in inspect.summary(g, problems, ("Node", "Timeline")).collect()}
    assert list(counts) == [*inspect.KIND_NAMES, "warnings", "errors", "full", "assertion-only"]
    assert (counts["node"], counts["timeline"], counts["link"], counts["full"]) == (3, 2, 0, 3)
    assert counts["errors"] == problems.where("severity = 'error'").count() and counts["warnings"] == problems.where("severity = 'warning'").count()
    places = [(r["path"], r["start"]) for r in inspect.lint(problems)[0].collect()]
    assert places == sorted(places)
    assert inspect.kind_of("rel_type") == inspect.kind_of("RelType") == inspect.kind_of("rel-type") == "RelType"
    with pytest.raises(inspect.QueryError):
        inspect.kind_of("edge")


def test_view(railway):  # noqa: F811
    """A node that is over is still seen where something is said of it; an unknown end of a relation is too."""
    from tessella.functions.intervals import Interval, IntervalSet
    from tessella.operators.graph import view

    at = lambda x: {r["id"]: r["visibility"] for r in view(railway[0], IntervalSet([Interval.of("Works", x, x)])).collect()}
    assert at(50) == {"harbour": "Full", "mill": "Full", "shed": "Full", "nowhere": "AssertionOnly"}
    assert at(99) == {"harbour": "Hidden", "mill": "Hidden", "shed": "Full", "nowhere": "AssertionOnly"}


def test_forms(railway):  # noqa: F811
    g, _ = railway
    assert ids(g, inspect.node_form("Stop", "港の駅", (("tracks", ">=", 6),), "Works", 80)) == ["harbour"]
    assert ids(g, inspect.link_form("trackTo", target="mill")) == ["harbour"] and ids(g, inspect.link_form("trackTo", source="mill", direction="in")) == ["mill"]
    assert inspect.name("Order") == "`Order`" and inspect.name("Stop") == "Stop"


@pytest.mark.parametrize(("text", "want"), [("null", None), ("true", True), ("12", 12), ("-1.5", -1.5), ('"12"', "12"), ("abc", "abc"), ("1/3", "1/3")])
def test_parameter(text, want):
    assert cli.parameter(text) == want


def test_commands(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in SOUND.items():
        (docs / name).write_text(text)
    (docs / "page.md").write_text("---\nid: page\ntype: Stop\n---\n::: embed:back-link=trackTo\n:::\n")

    def call(*args):
        out = io.StringIO()
        return cli.main(list(args), spark, out), out.getvalue()

    code, text = call("search", "MATCH (s:Stop) WHERE s.tracks >= $least VALID ON Works AT 50 RETURN ID(s) AS id", str(docs), "--param", "least=3", "--json")
    assert code == 0 and json.loads(text) == {"id": "mill"}
    assert call("search", "MATCH (s:Port) RETURN s", str(docs))[0] == 1
    assert call("lint", str(docs))[0] == 0
    assert call("links", "mill", str(docs), "--direction", "in")[1].startswith("in\tharbour@")
    assert call("links", "mill", str(docs), "--direction", "in", "--valid-time", "Works:71..")[1] == ""
    assert [x.split("\t")[1] for x in call("list", str(docs), "--kind", "Node", "--valid-time", "Works:95")[1].splitlines()] == ["page"]
    assert "owner" in call("props", "mill", str(docs), "--valid-time", "Works:..50")[1] and "owner" not in call("props", "mill", str(docs), "--valid-time", "Works:60")[1]
    assert call("list", str(docs), "--valid-time", "Works:9..3")[0] == 1
    assert call("embed", str(docs))[0] == 0 and "| src |" in (docs / "page.md").read_text()
    assert call("index", str(docs), "--output", str(tmp_path / "b"))[0] == 0
    assert "harbour" in call("list", "--index", str(tmp_path / "b"), "--type", "Stop")[1]
    assert call("list", str(docs), "--kind", "timeline", "--kind", "rel-type")[1].count("\n") == 3 and call("list", str(docs), "--kind", "edge")[0] == 1
    lines = dict(x.split("\t") for x in call("stats", str(docs))[1].splitlines())
    assert lines["rel-type"] == "1" and lines["errors"] == "0" and "assertion-only" in lines
    assert call("demo", str(tmp_path / "demo"), "--count", "30")[0] == 0


def test_view_asks_for_ids_before_times(spark):
    """A view is one exchange by id, a test on ids stands below it and before that on times; rows are as a join gives them."""
    from tessella.functions import intervals as iv
    from tessella.operators import graph as ops
    from tessella.sources.tables import sales_graph

    window = iv.IntervalSet([iv.Interval.of("Calendar", 5, 5)])
    held = {"yes": iv.IntervalSet([iv.Interval.of("Calendar", 4, 6)]), "no": iv.IntervalSet([iv.Interval.of("Calendar", 8, 9)])}

    def table(rows, columns):
        out = [spark.sql("SELECT " + ", ".join(f"'{x}' AS {c}" for x, c in zip(row, columns, strict=True)) + f", {held[when].sql()} AS valid") for *row, when in rows]
        for df in out[1:]:
            out[0] = out[0].unionByName(df)
        return out[0]

    nodes = table([("a", "yes"), ("b", "no"), ("c", "no"), ("d", "no"), ("d", "no"), ("d", "yes"), ("e", "no")], ["id"])
    rels = table([("a", "b", "yes"), ("e", "x", "no"), ("a", "gone", "yes"), ("d", "a", "yes")], ["src", "dst"])
    props = table([("c", "yes"), ("nobody", "yes"), ("e", "no")], ["owner"])
    got = sorted(tuple(r) for r in ops.view(ops.Graph(spark, nodes, rels, props, None), window).collect())
    want = [("a", "Full"), ("b", "AssertionOnly"), ("c", "AssertionOnly"), *[("d", "AssertionOnly")] * 2, ("d", "Full"), ("e", "Hidden"), ("gone", "AssertionOnly")]
    assert got == want
    plan = ops.view(sales_graph(spark, "/root/testdata/sf0.001"), window).where("startswith(id, 'order:')")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.index("Aggregate [id") < plan.index("StartsWith(")
