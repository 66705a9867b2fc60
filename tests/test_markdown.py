"""Ingestion of documents: a small railway, its tables, its queries and what is wrong with some of its pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions.intervals import display_sql
from tessella.operators import schema
from tessella.plans.planner import run
from tessella.sources import markdown, yaml_subset
from tessella.sources.places import KEY, Places

DOCS = {
    "line.md": "---\nid: Works\nkind: Timeline\n---\n",
    "civil.md": "---\nid: Civil\nkind: Timeline\ncoordinate: gregorian\n---\n",
    "site.md": "---\nid: Site\nkind: NodeType\n---\n",
    "stop.md": """---
id: Stop
kind: NodeType
extends: Site
props:
  sign: {type: string}
  notice: {type: text}
  tracks: {type: number}
  owner: {type: string}
  goods: {type: array, items: {type: string, enum: [coal, grain, mail]}}
  opened: {type: instant, timeline: Civil}
---
""",
    "track.md": "---\nid: trackTo\nkind: RelType\nsources: [Stop]\ntargets: [Stop]\nprops:\n  length: {type: number}\n---\n",
    "harbour.md": """---
id: harbour
type: Stop
validTime:
  - timeline: Works
    from: 40
    to: 90
props:
  sign: Harbour   # by the sea
  notice: {default: "港の駅"}
  goods: [coal, mail]
  opened: 1871-05-04
  tracks:
    - value: 2
      validTime: [{timeline: Works, from: 40, to: 64}]
    - value: 6
---
# Harbour Street

Trains wait here. `@props{sign="never"}`

~~~
@link{}[x](mill trackTo)
~~~

@link(validTime=Works(from=40, to=70)){length=3.5}[up the valley](mill trackTo)
""",
    "mill.md": """---
id: mill
type: Stop
validTime: [{timeline: Works, from: 40, to: 90}]
props: {sign: Mill, notice: {default: "水車"}, tracks: 4, goods: [grain]}
---
# Mill Halt

::: strike validTime=Works(from=40, to=55)
@props{owner="Weir & Co"}

It is closed on holidays.
:::
""",
    "depot1.md": "---\nid: depot\ntype: Stop\n---\n",
    "depot2.md": "---\nid: depot\ntype: Stop\n---\n",
    "torn.md": "---\nid: [half\n---\n",
    "odd.md": "---\nid: shed\ntype: Stop\nprops: {tracks: many, goods: [tar], colour: red, opened: 1871-02-30}\nrelations: [{target: nowhere, type: trackTo}]\n---\n",
}
#: Without what is wrong.
SOUND = {k: v for k, v in DOCS.items() if k not in ("torn.md", "odd.md", "depot1.md", "depot2.md")}


@pytest.fixture(scope="module")
def railway(spark):
    return markdown.load(spark.createDataFrame(list(DOCS.items()), "path string, text string"))


def ids(graph, query, **params):
    r = run(graph, query, params)
    assert not r.diagnostics, r.diagnostics
    return sorted(x[0] for x in r.rows.collect())


def test_yaml():
    text = 'n: 3\nl: [p, "q # r", {s: t}]\nm:\n  - u: 2.25\n    w: null\n  - v\no: \'don\'\'t\'\nd: 1999-12-31\nb: false # yes\n'
    assert yaml_subset.parse(text) == {"n": 3, "l": ["p", "q # r", {"s": "t"}], "m": [{"u": 2.25, "w": None}, "v"], "o": "don't", "d": "1999-12-31", "b": False}
    with pytest.raises(yaml_subset.YamlError):
        yaml_subset.parse("n: [3")


def test_diagnostics(railway):
    found = {(r["path"], r["severity"], r["category"]) for r in railway[1].collect()}
    assert {("torn.md", "error", "SyntaxError"), ("depot1.md", "error", "DuplicateId"), ("depot2.md", "error", "DuplicateId")} <= found
    assert {("odd.md", "warning", c) for c in ("TypeError", "ConstraintError", "SchemaError", "ReferenceError")} <= found
    said = {r["message"]: r["line"] for r in railway[1].where("path = 'odd.md'").collect()}
    assert said["tracks must be number"] == said["unknown property colour"] == 4
    assert any("1871-02-30" in m for m in said) and any("enumeration" in m for m in said)


def test_where_mistakes_stand(railway):
    """Each diagnostic's stretch of its document is what it is about."""
    about = {}
    for r in railway[1].collect():
        about.setdefault((r["path"], r["message"]), DOCS[r["path"]][r["start"] : r["end"]])
    odd = {m: x for (p, m), x in about.items() if p == "odd.md"}
    assert odd["tracks must be number"] == "many" and odd["unknown property colour"] == "colour"
    assert next(x for m, x in odd.items() if "1871-02-30" in m) == "1871-02-30" and next(x for m, x in odd.items() if "enumeration" in m) == "tar"
    assert next(x for m, x in odd.items() if "is no node" in m) == "nowhere"
    assert {x for (p, m), x in about.items() if p.startswith("depot")} == {"depot"} and next(x for (p, _), x in about.items() if p == "torn.md") == "[half"


def test_where_inline_mistakes_stand(spark):
    types = {k: DOCS[k] for k in DOCS if k in SOUND and "kind:" in DOCS[k]}
    body = """---
id: yard
type: Stop
validTime: [{timeline: Works, from: 1}, {timeline: Wrks, from: 2}]
---
# Yard

@props{tracks="few", notice(key=en)="x", tracks(validTime=Nowhere(from=1))=3}

::: strike validTime=Works(from=1
@link{weight=[}[there](mill trackTo)
:::
See @link{}[that](mill track) and @link{}[this]{mill}.
"""
    _, problems = markdown.load(spark.createDataFrame([*types.items(), ("yard.md", body)], "path string, text string"))
    found = {(r["message"], body[r["start"] : r["end"]], r["line"]) for r in problems.where("path = 'yard.md'").collect()}
    said = {m: (x, n) for m, x, n in found}
    assert said["tracks must be number"] == ('"few"', 8) and ("unknown timeline Wrks", "Wrks", 4) in found and ("unknown timeline Nowhere", "Nowhere", 8) in found
    assert said["unknown relation type track"] == ("track", 13)
    assert any("validTime=Works(from=1" in x and n == 10 for _, x, n in found) and any(x.startswith("@link{weight=[") and n == 11 for _, x, n in found)
    assert ("a link needs [label](target type)", n := 13) in {(m, n) for m, _, n in found}


def test_places_of_yaml():
    text = 'a: 1 # x\nb:\n  - {c: "d e", f: [g, h]}\n  - i: j\n    "k l": m\n'
    places = Places(0, len(text))
    yaml_subset.parse(text, places)
    at = {k: text[slice(*v)] for k, v in places.at.items()}
    assert at["b", 0, "c"] == '"d e"' and at["b", 0, "f", 1] == "h" and at["b", 1, "k l"] == "m" and at["b", 1, "k l", KEY] == '"k l"' and at["a",] == "1"
    assert at["b", 1] == 'i: j\n    "k l": m' and places.find(("b", 1, "i", "z", 4)) == places.at["b", 1, "i"]


def test_merged_arrays():
    x, y, z = ([{"timeline": "T", "from": n}] for n in range(3))
    t = lambda v, when: {"value": v, "validTime": when}
    merge = schema.merge_elements
    assert merge(["a", t("b", x), "c", t("d", y)], [t("e", y), "f", t("g", z), t("h", y)]) == ["f", t("b", x), t("e", y), t("h", y), t("g", z)]
    assert merge(["a", t("b", x)], []) == [t("b", x)] and merge([], ["a"]) == ["a"] and merge([t("a", [*x, *y])], [t("b", [*y, *x])]) == [t("b", [*y, *x])]
    assert merge(["a"], [{"value": "b"}]) == [{"value": "b"}] and merge([t("a", x)], ["b"]) == [t("a", x), "b"]


def test_tables(railway):
    g, _ = railway
    assert sorted(r[0] for r in g.nodes.select("id").collect()) == ["harbour", "mill", "shed"]
    props = {(r["owner"], r["path"], r["v"]) for r in g.props.selectExpr("owner", "path", f"{display_sql('valid')} AS v").collect()}
    assert ("harbour", "tracks", "Works: [40, 64]") in props and ("harbour", "tracks", "Works: (64, 90]") in props
    assert ("mill", "owner", "Works: [40, 55]") in props and ("harbour", "notice.default", "Works: [40, 90]") in props
    assert ("harbour", "goods.1", "Works: [40, 90]") in props and not any(o == "shed" and p in ("tracks", "opened") for o, p, _ in props)
    texts = {(r["owner"], r["kind"], r["text"]) for r in g.texts.collect()}
    assert ("harbour", "TITLE", "Harbour Street") in texts and ("mill", "PARAGRAPH", "It is closed on holidays.") in texts and ("harbour", "CODE", "@link{}[x](mill trackTo)") in texts
    rel = g.rels.where("src = 'harbour'").first()
    assert (rel["dst"], rel["type_id"], rel["label"]) == ("mill", "trackTo", "up the valley")


BOTH = ["harbour", "mill"]


@pytest.mark.parametrize("op", ["AT", "OVERLAPS", "CONTAINS", "DURING"])
def test_valid(railway, op):
    """Windows around the ends of [40, 90], against a count of the points that they share, in halves."""
    stop = {x / 2 for x in range(80, 181)}
    if op == "AT":
        for x in (39, 40, 65, 90, 91):
            assert ids(railway[0], f"MATCH (s:Stop) VALID ON Works AT {x} RETURN ID(s) AS id") == (BOTH if x in stop else [])
        return
    for lo, hi, left, right in ((90, 95, "[", ")"), (90, 95, "(", "]"), (40, 90, "[", "]"), (39, 90, "[", "]"), (41, 80, "(", ")"), (30, 40, "[", ")")):
        window = {x / 2 for x in range(50, 200) if (lo <= x / 2 if left == "[" else lo < x / 2) and (x / 2 <= hi if right == "]" else x / 2 < hi)}
        hit = {"OVERLAPS": bool(stop & window), "CONTAINS": window <= stop, "DURING": stop <= window}[op]
        assert ids(railway[0], f"MATCH (s:Stop) VALID ON Works {op} {left}{lo}, {hi}{right} RETURN ID(s) AS id") == (BOTH if hit else [])


def test_open_windows(railway):
    assert ids(railway[0], "MATCH (s:Stop) VALID ON Works OVERLAPS [-INF, 39] RETURN ID(s)") == []
    assert ids(railway[0], "MATCH (s:Stop) VALID ON Works OVERLAPS [80, +INF) RETURN ID(s)") == BOTH
    assert ids(railway[0], "MATCH (s:Stop) VALID ON Works ANYTIME RETURN ID(s)") == BOTH


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (s:Site) WHERE s.tracks >= 3 VALID ON Works AT 50 RETURN ID(s)", ["mill"]),
        ("MATCH (s:Stop) WHERE s.tracks >= 3 VALID ON Works AT 80 RETURN ID(s)", BOTH),
        ("MATCH (s:Stop) WHERE 3 <= s.tracks AND s.sign = 'Harbour' VALID ON Works AT 64 RETURN ID(s)", []),
        ("MATCH (a:Stop)-[t:trackTo]->(b) WHERE t.length > 3 AND b.tracks = 4 VALID ON Works AT 70 RETURN ID(a)", ["harbour"]),
        ("MATCH (a:Stop)-[:trackTo]->(b) VALID ON Works AT 71 RETURN ID(a)", []),
        ("MATCH (s:Stop) WHERE s.owner IS MISSING VALID ON Works AT 45 RETURN ID(s)", ["harbour", "shed"]),
        ("MATCH (s:Stop) WHERE NOT (s.owner = 'Weir & Co') VALID ON Works AT 45 RETURN ID(s)", ["harbour"]),
        ("MATCH (s:Stop) WHERE NOT (s.owner = 'Weir & Co') VALID ON Works AT 60 RETURN ID(s)", BOTH),
        ("MATCH (s:Stop) WHERE FULLTEXT(s.notice, '水車') RETURN ID(s)", ["mill"]),
        ("MATCH (s:Stop) WHERE FULLTEXT(s, 'holidays') RETURN ID(s)", ["mill"]),
        ("MATCH (s:Stop) WHERE s.sign STARTS WITH 'H' OR s.sign = $n RETURN ID(s)", BOTH),
        ("MATCH (s:Stop) WHERE TITLE(s) = 'Mill Halt' RETURN ID(s)", ["mill"]),
        ("MATCH (s:Stop) WHERE s.title = 'Harbour Street' RETURN ID(s)", ["harbour"]),
        ("MATCH (s:Stop) WHERE s.tracks % 5 = 4 AND 1 / 0 = 1 RETURN ID(s)", []),
        ("MATCH (s:Stop) WHERE s.goods CONTAINS 'mail' RETURN ID(s)", ["harbour"]),
        ("MATCH (s:Stop) WHERE 'grain' IN s.goods RETURN ID(s)", ["mill"]),
        ("MATCH (s:Stop) WHERE s.goods = $goods RETURN ID(s)", ["harbour"]),
        ("MATCH (s:Stop) WHERE s.goods != $goods RETURN ID(s)", ["mill", "shed"]),
        ("MATCH (s:Stop) WHERE s.notice = $notice RETURN ID(s)", ["mill"]),
        ("MATCH (s:Stop) WHERE s.goods IN $lists RETURN ID(s)", ["mill"]),
        ("MATCH (a:Stop), (b:Stop) WHERE a.goods = b.goods AND ID(a) = 'mill' RETURN ID(b)", ["mill"]),
        ("MATCH (s:Stop) WHERE s.opened = '1871-05-04' RETURN ID(s)", ["harbour"]),
        ("MATCH (s:Stop) RETURN DISTINCT TYPE(s)", ["Stop"]),
    ],
)
def test_where(railway, query, want):
    assert ids(railway[0], query, n="Mill", goods=["coal", "mail"], notice={"default": "水車"}, lists=[["grain"], ["coal"]]) == want


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("MATCH (s:Stop RETURN s", "GMQL1001"), ("MATCH (s:Port) RETURN s", "GMQL2001"), ("MATCH (s)-[:flight]->(t) RETURN s", "GMQL2002"),
        ("MATCH (s)-[s]->(t) RETURN s", "GMQL2003"), ("MATCH (s:Stop) WHERE s.tracks = $x RETURN s", "GMQL2004"), ("MATCH (s:Stop) RETURN t", "GMQL2005"),
        ("MATCH (s:Stop) RETURN s.colour", "GMQL2006"), ("MATCH (s:Stop) RETURN NEAR(s)", "GMQL2007"), ("MATCH (s:Stop) WHERE s.tracks < 'x' RETURN s", "GMQL3001"),
        ("MATCH (s:Stop) RETURN s.tracks ORDER BY s.tracks", "GMQL3003"), ("MATCH (s:Stop) RETURN ID(s) LIMIT 'a'", "GMQL3004"), ("MATCH (s:Site)-[:trackTo]->(t) RETURN ID(s) LIMIT -1", "GMQL5002"),
        ("MATCH (s:Stop)-[t:trackTo]->(u) RETURN KIND(t)", "GMQL3007"), ("MATCH (s:Stop) RETURN ID()", "GMQL3008"), ("MATCH (s:Stop) WHERE s.sign + 1 = 2 RETURN s", "GMQL3009"),
        ("MATCH (s:Stop) VALID AT 1 RETURN s", "GMQL4001"), ("MATCH (s:Stop) VALID ON X AT 1 RETURN s", "GMQL4002"), ("MATCH (s:Stop) VALID ON Civil AT 'x' RETURN s", "GMQL4003"),
    ],
)
def test_codes(railway, query, code):
    assert [d.code for d in run(railway[0], query).diagnostics] == [code]


def test_limit_of_a_profile(railway):
    assert [d.code for d in run(railway[0], "MATCH (s:Stop) RETURN ID(s) LIMIT 10001", profile="STATIC_WEB").diagnostics] == ["GMQL5001"]


def test_limit_of_bindings_stops_at_the_join(railway, monkeypatch):
    from tessella.plans import planner

    counted = []
    bounded = planner.Plan.bounded
    monkeypatch.setattr(planner.Plan, "bounded", lambda plan: (counted.append(len(plan.vars)), bounded(plan))[1])
    query = "MATCH (s:Stop)-[t:trackTo]->(u), (x:Stop) RETURN ID(s)"
    assert not run(railway[0], query, profile="STATIC_WEB").diagnostics and len(counted) == 2  # a hop, and what shares nothing
    monkeypatch.setitem(planner.BINDINGS, "STATIC_WEB", 0)
    counted.clear()
    assert [d.code for d in run(railway[0], query, profile="STATIC_WEB").diagnostics] == ["GMQL5001"] and len(counted) == 1


def test_read(spark, tmp_path):
    for name, text in DOCS.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "plain.md").write_text("no front matter")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "theirs.md").write_text(DOCS["mill.md"])
    assert markdown.read(spark, str(tmp_path)).count() == len(DOCS)
    assert markdown.read(spark, str(tmp_path / "mill.md")).count() == 1 == markdown.read(spark, str(tmp_path / "plain.md")).count()


def test_schemas_narrow(spark):
    head = "---\nid: {}\nkind: NodeType\nextends: {}\nprops:\n  p: {}\n---\n"
    rows = [("a.md", "---\nid: A\nkind: NodeType\nprops:\n  p: {type: string, enum: [x, y]}\n---\n")]
    rows += [(f"{n}.md", head.format(n, up, p)) for n, up, p in (("B", "A", "{type: string, enum: [x]}"), ("C", "A", "{type: number}"), ("D", "A", "{type: string, enum: [x, z]}"))]
    rows += [("e.md", "---\nid: E\nkind: NodeType\nextends: [B, F]\n---\n"), ("f.md", "---\nid: F\nkind: NodeType\nprops:\n  p: {type: array}\n---\n")]
    found = {r["path"]: r["category"] for r in markdown.load(spark.createDataFrame(rows, "path string, text string"))[1].collect()}
    assert found == {"C.md": "ConstraintError", "D.md": "ConstraintError", "e.md": "ConstraintError"}


def test_documents_of_one_file_are_parsed_by_many_tasks(spark):
    """A small file holds many documents; each is still one row of what is kept, and equal mistakes in times are each said."""
    rows = [("Count.md", "---\nid: Count\nkind: Timeline\n---\n"), ("Item.md", "---\nid: Item\nkind: NodeType\n---\n")]
    rows += [(f"i{i}.md", f"---\nid: i{i}\ntype: Item\nvalidTime: [{{timeline: {'Gone' if i % 50 == 0 else 'Count'}, from: {i % 3}}}]\n---\n# Item {i}\n") for i in range(200)]
    g, problems = markdown.load(spark.createDataFrame(rows, "path string, text string").coalesce(1))
    tasks = g.parsed.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 60
    begins = {r["id"]: r["w"] for r in g.nodes.selectExpr("id", "get(valid.ivs, 0).lo.w AS w").collect()}
    assert begins == {f"i{i}": None if i % 50 == 0 else i % 3 for i in range(200)}
    assert sorted(r["path"] for r in problems.where("message = 'unknown timeline Gone'").collect()) == ["i0.md", "i100.md", "i150.md", "i50.md"]
    markdown.release(g)


def test_rows_of_documents_are_kept_as_columns(spark):
    """What documents give is kept typed, each validity once a document; nothing reads JSON to get it back."""
    times = "[{timeline: Count, from: 1, to: 3/2}, {timeline: Count, from: 2, to: 1" + "0" * 25 + "}]"
    text = f'---\nid: a\nurl: [1, {{b: 2.5}}]\nvalidTime: {times}\nprops:\n  big: 9223372036854775808\n  least: -9223372036854775808\n  l: [x, 1e999]\nrelations:\n  - {{target: b, type: next, label: 12345678.5}}\n---\n# T\n'
    g, _ = markdown.load(spark.createDataFrame([("Count.md", "---\nid: Count\nkind: Timeline\n---\n"), ("a.md", text)], "path string, text string"))
    for table in (g.nodes, g.rels, g.props, g.texts):
        assert "from_json" not in table._jdf.queryExecution().toString()
    assert [len(r[0]) for r in g.parsed.where("size(node) > 0").select("valids").collect()] == [1]
    assert [r[0] for r in g.nodes.select("url").collect()] == ['[1,{"b":2.5}]'] and [r[0] for r in g.rels.select("label").collect()] == ["1.23456785E7"]
    values = {r["path"]: r["value"] for r in g.props.select("path", "value").collect()}
    assert values["big"].tag == "integer" and values["big"].i is None and values["least"].i == -(2**63)
    assert values["l.1"].d == float("inf") and [(x.tag, x.s) for x in values["l"]["items"]][0] == ("string", "x")
    (valid,) = {str(r[0]) for r in g.props.select("valid").collect()}
    assert valid == str(g.nodes.first()["valid"])
    markdown.release(g)
