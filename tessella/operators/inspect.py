"""Listings of what a graph holds, and query text from search forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import intervals as iv
from tessella.functions import temporal
from tessella.operators.graph import Graph, meets, titles, view, visible_at
from tessella.plans.syntax import RESERVED, QueryError

#: The order in which kinds are listed, and the names by which commands ask for them.
KIND_ORDER = ("Node", "Media", "Link", "NodeType", "RelType", "Timeline")
KIND_NAMES = dict(zip(("node", "media", "link", "node-type", "rel-type", "timeline"), KIND_ORDER, strict=True))
#: The order of severities and categories in reports.
SEVERITIES = ("warning", "error")
CATEGORIES = ("SyntaxError", "SchemaError", "ReferenceError", "TypeError", "ConstraintError", "DuplicateId")


def listing(graph: Graph, kind: str | None = None, type_id: str | None = None, subtypes: bool = True, at: tuple[str, object] | None = None, ident: str | None = None, window: iv.IntervalSet | None = None) -> DataFrame:
    """(kind, id, type_id, title, source, validity) by kind, id and source; at: (axis, coordinate) leaves what holds there.

    window: leaves what is seen in it (graph.view), with a column that says how.
    """
    df = graph.nodes if ident is None else graph.with_id("nodes", "id", ident)
    if kind:
        df = df.where(F.col("kind") == kind)
    if type_id:
        df = df.where(F.array_contains("types", type_id) if subtypes else F.col("type_id") == type_id)
    if at:
        df = visible_at(df, *at).where("visibility = 'Full'")
    shown = df.join(titles(graph), df["id"] == F.col("owner"), "left")
    columns = ["kind", "id", "type_id", F.coalesce("title", "id").alias("title"), "source", F.expr(iv.display_sql("valid")).alias("validity")]
    if window is not None:
        shown = shown.join(view(graph, window).where("visibility <> 'Hidden'"), "id")
        columns.append("visibility")
    return shown.orderBy(_place(KIND_ORDER, "kind"), "id", "source").select(*columns)


def _place(names: tuple[str, ...], column: str) -> F.Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col(column))


def kind_of(text: str) -> str:
    """The kind that a command's word means: rel-type, rel_type and RelType are one."""
    word = text.lower().replace("_", "-")
    found = KIND_NAMES.get(word) or next((k for k in KIND_ORDER if k.lower() == word), None)
    if found is None:
        raise QueryError("GMQL3004", f"unknown kind {text}")
    return found


def inventory(graph: Graph, kinds: tuple[str, ...] = (), types: tuple[str, ...] = (), subtypes: bool = True, window: iv.IntervalSet | None = None) -> DataFrame:
    """(kind, id, type_id, title, source, validity, visibility) of nodes, media, links, types and timelines, by kind, id, source.

    types: nodes and links of one of these (subtypes: or below). window: nodes that are seen in it (graph.view) and links that
    hold in it. With either, types and timelines are not listed. No kinds are all kinds.
    """
    wanted = set(kinds or KIND_ORDER)
    of_types = (F.arrays_overlap("types", F.array(*map(F.lit, types))) if subtypes else F.col("type_id").isin(*types)) if types else F.lit(True)
    shown = [F.expr(iv.display_sql("valid")).alias("validity")]
    nodes = graph.nodes.where(F.col("kind").isin(*wanted) & of_types)
    seen = nodes.withColumn("visibility", F.lit("Full")) if window is None else nodes.join(view(graph, window).where("visibility <> 'Hidden'"), "id")
    out = seen.join(titles(graph), seen["id"] == F.col("owner"), "left").select("kind", "id", "type_id", F.coalesce("title", "id").alias("title"), "source", *shown, "visibility")
    if "Link" in wanted:
        links = graph.rels.where(of_types) if window is None else graph.candidates(graph.rels, window).where(of_types & meets(window))
        out = out.unionByName(links.select(F.lit("Link").alias("kind"), F.col("rel_id").alias("id"), "type_id", F.coalesce("label", "rel_id").alias("title"), "source", *shown, F.lit("Full").alias("visibility")))
    if not types and window is None:
        declared = [("NodeType", graph.node_types), ("RelType", graph.rel_types), ("Timeline", dict.fromkeys(graph.timelines, ()))]
        rows = [(k, i, ", ".join(up) or None, i, None, None, None) for k, ids in declared if k in wanted for i, up in ids.items()]
        if rows:
            out = out.unionByName(graph.spark.createDataFrame(rows, "kind string, id string, type_id string, title string, source string, validity string, visibility string"))
    return out.orderBy(_place(KIND_ORDER, "kind"), "id", "source")


def summary(graph: Graph, diagnostics: DataFrame | None = None, kinds: tuple[str, ...] = (), types: tuple[str, ...] = (), subtypes: bool = True, window: iv.IntervalSet | None = None) -> DataFrame:
    """(what, n): items of each kind, warnings and errors, and nodes by how they are seen, in this order; as inventory()."""
    items = inventory(graph, kinds, types, subtypes, window)
    word = F.create_map(*[F.lit(x) for k, w in zip(KIND_ORDER, KIND_NAMES, strict=True) for x in (k, w)])
    counted = items.select(F.explode(F.array(word[F.col("kind")], F.when(F.col("kind").isin("Node", "Media"), F.when(F.col("visibility") == "Full", "full").otherwise("assertion-only")))).alias("what"))
    if diagnostics is not None:
        counted = counted.unionByName(diagnostics.select(F.concat("severity", F.lit("s")).alias("what")))
    lines = (*KIND_NAMES, "warnings", "errors", "full", "assertion-only")
    every = graph.spark.createDataFrame([(x,) for x in lines], "what string")
    counts = counted.where("what IS NOT NULL").groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n")).orderBy(_place(lines, "what"))


def show(graph: Graph, ident: str) -> tuple[DataFrame, str]:
    """The rows of an id, and whether it is found: ok, unknown or ambiguous."""
    df = listing(graph, ident=ident)
    n = len(df.limit(2).collect())
    return df, ("unknown", "ok", "ambiguous")[n]


def window_of(graph: Graph, text: str) -> iv.IntervalSet:
    """`timeline:coordinate` or `timeline:from..to`, either end of which may be left out, on every axis that it reaches."""
    line, _, rest = text.partition(":")
    if line not in graph.timelines:
        raise QueryError("GMQL4002", f"unknown timeline {line}")
    t = graph.timelines[line]
    lo, sep, hi = rest.partition("..")
    first, last = (temporal.span(t, x) if x else None for x in (lo, hi if sep else lo))
    if first is not None and last is not None and last.hi < first.lo:
        raise QueryError("GMQL4003", f"{text}: the end lies before the beginning")
    return temporal.expand_window(iv.IntervalSet([temporal.interval(t.axis, first, last)]), graph.mappings)


def properties(graph: Graph, ident: str, at: tuple[str, object] | None = None, window: iv.IntervalSet | None = None) -> DataFrame:
    """(path, value, validity, fallback) of an owner by path; at: those that hold at a coordinate; window: in a window."""
    df = graph.with_id("props", "owner", ident)
    if at:
        df = visible_at(df, *at).where("visibility = 'Full'")
    if window is not None:
        df = df.where(meets(window))
    value = F.expr("coalesce(value.s, CAST(value.i AS STRING), CAST(value.d AS STRING), CAST(value.b AS STRING))")
    return df.select("path", value.alias("value"), F.expr(iv.display_sql("valid")).alias("validity"), "fallback").orderBy("path", "validity")


def lint(diagnostics: DataFrame, strict: bool = False) -> tuple[DataFrame, int]:
    """Diagnostics by path, place, severity, category and message, and the exit code; strict makes errors of warnings."""
    if strict:
        diagnostics = diagnostics.withColumn("severity", F.lit("error"))
    bad = diagnostics.where("severity = 'error'").limit(1).count()
    return diagnostics.orderBy("path", "start", _place(SEVERITIES, "severity"), _place(CATEGORIES, "category"), "message"), bad


def metadata(graph: Graph) -> dict[str, list[str]]:
    """What a search form offers."""
    return {"nodeTypes": sorted(graph.node_types), "relationTypes": sorted(graph.rel_types), "timelines": sorted(graph.timelines)}


def name(x: str) -> str:
    """An identifier, in back-ticks where the language needs them."""
    return x if x.isidentifier() and x.lower() not in RESERVED else f"`{x}`"


def node_form(type_id: str | None = None, text: str | None = None, filters: tuple[tuple[str, str, object], ...] = (), timeline: str | None = None, at: object = None, limit: int = 100) -> str:
    """A query for nodes: a type, a text, filters (property, operator, value), a time."""
    tests = [f"n.{name(p)} {op} {json.dumps(v, ensure_ascii=False)}" for p, op, v in filters]
    if text:
        tests.append(f"FULLTEXT(n, {json.dumps(text, ensure_ascii=False)})")
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    valid = f" VALID ON {name(timeline)} AT {json.dumps(at)}" if timeline else ""
    kind = f":{name(type_id)}" if type_id else ""
    return f"MATCH (n{kind}){where}{valid} RETURN ID(n) AS id, TITLE(n) AS title, SCORE() AS score ORDER BY score DESC, id LIMIT {limit}"


def link_form(rel_type: str | None = None, source: str | None = None, target: str | None = None, direction: str = "out", limit: int = 100) -> str:
    """A query for relations between nodes of given ids."""
    arrow = {"out": ("-", "->"), "in": ("<-", "-"), "either": ("-", "-")}[direction]
    kind = f":{name(rel_type)}" if rel_type else ""
    tests = [f"ID({v}) = {json.dumps(x, ensure_ascii=False)}" for v, x in (("a", source), ("b", target)) if x is not None]
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"MATCH (a){arrow[0]}[r{kind}]{arrow[1]}(b){where} RETURN ID(a) AS a, ID(r) AS r, ID(b) AS b ORDER BY a, r LIMIT {limit}"
