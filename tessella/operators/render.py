"""Results as text: Markdown tables, tab-separated rows, JSON; the blocks of a document that show them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import intervals as iv
from tessella.operators.graph import Graph, backlinks
from tessella.plans import planner
from tessella.plans.syntax import parse

EMBED_ROWS = 100
_BLOCK = re.compile(r"(?ms)^(?P<fence>:{3,})[ \t]+embed:(?P<kind>query|back-link)=(?P<arg>\"(?:[^\"\\]|\\.)*\"|\S+)[^\n]*\n(?P<body>.*?)^(?P=fence)[ \t]*$")


def displayed(df: DataFrame) -> DataFrame:
    """All columns as text: validities as intervals, values that change with time as `v @ intervals`."""
    columns = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), f"`{f.name}`"
        if kind.startswith("array<struct<v:"):
            v = "coalesce(e.v.s, CAST(e.v.i AS STRING), CAST(e.v.d AS STRING), CAST(e.v.b AS STRING), 'null')"
            columns.append(F.expr(f"array_join(transform({c}, e -> CASE WHEN e.t.universal THEN {v} ELSE concat({v}, ' @ ', {iv.display_sql('e.t')}) END), '; ')").alias(f.name))
        elif kind.startswith("struct<universal:"):
            columns.append(F.expr(iv.display_sql(c)).alias(f.name))
        else:
            columns.append(F.col(f.name).cast("string").alias(f.name))
    return df.select(*columns)


def tsv(df: DataFrame) -> DataFrame:
    """(line): cells with tabs, newlines and backslashes escaped."""
    shown = displayed(df)
    cell = lambda c: F.coalesce(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit(""))
    return shown.select(F.concat_ws("\t", *[cell(F.col(f"`{c}`")) for c in shown.columns]).alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def markdown_table(df: DataFrame, most: int = EMBED_ROWS) -> str:
    """A table of at most `most` rows, which the driver holds; more are an error."""
    rows = displayed(df).limit(most + 1).collect()
    if len(rows) > most:
        raise planner.QueryError("GMQL5001", f"more than {most} rows")
    clean = lambda x: "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(clean(c) for c in r) + " |" for r in lines)


def embed(graph: Graph, node: str, text: str) -> tuple[str, list[planner.Diagnostic]]:
    """A document with the bodies of its embed blocks filled in; unchanged if any of them has a mistake."""
    found: list[planner.Diagnostic] = []

    def fill(m: re.Match) -> str:
        arg = json.loads(m["arg"]) if m["arg"].startswith('"') else m["arg"]
        try:
            if m["kind"] == "query":
                limit = parse(arg).limit
                if limit is not None and getattr(limit, "value", 0) > EMBED_ROWS:
                    raise planner.QueryError("GMQL5001", f"more than {EMBED_ROWS} rows")
                r = planner.run(graph, arg)
                if r.rows is None:
                    found.extend(r.diagnostics)
                    return m[0]
                shown = markdown_table(r.rows)
            else:
                rows, problems = backlinks(graph, node, arg, EMBED_ROWS)
                if problems:
                    raise planner.QueryError(problems[0], f"more than {EMBED_ROWS} rows")
                shown = markdown_table(rows.select("src", "title", "validity"))
        except planner.QueryError as e:
            found.append(planner.Diagnostic(e.code, e.message, m.start()))
            return m[0]
        return m[0][: m.start("body") - m.start()] + shown + "\n" + m["fence"]

    out = _BLOCK.sub(fill, text)
    return (text if found else out), found
