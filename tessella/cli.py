"""Commands over a folder of documents or a bundle: list, show, props, links, lint, stats, search, index, embed, demo."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import graph as ops
from tessella.operators import inspect, render
from tessella.plans import planner
from tessella.sources import bundle, demo, markdown


def parameter(text: str):
    """null, booleans, whole and decimal numbers and quoted strings by their looks; all else is a string."""
    if text in ("null", "true", "false") or re.fullmatch(r"-?\d+|-?\d+\.\d+([eE][+-]?\d+)?", text):
        return json.loads(text)
    if text[:1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def emit(df: DataFrame, as_json: bool, out) -> None:
    for row in (render.json_rows(df) if as_json else render.tsv(df)).toLocalIterator():
        print(row[0], file=out)


def main(args: list[str], spark: SparkSession, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("command", choices=("list", "show", "props", "links", "lint", "stats", "search", "index", "embed", "demo"))
    p.add_argument("rest", nargs="*", help="an id or a query, then the folder of documents")
    p.add_argument("--json", action="store_true")
    p.add_argument("--kind", action="append", default=[])
    p.add_argument("--type", action="append", default=[])
    p.add_argument("--exact-type", action="store_true")
    p.add_argument("--direction", choices=("out", "in", "both"), default="both")
    p.add_argument("--valid-time", help="timeline:coordinate or timeline:from..to")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--param", action="append", default=[])
    p.add_argument("--query-file")
    p.add_argument("--index")
    p.add_argument("--output")
    p.add_argument("--count", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(args)
    rest = list(a.rest)
    if a.command == "demo":
        demo.documents(spark, a.count, a.seed).write.json(rest[0])
        return 0
    wanted = rest.pop(0) if a.command in ("show", "props", "links") or a.command == "search" and not a.query_file else None
    if bool(rest) == bool(a.index):
        p.error("a folder of documents or --index, and not both")
    problems = None
    if a.index:
        g = bundle.read(spark, a.index)
    else:
        g, problems = markdown.load(markdown.read(spark, rest[0]))
    window = None
    if a.valid_time:
        try:
            window = inspect.window_of(g, a.valid_time)
        except planner.QueryError as e:
            print(e, file=out)
            return 1
    try:
        chosen = (tuple(map(inspect.kind_of, a.kind)), tuple(a.type), not a.exact_type, window)
    except planner.QueryError as e:
        print(e, file=out)
        return 1
    if a.command == "list":
        emit(inspect.inventory(g, *chosen), a.json, out)
    elif a.command == "show":
        rows, state = inspect.show(g, wanted)
        emit(rows, a.json, out)
        return 0 if state == "ok" else 1
    elif a.command == "props":
        emit(inspect.properties(g, wanted, window=window), a.json, out)
    elif a.command == "links":
        emit(ops.links(g, wanted, a.direction, a.type[0] if a.type else None, not a.exact_type, window), a.json, out)
    elif a.command == "lint":
        rows, code = inspect.lint(problems, a.strict)
        emit(rows, a.json, out)
        return code
    elif a.command == "stats":
        emit(inspect.summary(g, problems, *chosen), a.json, out)
    elif a.command == "search":
        query = Path(a.query_file).read_text(encoding="utf-8") if a.query_file else wanted
        r = planner.run(g, query, {k: parameter(v) for k, _, v in (x.partition("=") for x in a.param)}, "SERVER")
        for d in r.diagnostics:
            print(f"{d.code}: {d.message}", file=out)
        if r.rows is None:
            return 1
        emit(r.rows, a.json, out)
    elif a.command == "index":
        bundle.write(g, a.output, problems.where("severity = 'error'").count())
    elif a.command == "embed":
        code = 0
        for row in markdown.read(spark, rest[0]).toLocalIterator():
            if "embed:" not in row["text"]:
                continue
            head = markdown.split(row["text"])
            ident = re.search(r"(?m)^id:\s*(\S+)", head[0]) if head else None
            text, found = render.embed(g, ident[1] if ident else "", row["text"])
            for d in found:
                print(f"{row['path']}: {d.code}: {d.message}", file=out)
                code = 1
            if not found and text != row["text"]:
                Path(row["path"].removeprefix("file:")).write_text(text, encoding="utf-8")
        return code
    return 0
