"""Markdown documents with front matter as a graph.

Documents that declare types and timelines are few; they are read first and become the graph's catalogs. All others are
parsed in one Arrow map: each document gives typed rows for nodes, relations, properties and texts, and its validities once;
its rows name these by their number. A document that cannot be read gives a diagnostic and nothing else.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Context, Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import intervals as iv
from tessella.functions import temporal
from tessella.functions.values import fields_of
from tessella.operators import graph as ops
from tessella.operators import schema
from tessella.operators.graph import Graph, Timeline
from tessella.plans.syntax import QueryError
from tessella.sources import yaml_subset as yaml
from tessella.sources.places import KEY, Places, Problems

KINDS = ("Node", "Media", "NodeType", "RelType", "Timeline")
_ID = re.compile(r"[^\s/\\]+")
_FENCE = re.compile(r" {0,3}(:{3,})(?:[ \t]+(.*))?\s*$")
_DIRECTIVE = re.compile(r"(?<!\\)@(props|link)(?![\w-])")
_CODE = re.compile(r"[`~]|^(?: {4}|\t)", re.M)  #: what no body without code need have
_WORD = re.compile(r"[^\s=(){},\[\]\"]+")
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_LABEL = re.compile(r"((?:[^\]\\]|\\.)*)\]", re.S)
_TARGET = re.compile(r"\(\s*(\S+)(?:[ \t]+\"?([^\s\")]+)\"?)?\s*\)")
_SHOWN = re.compile(r"\[((?:[^\]\\]|\\.)*)\]\(")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")


#: Folders that hold no documents of their own.
SKIPPED = (".git", "node_modules", "build", "dist")


#: A test on `text`: whether a document declares a type or a timeline.
DECLARES = r"text RLIKE r'(?m)^kind:\s*(NodeType|RelType|Timeline)\s*(#.*)?$'"


def documents(files: DataFrame, path: str) -> DataFrame:
    """(path, text) of read files: those outside of skipped folders whose first line opens a front matter, and a file that
    is named itself, whatever it holds."""
    files = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("text"))
    if path.endswith(".md"):
        return files
    skipped = "/(?:" + "|".join(re.escape(x) for x in SKIPPED) + ")/"
    return files.where(~F.substring_index("path", path.rstrip("/"), -1).rlike(skipped)).where(F.col("text").rlike("^---[ \t]*\n"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .md files below a folder whose first line opens a front matter; or of one file, whatever it is."""
    files = spark.read.option("recursiveFileLookup", True)
    if not path.endswith(".md"):
        files = files.option("pathGlobFilter", "*.md")
    return documents(files.text(path, wholetext=True), path).dropDuplicates(["path"])


_PARTS = re.compile(r"---[ \t]*\n(.*?)^(?:---|\.\.\.)[ \t]*(?:\n|\Z)(.*)\Z", re.S | re.M)


def split(text: str) -> tuple[str, str] | None:
    m = _PARTS.match(text)
    return (m[1], m[2]) if m else None


def head_of(text: str, m: re.Match | None = None) -> tuple[dict, Places]:
    """The front matter of a text that has one, and where its parts stand; errors say where they are. m: its parts, if they were found."""
    m = m or _PARTS.match(text)
    places = Places(*m.span(1))
    return yaml.parse(m[1], places, m.start(1)), places


def mask_code(body: str) -> str:
    """Code blanked, with all places kept, so that nothing in it counts as a directive."""
    if not _CODE.search(body):
        return body
    out, fence, paragraph = [], None, False
    for line in body.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)", line)
        if fence:
            close = m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip()
            out.append(" " * len(line))
            fence = None if close else fence
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(" " * len(line))
        elif not paragraph and re.match(r"(?: {4}|\t)\s*\S", line):
            out.append(" " * len(line))
            continue
        else:
            out.append(line)
        paragraph = bool(line.strip()) and not fence
    text = "\n".join(out)
    return re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


class Inline:
    """`{k=v, k(key=en)=v, k(validTime=T(from=1, to=2))=v}` and what stands around it."""

    def __init__(self, text: str, at: int):
        self.t, self.i, self.places = text, at, Places(at, len(text))

    def space(self):
        while self.t[self.i : self.i + 1].isspace():
            self.i += 1

    def take(self, c: str) -> bool:
        self.space()
        if self.t.startswith(c, self.i):
            self.i += len(c)
            return True
        return False

    def need(self, c: str):
        if not self.take(c):
            raise yaml.YamlError(f"expected {c} at {self.t[self.i : self.i + 20]!r}")

    def word(self) -> str:
        self.space()
        m = _WORD.match(self.t, self.i)
        if not m:
            raise yaml.YamlError(f"a name is needed at {self.t[self.i : self.i + 20]!r}")
        self.i = m.end()
        return m[0]

    def value(self, path: tuple = ()):
        self.space()
        start = self.i
        c = self.t[self.i : self.i + 1]
        if c == '"':
            m = _QUOTED.match(self.t, self.i)
            if not m:
                raise yaml.YamlError("unclosed quote")
            self.i = m.end()
            out = yaml.unquote(m[0])
        elif c == "{":
            out = self.object(path)
        elif c == "[":
            self.i += 1
            out = []
            while not self.take("]"):
                out.append(self.value((*path, len(out))))
                self.take(",")
        else:
            out = yaml.scalar(self.word())
        self.places.put(path, start, self.i)
        return out

    def times(self, path: tuple = (), n: int = 0) -> list[dict]:
        """`T(from=1, to=2)`, or several in brackets; the first is the n-th of its path."""
        if self.take("["):
            out = []
            while not self.take("]"):
                out += self.times(path, n + len(out))
                self.take(",")
            return out
        self.space()
        start, here = self.i, (*path, n)
        entry = {"timeline": self.word()}
        self.places.put((*here, "timeline"), start, self.i)
        self.need("(")
        while not self.take(")"):
            key = self.word()
            self.need("=")
            entry[key] = self.value((*here, key))
            self.take(",")
        self.places.put(here, start, self.i)
        return [entry]

    def options(self, path: tuple = ()) -> dict:
        out: dict = {}
        if self.take("("):
            while not self.take(")"):
                key = self.word()
                self.need("=")
                out[key] = self.times((*path, key)) if key == "validTime" else self.value((*path, key))
                self.take(",")
        return out

    def object(self, path: tuple = ()) -> dict:
        self.need("{")
        out: dict = {}
        while not self.take("}"):
            self.space()
            start = self.i
            key = self.word()
            self.places.put((*path, key, KEY), start, self.i)
            held = out.get(key)
            # one more variant, if this is to be one
            n = len(held) if isinstance(held, list) else int(key in out)
            opts = self.options((*path, key, n))
            self.need("=")
            variant = "validTime" in opts or isinstance(held, list)
            value = self.value((*path, key, str(opts["key"])) if "key" in opts else (*path, key, n, "value") if variant else (*path, key))
            if "key" in opts:
                entry = out.setdefault(key, {})
                entry[str(opts["key"])] = value
            elif "validTime" in opts:
                held = out.setdefault(key, [])
                out[key] = [*(held if isinstance(held, list) else [{"value": held}]), {"value": value, "validTime": opts["validTime"]}]
            elif isinstance(out.get(key), list):
                out[key].append({"value": value})
            else:
                out[key] = value
            self.take(",")
        return out


@dataclass
class Body:
    props: list[tuple[dict, list | None, Places]]
    links: list[dict]
    texts: list[tuple[str, str, list | None]]
    problems: list[tuple[str, int, int]]


def parse_body(body: str, base: int = 0) -> Body:
    """Directives and text fragments, each with the validTime of its innermost block; places count from base."""
    masked = mask_code(body)
    out = Body([], [], [], [])
    lines = masked.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    time_at: list[list | None] = []
    fenced: list[bool] = []
    stack: list[tuple[int, list | None, bool]] = []
    for line, begin in zip(lines, starts, strict=True):
        m = _FENCE.match(line)
        here = None
        if m:
            size, header = len(m[1]), (m[2] or "").strip()
            if header:
                parent = stack[-1][1] if stack else None
                times, embed = parent, "embed:" in header
                k = header.find("validTime=")
                if k >= 0:
                    try:
                        times = Inline(header, k + len("validTime=")).times()
                    except yaml.YamlError as e:
                        out.problems.append((str(e), base + begin + m.start(2), base + begin + m.end(2)))
                stack.append((size, times, embed or bool(stack) and stack[-1][2]))
            elif stack and stack[-1][0] == size:
                stack.pop()
        here = stack[-1][1] if stack else None
        time_at.append(here)
        fenced.append(bool(m) or bool(stack) and stack[-1][2])

    def time_of(place: int):
        return time_at[bisect.bisect_right(starts, place) - 1]

    spans = []
    for m in _DIRECTIVE.finditer(masked):
        if spans and m.start() < spans[-1][1]:  # inside of the one before
            continue
        p = Inline(body, m.end())
        try:
            times = p.options().get("validTime", time_of(m.start()))
            if m[1] == "props":
                made = p.object()
                p.places.put((), m.start(), p.i)
                out.props.append((made, times, p.places.moved(base)))
            else:
                found = p.object(("props",)) if body[p.i : p.i + 1] == "{" else {}
                p.need("[")
                label = _LABEL.match(body, p.i)
                target = _TARGET.match(body, label.end() if label else p.i)
                if not label or not target:
                    raise yaml.YamlError("a link needs [label](target type)")
                p.i = target.end()
                p.places.put((), m.start(), p.i)
                p.places.put(("target",), *target.span(1))
                if target[2]:
                    p.places.put(("type",), *target.span(2))
                out.links.append({"label": re.sub(r"\\([\]\\])", r"\1", label[1]), "target": target[1], "type": target[2], "props": found, "validTime": times, "at": m.start(), "places": p.places.moved(base)})
            spans.append((m.start(), p.i))
        except yaml.YamlError as e:
            out.problems.append((str(e), base + m.start(), base + max(p.i, m.end())))

    shown, at = [], 0
    for a, b in spans:
        piece = body[a:b]
        keep = _SHOWN.search(piece) if piece.startswith("@link") else None
        i, j = keep.span(1) if keep else (0, 0)
        shown += [body[at:a], "\n" * piece.count("\n", 0, i), piece[i:j], "\n" * piece.count("\n", j)]
        at = b
    pieces = "".join([*shown, body[at:]]).split("\n")
    paragraph: list[str] = []
    when: list | None = None

    def flush():
        text = " ".join(x.strip() for x in paragraph).strip()
        if text:
            out.texts.append(("PARAGRAPH", text, when))
        paragraph.clear()

    for line, plain, times, off in zip(pieces, lines, time_at, fenced, strict=False):
        code = not plain.strip() and line.strip()
        head = _HEADING.match(line)
        if off or code or not line.strip() or head or times != when:
            flush()
        when = times
        if off or not line.strip():
            continue
        if code:
            if not re.match(r" {0,3}(`{3,}|~{3,})", line):
                out.texts.append(("CODE", line.strip(), times))
        elif head:
            out.texts.append(("TITLE" if head[1] == "#" else "HEADING", head[2], times))
        else:
            paragraph.append(line)
    flush()
    return out


def validity(times, timelines: dict[str, Timeline], problems: Problems) -> iv.IntervalSet:
    """No validTime holds anytime; entries of unknown timelines and reversed ranges are left out, and all of them left out is never.

    problems looks at the validTime.
    """
    if times is None:
        return iv.ANYTIME
    out = []
    for n, e in enumerate(times if isinstance(times, list) else [times]):
        t = timelines.get(str(e.get("timeline"))) if isinstance(e, dict) else None
        where = (n,) if isinstance(times, list) else ()
        if t is None:
            problems.add(f"unknown timeline {e.get('timeline') if isinstance(e, dict) else e}", (*where, "timeline"))
            continue
        try:
            lo, hi = (None if e.get(k) is None else temporal.span(t, e[k]) for k in ("from", "to"))
            if t.system == "pattern" and lo is not None:
                hi = lo if hi is None and not lo.point else hi
                if hi is not None and hi.hi < lo.lo:
                    hi = replace(hi, lo=hi.lo + 10_000, hi=hi.hi + 10_000)  # the end lies in the next year
            out.append(temporal.interval(t.axis, lo, hi))
        except (QueryError, ValueError) as x:
            problems.add(str(x), where)
    return iv.IntervalSet(out)


def _validity_row(s: iv.IntervalSet) -> dict:
    def cut(c: iv.Cut) -> dict:
        w = c.at.numerator // c.at.denominator
        f = c.at - w
        return {"w": _long(w), "f": Decimal(f.numerator * 10**37 // f.denominator).scaleb(-37, _DIGITS), "s": c.side}

    return {"universal": s.universal, "ivs": [{"axis": i.axis, "lo": cut(i.lo), "hi": cut(i.hi)} for i in s.ivs]}


_DIGITS = Context(prec=38)
_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
#: JSON that is equal for equal times.
_SAME = json.JSONEncoder(sort_keys=True, default=str).encode
#: The times of so many validTimes are kept by a task that parses documents; few differ.
_HELD = 10_000


def _long(x: int) -> int | None:
    """Numbers beyond 64 bits are unknown."""
    return x if -(2**63) <= x < 2**63 else None


def _value(x) -> dict:
    out = fields_of(x)
    for v in (out, *out.get("items", ())):
        if v["tag"] == "integer":
            v["i"] = _long(v["i"])
    return out


def _said(x) -> str | None:
    """What stands where a text should, as text; all that is no text as compact JSON, doubles with the digits of the JVM."""
    if x is None or isinstance(x, str):
        return x
    return _inner(x)


def _inner(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{_JSON(str(k))}:{_inner(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_inner, x)) + "]"
    if not isinstance(x, float) or x == 0 or 1e-3 <= abs(x) < 1e7:
        return _JSON(x)
    if math.isinf(x):
        return _JSON(_JSON(x))
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    more = "".join(map(str, digits[1:])) or "0"
    return f"{'-' * sign}{digits[0]}.{more}E{exponent + len(digits) - 1}"


def expand(path: str, raw, inherited, at: tuple = ()) -> Iterator[tuple[str, object, object, bool, tuple | None]]:
    """(path, value, validTime, fallback, place): variants of a property and the members of nested values; place: the path in
    the document of a validTime that is not inherited."""
    variants = isinstance(raw, list) and raw and all(isinstance(x, dict) and "value" in x for x in raw)
    for n, entry in enumerate(raw if variants else [{"value": raw}]):
        timed, n = entry.get("validTime") is not None, entry.get(_NTH, n)
        times, value = entry.get("validTime", inherited), entry["value"]
        place = (*at, n, "validTime") if timed else None
        yield path, value, times, not timed, place
        members = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in members:
            for p, x, t, f, q in expand(f"{path}.{k}", v, times, (*at, n, "value", k) if variants else (*at, k)):
                yield p, x, t, f and not timed, q or place


_NTH = "\0n"  #: in a variant: its number as it is written


def normalised(raw, s: schema.Schema | None, name: str, check, problems: Problems, stayed: list[int] | None = None):
    """A property as its schema has it: each variant, or the one value; None where nothing is left."""
    variants = isinstance(raw, list) and raw and all(isinstance(x, dict) and "value" in x for x in raw)
    if variants and (s is None or s.kind != "array"):
        out = []
        for i, x in enumerate(raw):
            value = schema.normalise(x["value"], s, name, check, problems.under((i, "value")))
            if value is not None or x["value"] is None:
                out.append({**x, "value": value, _NTH: i})
        return out or None
    return schema.normalise(raw, s, name, check, problems, stayed)


def expand_elements(path: str, elements: list[tuple[object, Problems]], inherited) -> Iterator[tuple]:
    """An array and its elements as expand() gives them, with the mistakes of each element's own time in place of a path."""
    timed = [schema.times_of(x) is not None for x, _ in elements]
    values = [x["value"] if t or isinstance(x, dict) and set(x) == {"value"} else x for (x, _), t in zip(elements, timed, strict=True)]
    yield path, values, inherited, True, None
    for i, ((x, where), t, value) in enumerate(zip(elements, timed, values, strict=True)):
        if not isinstance(value, (dict, list)):
            yield f"{path}.{i}", value, x["validTime"] if t else inherited, not t, where.under(("validTime",)) if t else None
            continue
        for n, (p, v, times, fallback, q) in enumerate(expand(f"{path}.{i}", value, x["validTime"] if t else inherited)):
            yield p, v, times, not t and fallback, where.under(("validTime",)) if t and (n == 0 or q is None) else None


def _rows(path: str, text: str, graph: dict, valids: list[dict]) -> Iterator[tuple[str, tuple]]:
    """(what, row): rows as the columns of _MADE. valids gets the validities of the document, which rows name by their number."""
    m = _PARTS.match(text)
    if m is None:
        end = text.find("\n")
        yield "diagnostic", tuple(said(path, "error", "no front matter", text, 0, len(text) if end < 0 else end).values())
        return
    try:
        head, places = head_of(text, m)
    except yaml.YamlError as e:
        yield "diagnostic", tuple(said(path, "error", str(e), text, *(e.span or m.span(1))).values())
        return
    kind, ident = head.get("kind", "Node"), str(head.get("id") or "")
    if kind not in KINDS or not _ID.fullmatch(ident):
        wrong = (f"unknown kind {kind}", ("kind",)) if kind not in KINDS else ("an id is needed", ("id",))
        yield "diagnostic", tuple(said(path, "error", wrong[0], text, *places.find(wrong[1])).values())
        return
    if kind not in ("Node", "Media"):
        return
    top = Problems(places)
    timelines, types, rel_types, schemas = graph["timelines"], graph["node_types"], graph["rel_types"], graph["schemas"]

    def check(line: str, value) -> object:
        """A coordinate as its timeline writes it."""
        if line not in timelines:
            raise ValueError(f"unknown timeline {line}")
        try:
            at = temporal.span(timelines[line], value)
        except QueryError as e:
            raise ValueError(str(e)) from None
        return value if at.point and not isinstance(value, str) else str(value)

    held = graph.setdefault("held", {})

    asked: list[tuple] = []  # (times, number): few differ, and those that are one object need no look
    numbers: dict[str, int] = {}

    def valid_in(x, where: Problems) -> int:
        """The number of what validity() gives; times without mistakes are worked out once."""
        for times, n in asked:
            if times is x:
                return n
        key = repr(x)
        n = numbers.get(key)
        if n is None:
            n, valid, before = len(valids), held.get(key), len(where.found)
            valids.append(valid or _validity_row(validity(x, timelines, where)))
            if len(where.found) > before:
                return n
            if len(held) >= _HELD:
                held.clear()
            held[key], numbers[key] = valids[-1], n
        if len(asked) < 8:
            asked.append((x, n))
        return n

    def place(what: str, key: str, start: int, end: int) -> tuple[str, tuple]:
        return "place", (what, key, path, text.count("\n", 0, start) + 1, start, end)

    own = str(head.get("type") or kind)
    if own not in types and own not in KINDS:
        top.add(f"unknown type {own}", ("type",))
    up = types.get(own, (own,))
    times = head.get("validTime")
    when_whole = top.under(("validTime",))
    body = parse_body(m[2], m.start(2))
    top.found += body.problems
    yield "node", (ident, own, up, kind, _said(head.get("url")), valid_in(times, when_whole), path)
    yield place("node", ident, *places.find(("id",)))
    merged: dict[tuple, tuple] = {}
    arrays: dict[tuple[str, str], list] = {}
    seen: set[str] = set()

    def add(p: str, x, t, fallback: bool, where: Problems) -> None:
        # the body overrides the front matter where both set the same path for the same set of times
        key = (p, _JSON(sorted(map(_SAME, t))) if isinstance(t, list) and not fallback else None)
        if key not in merged:
            merged[key] = (p, _value(x), t, fallback, where)

    sources = [(p, t if t is not None else times, top.under((), q)) for p, t, q in body.props]
    for layer, (source, inherited, here) in enumerate((*sources, (head.get("props") or {}, times, top.under(("props",)))), 1):
        for name, raw in source.items():
            seen.add(name)
            s = schema.lookup(schemas, up, name)
            if s is None and any(t in schemas for t in up):
                here.add(f"unknown property {name}", (name, KEY))
            mine = here.under((name,))
            stayed: list[int] = []
            value = normalised(raw, s, name, check, mine, stayed)
            if value is None and raw is not None:
                continue
            if s is not None and s.kind == "array" and isinstance(value, list):
                elements = [(x, mine.under((i,))) for i, x in zip(stayed, value, strict=True)]
                group = arrays.setdefault((name, _SAME(inherited)), [inherited, []])
                group[1].append((layer if layer <= len(sources) else 0, elements))  # the front matter lies below
                continue
            if not isinstance(value, (dict, list)):
                add(name, value, inherited, True, when_whole)
                continue
            for p, x, t, fallback, q in expand(name, value, inherited):
                add(p, x, t, fallback, mine.under(q) if q else when_whole)
    for (name, _), (inherited, layers) in arrays.items():
        (_, whole), *above_it = sorted(layers, key=lambda x: x[0])
        for _, above in above_it:
            whole = schema.merge_elements(whole, above, lambda e: schema.times_of(e[0]))
        for p, x, t, fallback, where in expand_elements(name, whole, inherited):
            add(p, x, t, fallback, where or when_whole)
    for t in up:
        for n, s in schemas.get(t, {}).items():
            if s.required and n not in seen and t == own:
                top.add(f"missing property {n}", ("id",))
    for p, value, t, fallback, where in merged.values():
        yield "prop", (ident, p, value, valid_in(t, where), fallback)
    n = 0
    if not any(k == "TITLE" for k, _, _ in body.texts) and head.get("title"):
        body.texts.insert(0, ("TITLE", str(head["title"]), None))
    for k, t, when in body.texts:
        valid = valid_in(when if when is not None else times, when_whole)
        yield "text", (f"{ident}#{n:05d}", ident, k, None, t, valid)
        n += 1
    links = [{**x, "key": f"{ident}@{x['at']}", "here": top.under((), x["places"])} for x in body.links]
    for i, x in enumerate(head.get("relations") or []):
        links.append({"label": x.get("label"), "target": x.get("target"), "type": x.get("type"), "props": x.get("props") or {}, "validTime": x.get("validTime"), "key": f"{ident}!{i}", "here": top.under(("relations", i))})
    for x in links:
        kind_, here = str(x["type"] or ""), x["here"]
        if kind_ not in rel_types:
            here.add(f"unknown relation type {kind_}", ("type",))
        when = x["validTime"] if x["validTime"] is not None else times
        whole = here.under(("validTime",)) if x["validTime"] is not None else when_whole
        yield "rel", (x["key"], ident, str(x["target"]), kind_, rel_types.get(kind_, (kind_,)), _said(x["label"]), valid_in(when, whole), path)
        yield place("rel", x["key"], *here.places.find(here.path))
        yield place("dst", x["key"], *here.places.find((*here.path, "target")))
        for name, raw in x["props"].items():
            mine = here.under(("props", name))
            value = normalised(raw, schema.lookup(schemas, rel_types.get(kind_, (kind_,)), name), name, check, mine)
            if value is None and raw is not None:
                continue
            for p, v, t, fallback, q in expand(name, value, when):
                yield "prop", (x["key"], p, _value(v), valid_in(t, mine.under(q) if q else whole), fallback)
    for message, start, end in dict.fromkeys(top.found):
        yield "diagnostic", tuple(said(path, "warning", message, text, start, end).values())


#: The categories of diagnostics, by what a message begins with or holds.
CATEGORIES = (
    ("unknown property", "SchemaError"), ("unknown", "ReferenceError"), ("duplicate", "DuplicateId"), ("missing property", "SchemaError"), ("must be", "TypeError"),
    ("enumeration", "ConstraintError"), ("narrow", "ConstraintError"), ("inherited", "ConstraintError"), ("traits", "ConstraintError"), ("offset", "ConstraintError"),
    ("GMQL4003", "TypeError"), ("joins", "ConstraintError"), ("no node", "ReferenceError"),
)


def said(path: str, severity: str, message: str, text: str, start: int, end: int) -> dict:
    """A diagnostic with its category and the stretch of the document, in code points, that it is about."""
    category = next((c for k, c in CATEGORIES if k in message), "SyntaxError")
    return {"path": path, "severity": severity, "message": message, "category": category, "line": text.count("\n", 0, start) + 1, "start": start, "end": end}


def _system(head: dict, problems: Problems) -> tuple[str, dict]:
    """The coordinate system of a timeline document and what it needs to know."""
    c = head.get("coordinate", "number")
    spec = {"kind": c} if isinstance(c, str) else dict(c)
    kind = str(spec.pop("kind", "number"))
    if kind == "calendar":
        return ("julian" if spec.get("calendar") == "julian" else "gregorian"), spec
    if kind != "calendar-pattern":
        if kind not in ("number", "gregorian", "julian", "frame", "timecode", "era"):
            problems.add(f"unknown coordinate {kind}", ("coordinate", "kind"))
            kind = "number"
        return kind, spec
    fields = [str(f) for f in spec.get("fields") or []]
    repeats = spec.get("repeatsEvery")
    wrong = not fields or set(fields) - set(temporal.FIELDS) or bool({"year", "weekYear"} & set(fields)) == bool(repeats)
    wrong = wrong or "day" in fields and "month" not in fields or {"week", "weekYear"} & set(fields) and {"year", "month", "day", "quarter"} & set(fields)
    if wrong or repeats and set(fields) not in ({"month", "day"}, {"month"}, {"quarter"}, {"week"}):
        problems.add(f"coordinate fields {fields} do not go together", ("coordinate", "fields"))
    return ("pattern" if repeats else "dates"), spec | {"fields": fields}


def _times(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _mapping(ident: str, m: dict, known: dict[str, Timeline], problems: Problems) -> temporal.Mapping | None:
    """A map of a timeline document; its coordinates are those of the timelines at its two ends."""
    other = str(m.get("timeline") or m.get("to"))
    if other not in known:
        problems.add(f"unknown timeline {other}", ("timeline" if m.get("timeline") else "to",))
        return None
    a, b = known[ident], known[other]

    def at(t: Timeline, x) -> Fraction | None:
        return None if x is None else temporal.span(t, x).lo

    def ends(t: Timeline, r) -> tuple:
        return (at(t, r.get("from")), at(t, r.get("to"))) if r else (None, None)

    q = lambda x: Fraction(str(x))
    try:
        precision = m.get("precision", "exact")
        precision = precision if isinstance(precision, dict) else {"kind": precision}
        segments = tuple(temporal.Segment(ends(a, g.get("source")), ends(b, g.get("target")), q(g.get("scale", 1)), q(g.get("offset", 0))) for g in m.get("segments") or [])
        pairs = tuple((at(a, p["from"]), tuple(at(b, x) for x in _times(p.get("to")))) for p in m.get("pairs") or [])
        t = m.get("traits") or {}
        many = {"one-to-one": (False, False), "many-to-one": (True, False), "one-to-many": (False, True), "many-to-many": (True, True)}
        order = {"strictly-increasing": "strict", "strictly-decreasing": "falling", "monotonic": "monotonic", "non-monotonic": "none"}
        told = {
            "many": many.get(t.get("cardinality")), "total": {"total": True, "partial": False}.get(t.get("totality")), "order": order.get(t.get("order")),
            "invertible": {"invertible": True, "non-invertible": False}.get(t.get("invertibility")), "form": t.get("continuity"),
        }
        out = temporal.Mapping(
            a.axis, b.axis, q(m.get("scale", 1)), q(m.get("offset", 0)), *ends(a, m.get("range")), str(precision.get("kind", "exact")),
            None if precision.get("error") is None else q(precision["error"]), segments, pairs, tuple(map(str, m.get("requires") or ())),
            tuple((k, v) for k, v in told.items() if v is not None),
        )
    except (QueryError, ValueError, KeyError, AttributeError) as e:
        problems.add(f"mapsTo {other}: {e}")
        return None
    if out.precision not in temporal.PRECISION:
        problems.add(f"unknown precision {out.precision}", ("precision",))
        return None
    for x in out.traits()[1]:
        problems.add(f"traits of mapsTo {other}: {x} is more than the map gives", ("traits",))
    return out


@dataclass
class _Declared:
    """A document that declares a type or a timeline."""

    path: str
    text: str
    head: dict
    problems: Problems


def catalogs(docs: DataFrame) -> tuple[dict, list[dict]]:
    """Types and timelines out of the documents that declare them, and diagnostics; only these documents reach the driver.

    Ids that stand more than once among the documents of a kind are left out. A timeline lies on its own axis, or with
    sameAxisAs or derivedFrom on another's; derivedFrom may have a scale and an offset: coordinate = parent's * scale +
    offset. An era counts the days of its parent's calendar.
    """
    out: dict = {"node_types": {}, "rel_types": {}, "timelines": {}, "properties": {}, "endpoints": {}}
    diagnostics: list[dict] = []
    rows = docs.where(DECLARES).orderBy("path").toLocalIterator()
    heads: dict[tuple[str, str], list[_Declared]] = {}
    for r in rows:
        if split(r["text"]) is None:
            continue
        try:
            head, places = head_of(r["text"])
        except yaml.YamlError:  # said where the documents are parsed
            continue
        if head.get("kind") in ("NodeType", "RelType", "Timeline") and _ID.fullmatch(str(head.get("id") or "")):
            heads.setdefault((head["kind"], str(head["id"])), []).append(_Declared(r["path"], r["text"], head, Problems(places)))
    for (_, ident), xs in heads.items():
        for x in xs if len(xs) > 1 else ():
            x.problems.add(f"duplicate id {ident}", ("id",))
    single = {k: xs[0] for k, xs in heads.items() if len(xs) == 1}
    own: dict[str, dict] = {"NodeType": {}, "RelType": {}}
    lines: dict[str, _Declared] = {}
    for (kind, ident), x in single.items():
        head = x.head
        if kind == "Timeline":
            lines[ident] = x
            continue
        out["node_types" if kind == "NodeType" else "rel_types"][ident] = tuple(map(str, _times(head.get("extends"))))
        own[kind][ident] = {str(k): schema.Schema.of(v) for k, v in (head.get("props") or {}).items()}
        if kind == "RelType":
            ends = [head.get(k) for k in ("sources", "targets")]
            out["endpoints"][ident] = tuple(None if e is None else tuple(map(str, _times(e))) for e in ends)
    out["schemas"] = {}
    for kind, key in (("NodeType", "node_types"), ("RelType", "rel_types")):
        above = ops.ancestors(out[key])
        for t, ups in out[key].items():
            mine = single[kind, t].problems.under(("extends",))
            for i, u in enumerate(ups):
                if u not in out[key]:
                    mine.add(f"unknown type {u}", (i,))
            if ups and not above[t] and any(u in out[key] for u in ups):
                mine.add(f"{t} extends itself")
        schemas, found = schema.resolve({t: ups if above[t] else () for t, ups in out[key].items()}, own[kind], above)
        out["schemas"] |= schemas
        for t, m in found:
            single[kind, t].problems.add(m, ("props", m.split()[1]))  # "property <name> ..."
        for t, ps in own[kind].items():
            out["properties"][t] = {p: s.kind or "any" for p, s in ps.items()}
    _narrow_ends(out, {t: x.problems for (kind, t), x in single.items() if kind == "RelType"})

    known = out["timelines"]

    def timeline(ident: str, seen: tuple[str, ...] = ()) -> Timeline | None:
        """The timeline, after the one that it lies on."""
        if ident in known:
            return known[ident]
        if ident not in lines or ident in seen:
            return None
        head, wrong = lines[ident].head, lines[ident].problems
        system, spec = _system(head, wrong)
        derived = head.get("derivedFrom")
        derived = derived if isinstance(derived, dict) else {"timeline": derived} if derived else {}
        other = head.get("sameAxisAs") or derived.get("timeline")
        parent = timeline(str(other), (*seen, ident)) if other else None
        if other and parent is None:
            wrong.add(f"unknown timeline {other}", ("sameAxisAs",) if head.get("sameAxisAs") else ("derivedFrom", "timeline"))
        axis, scale, offset, real = parent.axis if parent else ident, Fraction(1), Fraction(str(head.get("offset") or 0)), None
        if derived and system == "number" and parent:
            k = Fraction(str(derived.get("scale", 1))) or Fraction(1)
            scale, offset = parent.scale / k, parent.offset - Fraction(str(derived.get("offset", 0))) * parent.scale / k
        if system == "pattern":
            axis, real = f"~{ident}", axis
        if system == "era":
            spec["of"] = json.loads(parent.spec or "{}") | {"calendar": parent.system} if parent and parent.system in ("gregorian", "julian") else {}
        try:
            known[ident] = Timeline(ident, axis, system, scale, offset, real, json.dumps(spec, sort_keys=True, default=str))
            temporal.system_of(known[ident])
        except (KeyError, TypeError, ValueError) as e:
            wrong.add(f"unknown coordinate of {ident}: {e}", ("coordinate",))
            known[ident] = Timeline(ident, axis)
        return known[ident]

    maps: list[temporal.Mapping] = []
    edges = []
    for ident in lines:
        timeline(ident)
    for ident, x in lines.items():
        several = isinstance(x.head.get("mapsTo"), list)
        for i, m in enumerate(_times(x.head.get("mapsTo"))):
            one = _mapping(ident, m if isinstance(m, dict) else {"timeline": m}, known, x.problems.under(("mapsTo", i) if several else ("mapsTo",)))
            maps += [one] if one else []
        several = isinstance(x.head.get("mappings"), list)
        for i, m in enumerate(_times(x.head.get("mappings"))):
            ends = (ident, str(m["to"])) if m.get("to") else (str(m.get("from")), ident)
            if not set(ends) <= set(known):
                x.problems.add(f"unknown timeline {ends[0] if ends[1] == ident else ends[1]}", (*(("mappings", i) if several else ("mappings",)), "to" if m.get("to") else "from"))
            else:
                edges.append((*ends, Fraction(str(m.get("offset", 0)))))
    for a, b in temporal.offsets(edges)[1]:
        lines[a].problems.add(f"offset from {a} to {b} differs by the way that is taken", ("mappings",))
    maps += [temporal.Mapping(known[a].axis, known[b].axis, offset=k) for a, b, k in edges if known[a].axis != known[b].axis]
    out["mappings"] = tuple(maps)
    for xs in heads.values():
        for x in xs:
            diagnostics += [said(x.path, "error", message, x.text, start, end) for message, start, end in dict.fromkeys(x.problems.found)]
    return out, diagnostics


def _narrow_ends(out: dict, problems: dict[str, Problems]) -> None:
    """A relation type's ends lie within those of the types above it."""
    above = ops.ancestors(out["rel_types"])
    types = {t: {t, *up} for t, up in ops.ancestors(out["node_types"]).items()}
    for t, ends in list(out["endpoints"].items()):
        merged = []
        for i, mine in enumerate(ends):
            for up in above.get(t, ()):
                theirs = out["endpoints"].get(up, (None, None))[i]
                if mine is None:
                    mine = theirs
                elif theirs is not None and not all(types.get(x, {x}) & set(theirs) for x in mine):
                    problems[t].add(f"ends of {t} do not narrow those of {up}", (("sources", "targets")[i],))
            merged.append(mine)
        out["endpoints"][t] = tuple(merged)


#: What _rows() gives of a document: a column for each, an array of rows.
_MADE = {
    "node": ops.NODES, "prop": ops.PROPS, "rel": ops.RELS, "text": ops.TEXTS, "place": "what string, id string, source string, line int, start int, end int",
    "diagnostic": "path string, severity string, message string, category string, line int, start int, end int",
}
_PARSED = 1000  #: documents that leave a parsing task together
_S, _I = pa.string(), pa.int32()
_CUT = pa.struct([("w", pa.int64()), ("f", pa.decimal128(38, 37)), ("s", _I)])
_VALIDITY = pa.struct([("universal", pa.bool_()), ("ivs", pa.list_(pa.struct([("axis", _S), ("lo", _CUT), ("hi", _CUT)])))])
_LANES = [("tag", _S), ("s", _S), ("i", pa.int64()), ("d", pa.float64()), ("b", pa.bool_())]
#: Columns of other types than string.
_TYPES = {
    "types": pa.list_(_S), "value": pa.struct([*_LANES, ("items", pa.list_(pa.struct(_LANES)))]), "valid": _I, "fallback": pa.bool_(), "line": _I, "start": _I, "end": _I,
}


def _kept_sql(name: str) -> str:
    """The fields of a kept row; its validity is a number among those of its document."""
    return re.sub(r"\bvalid struct<.*?>>>>", "valid int", _MADE[name])


def _struct(columns: str) -> str:
    """The type of rows with these columns."""
    return "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2: ", columns) + ">"


def _parsed(some: pa.RecordBatch, graph: dict) -> pa.RecordBatch:
    """Documents (path, text) as a row each: the validities that their rows name, and an array for each name of _MADE."""
    made: dict[str, list[tuple]] = {name: [] for name in _MADE}
    ends: dict[str, list[int]] = {name: [0] for name in _MADE}
    valids, valid_ends = [], [0]
    for path, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
        mine: list[dict] = []
        for name, row in _rows(path, text or "", graph, mine):
            made[name].append(row)
        valids += mine
        for name, rows in made.items():
            ends[name].append(len(rows))
        valid_ends.append(len(valids))
    number: dict[int, int] = {}
    for v in valids:
        number.setdefault(id(v), len(number))
    distinct = pa.array({id(v): v for v in valids}.values(), _VALIDITY)
    columns = [pa.ListArray.from_arrays(pa.array(valid_ends, _I), distinct.take(pa.array([number[id(v)] for v in valids], _I)))]
    for name, rows in made.items():
        fields = [f.split()[0] for f in _kept_sql(name).split(", ")]
        arrays = [pa.array(c, _TYPES.get(f, _S)) for f, c in zip(fields, zip(*rows, strict=True) if rows else [()] * len(fields), strict=True)]
        columns.append(pa.ListArray.from_arrays(pa.array(ends[name], _I), pa.StructArray.from_arrays(arrays, fields)))
    return pa.RecordBatch.from_arrays(columns, names=["valids", *_MADE])


def load(docs: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of documents (path, text), and diagnostics (path, severity, message, category, line, start, end): start and
    end in code points of the document.

    Ids that stand more than once among nodes are left out, each with a diagnostic; relations to unknown nodes stay, and
    match nothing; relations between nodes of other types than theirs are diagnosed and kept. Properties become texts
    too, and fallbacks hold where no timed value does. What the documents give is kept on disk once they are parsed, for as
    long as the session lives or until release().
    """
    spark = docs.sparkSession
    cat, declared_badly = catalogs(docs)
    closed = {
        "timelines": cat["timelines"],
        "node_types": {t: (t, *up) for t, up in ops.ancestors(cat["node_types"]).items()},
        "rel_types": {t: (t, *up) for t, up in ops.ancestors(cat["rel_types"]).items()},
        "schemas": cat["schemas"],
    }

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _PARSED):
                yield _parsed(batch.slice(i, _PARSED), closed)

    # files are cut by bytes, and a small one holds more documents than one task should parse
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = docs.select("path", "text").repartition(parts, "path")
    shape = ", ".join(f"{name} array<{_struct(_kept_sql(name))}>" for name in _MADE)
    parsed = spread.mapInArrow(run, f"valids array<{iv.VALIDITY}>, {shape}").persist(StorageLevel.DISK_ONLY)

    def table(name: str) -> DataFrame:
        rows = parsed.select(*(["valids"] if "valid " in _MADE[name] else []), F.inline(name))
        return rows.select(*[F.expr("get(valids, valid)").alias(c) if c == "valid" else F.col(c) for c in rows.columns if c != "valids"])

    nodes, found, places = table("node"), table("diagnostic"), table("place")

    def note(df: DataFrame, what: str, severity: str, message, category: str) -> DataFrame:
        """Diagnostics of (id, source) at what their documents hold under the id."""
        at = places.where(F.col("what") == what).drop("what")
        shown = [F.col("source").alias("path"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(category).alias("category"), "line", "start", "end"]
        return df.join(at, ["id", "source"]).select(*shown)

    twice = ops.duplicate_ids(nodes.select(F.lit("Node").alias("kind"), "id"))
    bad = note(nodes.join(twice.select("id"), "id"), "node", "error", F.concat(F.lit("duplicate id "), "id"), "DuplicateId")
    nodes = nodes.join(twice.select("id"), "id", "left_anti").select(*nodes.columns)
    rels = table("rel")
    props = ops.resolve_fallbacks(table("prop"), list(dict.fromkeys(t.axis for t in cat["timelines"].values())))
    texts = table("text")
    texts = texts.unionByName(ops.derived_texts(props, rels))
    diagnostics = found.unionByName(bad)
    if declared_badly:
        diagnostics = diagnostics.unionByName(spark.createDataFrame([tuple(x.values()) for x in declared_badly], _MADE["diagnostic"]))
    declared = {(t, p): k for t, ps in cat["properties"].items() for p, k in ps.items()}
    g = Graph(spark, nodes, rels, props, texts, cat["node_types"], cat["rel_types"], declared, cat["endpoints"], cat["timelines"], cat["mappings"])
    of = lambda df: df.join(rels.select("rel_id", "source"), "rel_id").withColumnRenamed("rel_id", "id")
    diagnostics = diagnostics.unionByName(note(of(ops.dangling(g)).withColumnRenamed("end", "end_of"), "dst", "warning", F.concat("id", F.lit(": "), "end_of", F.lit(" is no node")), "ReferenceError"))
    for t, ends in cat["endpoints"].items():
        if ends != (None, None):
            diagnostics = diagnostics.unionByName(note(of(ops.endpoint_errors(g, t)), "rel", "warning", F.concat("id", F.lit(f": {t} joins nodes of other types")), "ConstraintError"))
    g.parsed = parsed
    return g, diagnostics


def release(graph: Graph) -> None:
    """Frees what load() keeps of the documents; the graph can still be read, and parses them again."""
    if graph.parsed is not None:
        graph.parsed.unpersist()
