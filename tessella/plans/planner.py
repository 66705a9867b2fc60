"""Queries of the pattern language as DataFrame plans.

A row is a binding: a struct for each variable, its validity `_b` and its score. Patterns join equal ids and intersect
validities; each expression adds columns that the next one names, so no expression is written twice into a plan. What a
property holds is looked up once for each property and owner, with the filter on the path pushed into the scan. A boolean is
two validities: when it is true and when it was evaluated. Mistakes in a query become diagnostics; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import calendar, temporal
from tessella.functions import intervals as iv
from tessella.functions.values import ENTRY, VALUE, arithmetic_sql, literal_sql, plain_test_sql, quoted, same_sql, test_sql, value_sql
from tessella.operators import postings
from tessella.operators.graph import Graph, ancestors, kept, titles
from tessella.plans import syntax as S
from tessella.plans.syntax import QueryError

ENTRIES = f"array<{ENTRY.format(v=VALUE, t=iv.VALIDITY)}>"
#: Pseudo fields and the kinds of text that they show.
PSEUDO = {"title": ("TITLE",), "body": ("HEADING", "PARAGRAPH", "CODE"), "label": ("RELATION_LABEL",)}
#: Functions and their numbers of arguments.
FUNCTIONS = {
    "FULLTEXT": (2, 2), "EXISTS": (1, 1), "ID": (1, 1), "TYPE": (1, 1), "KIND": (1, 1), "TITLE": (1, 1), "SOURCE": (1, 1), "START_NODE": (1, 1),
    "END_NODE": (1, 1), "TYPE_REF": (1, 1), "REL_TYPE_REF": (1, 1), "SCORE": (0, 0), "VALIDITY": (0, 1), "MATCHED_VALIDITY": (0, 0),
}
#: Limits of the execution profiles on result rows, and on the bindings of the patterns.
PROFILES = {"REFERENCE": None, "STATIC_WEB": 10_000, "SERVER": 100_000}
BINDINGS = {"REFERENCE": None, "STATIC_WEB": 100_000, "SERVER": 1_000_000}
_TURNED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_COMPARE = ("=", "!=", "<", "<=", ">", ">=", "STARTS WITH", "ENDS WITH", "CONTAINS")


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    at: int = 0


@dataclass
class Result:
    rows: DataFrame | None
    diagnostics: list[Diagnostic] = field(default_factory=list)


@dataclass(frozen=True)
class Value:
    """Entries (value, time) in a column; a scalar has one."""

    entries: str
    temporal: bool
    kind: str  # declared type, or any


@dataclass(frozen=True)
class Truth:
    """Columns of the time when it is true and of the time when it was evaluated."""

    true: str
    evaluated: str
    temporal: bool
    score: str = "0.0D"


def conjuncts(x) -> list:
    return [*conjuncts(x.x), *conjuncts(x.y)] if isinstance(x, S.Binary) and x.op == "AND" else [x]


def pattern_variables(p: list):
    """(name, what, type) of the variables of a pattern."""
    for x in p:
        if x.var:
            yield x.var, "relation" if isinstance(x, S.RelPattern) else "node", x.type


def wanted_properties(query: S.Query) -> dict[str, set[str]]:
    """The paths that a query names, by variable."""
    out: dict[str, set[str]] = {}

    def walk(x) -> None:
        if isinstance(x, S.Prop):
            out.setdefault(x.var, set()).add(x.path)
        elif is_dataclass(x) and not isinstance(x, type):
            for f in fields(x):
                walk(getattr(x, f.name))
        elif isinstance(x, (list, tuple)):
            for y in x:
                walk(y)

    walk(query)
    return out


class Plan:
    def __init__(self, graph: Graph, query: S.Query, params: dict, profile: str):
        self.g, self.q, self.params, self.most, self.bindings = graph, query, params, PROFILES[profile], BINDINGS[profile]
        self.node_types = {t: (t, *up) for t, up in ancestors(graph.node_types).items()}
        self.rel_types = {t: (t, *up) for t, up in ancestors(graph.rel_types).items()}
        self.vars: dict[str, tuple[str, str | None]] = {}
        self.count = 0
        self.df: DataFrame | None = None
        self.wanted = wanted_properties(query)
        self.filters: dict[str, list[tuple[str, str]]] = {}  # by variable: (path or ID, test on it) that whole rows must pass
        self.idents: dict[str, str] = {}
        self.coarse: str | None = None
        self.coarse_set: iv.IntervalSet | None = None

    # recurrence

    def days(self) -> tuple[int, int] | None:
        """The first day of WITHIN and the day after its last."""
        v = self.q.valid
        if v is None or v.within is None:
            return None
        r = v.within
        if r.lo is None or r.hi is None or not r.lo_inc or r.hi_inc:
            raise QueryError("GMQL4005", "WITHIN needs a window [start, end)")
        day = lambda x: x.value if isinstance(x, S.Lit) else self.params.get(x.name) if isinstance(x, S.Param) else None
        try:
            lo, hi = calendar.day_number(day(r.lo)), calendar.day_number(day(r.hi))
        except (TypeError, QueryError):
            raise QueryError("GMQL4005", "WITHIN needs dates") from None
        if lo >= hi or calendar.year_of(hi - 1) - calendar.year_of(lo) >= 10_000:
            raise QueryError("GMQL4005", "the window is empty or too long")
        return lo, hi

    def spelt(self, df: DataFrame) -> DataFrame:
        """df with the recurring times of `valid` spelt out in the window, if the query gives one."""
        window = self.days()
        if window:
            years = calendar.year_of(window[0]), calendar.year_of(window[1] - 1)
            for t in self.g.timelines.values():
                if t.system == "pattern":
                    df = df.withColumn("valid", F.expr(f"CAST({iv.recur_sql('valid', t.axis, t.real, years, *window)} AS {iv.VALIDITY})"))
        return df

    # columns

    def column(self, sql: str, kind: str) -> str:
        self.count += 1
        name = f"_c{self.count}"
        self.df = self.df.withColumn(name, F.expr(f"CAST({sql} AS {kind})"))
        return name

    # patterns

    def own(self, var: str | None) -> list[str]:
        """The paths of a variable that its own row holds and that the query names."""
        return sorted(p for p in self.wanted.get(var or "", ()) if p in self.g.own)

    def held_rows(self, df: DataFrame, var: str | None) -> DataFrame:
        """df without the rows that cannot be bound: by tests on their own values, and by the query's window.

        The window's test is coarse: a universal time passes, the exact one comes when the binding is whole.
        """
        for path, test in self.filters.get(var or "", ()):
            df = df.where(test.replace("{x}", f"own.`{path}`"))
        if self.coarse is not None:
            df = self.g.candidates(df, self.coarse_set).where(self.coarse)
        return df

    def row(self, var: str | None, *columns) -> F.Column:
        return F.struct(*columns, *[F.col(f"own.`{p}`").alias(f"own.{p}") for p in self.own(var)])

    def nodes(self, kind: str | None, var: str | None = None) -> DataFrame:
        df = self.spelt(self.g.with_id("nodes", "id", self.idents[var]) if var in self.idents else self.g.nodes)
        if kind is not None:
            if kind not in self.node_types:
                raise QueryError("GMQL2001", f"unknown node type {kind}")
            df = df.where(F.array_contains("types", kind))
        df = self.held_rows(df, var)
        return df.select(self.row(var, "id", "type_id", "kind", "source").alias("_e"), F.col("id").alias("_id"), F.col("valid").alias("_v"))

    def rels(self, kind: str | None, direction: str, var: str | None = None) -> DataFrame:
        df = self.spelt(self.g.rels)
        if kind is not None:
            if kind not in self.rel_types:
                raise QueryError("GMQL2002", f"unknown relation type {kind}")
            df = df.where(F.array_contains("types", kind))
        df = self.held_rows(df, var)
        row = [self.row(var, F.col("rel_id").alias("id"), "type_id", "src", "dst", "source").alias("_r"), F.col("valid").alias("_v")]
        out = df.select("src", "dst", *row)
        if direction == "in":
            return df.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *row)
        forward = out.withColumnsRenamed({"src": "_from", "dst": "_to"})
        if direction == "out":
            return forward
        # both ways; a loop once
        return forward.unionByName(df.where("src <> dst").select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *row))

    def bind(self, var: str | None, what: str, kind: str | None) -> tuple[str, bool]:
        """The column of a variable, and whether it was bound before."""
        if var is None:
            self.count += 1
            return f"_x{self.count}", False
        if var in self.vars:
            if self.vars[var][0] != what:
                raise QueryError("GMQL2003", f"{var} is a {self.vars[var][0]}")
            return var, True
        self.vars[var] = (what, kind)
        return var, False

    def meet(self, df: DataFrame) -> DataFrame:
        """The binding's validity intersected with _v; bindings that never hold go."""
        return kept(df, "_b", iv.intersect_sql("_b", "_v"), iv.some_sql("v")).drop("_v")

    def add_node(self, p: S.NodePattern, key: str | None) -> str:
        """Joins a node: by the id in column `key`, or a first one.

        A node that is bound already has been met with its times; only another type is still to be looked at.
        """
        name, bound = self.bind(p.var, "node", p.type)
        if bound:
            if key is not None:
                self.df = self.df.where(F.col(key) == F.col(f"`{name}`.id")).drop(key)
            if p.type in (None, self.vars[name][1]):
                return name
        nodes = self.nodes(p.type, name)
        if bound:
            self.df = self.meet(self.df.join(nodes.drop("_e"), self.df[name]["id"] == F.col("_id")).drop("_id"))
        elif self.df is None:
            self.df = nodes.select(F.col("_e").alias(name), F.col("_v").alias("_b"), F.lit(0.0).alias("_score"))
        elif key is None:  # at a relation that is bound already and may be passed either way
            self.df = self.meet(self.df.crossJoin(nodes.select(F.col("_e").alias(name), "_v")))
        else:
            self.df = self.meet(self.df.join(nodes, F.col(key) == F.col("_id")).withColumnRenamed("_e", name).drop("_id", key))
        return name

    def add_pattern(self, items: list) -> None:
        """Joins a pattern from its first node on; that one is bound, or its relation is, or nothing."""
        key = None
        if self.df is not None and items[0].var not in self.vars and items[1].var in self.vars and items[1].direction != "either":
            self.count += 1
            key = f"_to{self.count}"
            self.df = self.df.withColumn(key, F.col(f"`{items[1].var}`.{'src' if items[1].direction == 'out' else 'dst'}"))
        here = self.add_node(items[0], key)
        for rel, node in zip(items[1::2], items[2::2], strict=True):
            name, bound = self.bind(rel.var, "relation", rel.type)
            rels = self.rels(rel.type, rel.direction, name)
            if bound:
                rels = rels.withColumn("_rid", F.col("_r.id"))
                self.df = self.df.join(rels, (self.df[here]["id"] == rels["_from"]) & (self.df[name]["id"] == rels["_rid"])).drop("_r", "_rid", "_from")
            else:
                self.df = self.df.join(rels, self.df[here]["id"] == rels["_from"]).withColumnRenamed("_r", name).drop("_from")
            self.df = self.meet(self.df)
            self.bounded()
            self.count += 1
            key = f"_to{self.count}"
            self.df = self.df.withColumnRenamed("_to", key)
            here = self.add_node(node, key)

    def bounded(self) -> None:
        """Refuses more bindings than the profile allows, as soon as a join gives them; the count stops there."""
        if self.bindings is not None and self.df.limit(self.bindings + 1).count() > self.bindings:
            raise QueryError("GMQL5001", f"more than {self.bindings} bindings")

    def add_patterns(self, patterns: list[list]) -> None:
        """Joins all patterns: those that share variables, however indirectly, among themselves along these; what shares
        none as every pair in the end, each part being complete by then."""
        parts = []
        for group in connected(patterns):
            self.df = None
            for p in self.joinable(group):
                self.add_pattern(p)
            parts.append(self.df)
        self.df = parts[0]
        for other in parts[1:]:
            self.df = self.meet(self.df.crossJoin(other.drop("_score").withColumnRenamed("_b", "_v")))
            self.bounded()

    def check_patterns(self) -> None:
        """Says what is wrong with the patterns, in the order in which they are written."""
        seen: dict[str, str] = {}
        for p in self.q.patterns:
            for i, x in enumerate(p):
                what, known, code = ("node", self.node_types, "GMQL2001") if isinstance(x, S.NodePattern) else ("relation", self.rel_types, "GMQL2002")
                if x.var and seen.setdefault(x.var, what) != what:
                    raise QueryError("GMQL2003", f"{x.var} is a {seen[x.var]}")
                if x.type is not None and x.type not in known:
                    raise QueryError(code, f"unknown {what} type {x.type}")
                if what == "relation":
                    self.check_ends(x, p[i - 1], p[i + 1])

    def check_ends(self, rel: S.RelPattern, left: S.NodePattern, right: S.NodePattern) -> None:
        ends = self.g.endpoints.get(rel.type or "")
        if not ends:
            return

        def fits(node: S.NodePattern, allowed) -> bool:
            if node.type is None or allowed is None or node.type not in self.node_types:
                return True
            below = {t for t, up in self.node_types.items() if node.type in up}
            return any(a in self.node_types[node.type] or a in below for a in allowed)

        out, back = fits(left, ends[0]) and fits(right, ends[1]), fits(right, ends[0]) and fits(left, ends[1])
        if not {"out": out, "in": back, "either": out or back}[rel.direction]:
            raise QueryError("GMQL3005", f"{rel.type} does not join these types")

    # expressions

    def scalar(self, value: str, kind: str) -> Value:
        return Value(self.column(f"array(named_struct('v', {value}, 't', _b))", ENTRIES), False, kind)

    def entity(self, x, what: str | None = None) -> str:
        if not isinstance(x, S.Var):
            raise QueryError("GMQL3007", "a variable is needed")
        if x.name not in self.vars:
            raise QueryError("GMQL2005", f"unknown variable {x.name}")
        if what and self.vars[x.name][0] != what:
            raise QueryError("GMQL3007", f"{x.name} is no {what}")
        return x.name

    def property(self, x: S.Prop) -> Value:
        if x.var not in self.vars:
            raise QueryError("GMQL2005", f"unknown variable {x.var}")
        kinds = {k for (t, p), k in self.g.properties.items() if p == x.path}
        top = x.path.split(".")[0]
        if not kinds and x.path not in PSEUDO and not any(p.split(".")[0] == top for _, p in self.g.properties):
            raise QueryError("GMQL2006", f"unknown property {x.path}")
        if x.path in self.g.own and x.path not in PSEUDO and x.path in self.own(x.var):
            # its own row says it, for as long as it is valid itself
            v = f"`{x.var}`.`own.{x.path}`"
            entries = self.column(f"CASE WHEN {v}.tag IS NULL THEN array() ELSE array(named_struct('v', {v}, 't', _b)) END", ENTRIES)
            return Value(entries, True, min(kinds) if len(kinds) == 1 else "any")
        rows = self.spelt(self.g.props.where(F.col("path") == x.path)).select("owner", F.struct(F.col("value").alias("v"), F.col("valid").alias("t")).alias("e"))
        entries = self.fetch(x.var, rows)
        if x.path in PSEUDO:
            own = F.expr(f"struct(CAST({value_sql('string', 'text')} AS {VALUE}) AS v, valid AS t)")
            shown = self.fetch(x.var, self.spelt(self.g.texts.where(F.col("kind").isin(*PSEUDO[x.path]))).select("owner", own.alias("e")))
            entries = self.column(f"CASE WHEN size({entries}) > 0 THEN {entries} ELSE {shown} END", ENTRIES)
        return Value(entries, True, min(kinds) if len(kinds) == 1 else "any")

    # conditions that rows or joins can decide

    def literal(self, x):
        """A literal or parameter as (value,); None for all else."""
        if isinstance(x, S.Param):
            return (self.params[x.name],) if x.name in self.params else None
        return (x.value,) if isinstance(x, S.Lit) else None

    def simple(self, x) -> tuple[str, str, str, tuple] | None:
        """(variable, path or ID, operator, literal) of a comparison of a property or an id with a literal."""
        if not isinstance(x, S.Binary) or x.op not in (*_COMPARE, "IN"):
            return None
        a, op, b = x.x, x.op, x.y
        if self.literal(a) is not None and op in _TURNED:
            a, op, b = b, _TURNED[op], a
        value = self.literal(b)
        if value is None or value[0] is None:
            return None
        if op == "IN" and not isinstance(value[0], (list, tuple)):
            return None
        if isinstance(a, S.Call) and a.name == "ID" and len(a.args) == 1 and isinstance(a.args[0], S.Var) and op == "=" and isinstance(value[0], str):
            return a.args[0].name, "ID", op, value
        if isinstance(a, S.Prop) and a.path not in PSEUDO:
            return a.var, a.path, op, value
        return None

    def test(self, x: str, op: str, y) -> str:
        """SQL for a value against a literal; the plain form goes first, for scans."""
        if op == "IN":
            return "(" + (" OR ".join(f"({x}.tag <> 'null' AND {same_sql(x, literal_sql(v))})" if plain_test_sql(x, "=", v) is None or isinstance(v, float) else self.same_plain(x, v) for v in y if v is not None) or "false") + ")"
        return plain_test_sql(x, op, y) or test_sql(x, op, literal_sql(y))

    @staticmethod
    def same_plain(x: str, v) -> str:
        return f"({x}.tag = 'string' AND {x}.s = {quoted(v)})" if isinstance(v, str) else f"({x}.tag = 'integer' AND {x}.i = {v}L)"

    def plan_conditions(self) -> list:
        """Splits the condition's conjuncts: those on an entity's own values filter its rows, an id narrows the scan; gives
        the rest. All still count as conditions on the types of what they compare."""
        rest = []
        for x in conjuncts(self.q.where):
            found = self.simple(x)
            kinds = {v: (what, kind) for p in self.q.patterns for v, what, kind in pattern_variables(p)}
            if found is None or found[0] not in kinds:
                rest.append(x)
                continue
            var, path, op, value = found
            if path == "ID":
                if kinds[var][0] == "node":
                    self.idents.setdefault(var, value[0])
                rest.append(x)
            elif path in self.g.own and self.comparable(path, op, value[0]):
                self.filters.setdefault(var, []).append((path, self.test("{x}", op, value[0])))
            else:
                rest.append(x)
        return rest

    def comparable(self, path: str, op: str, value) -> bool:
        """Whether a comparison is free of mistakes; one with a mistake is left to compare(), which says what it is."""
        kinds = {k for (t, p), k in self.g.properties.items() if p == path}
        if not kinds:
            return False
        kind = min(kinds) if len(kinds) == 1 else "any"
        other = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number" if isinstance(value, (int, float)) else "any"
        return op not in ("<", "<=", ">", ">=") or "any" in (kind, other) or kind == other

    def restrict(self, x) -> str | None:
        """The time in which a simple comparison holds, for bindings that have any, by a join with the assertions that
        satisfy it; None if it is not simple."""
        found = self.simple(x)
        if found is None or found[1] == "ID" or found[1] in self.g.own or found[0] not in self.vars:
            return None
        var, path, op, (value,) = found
        if not any(p == path for _, p in self.g.properties) or not self.comparable(path, op, value):
            return None
        rows = self.spelt(self.g.props.where(F.col("path") == path).where(self.test("value", op, value)))
        self.count += 1
        name = f"_h{self.count}"
        hits = rows.groupBy(F.col("owner").alias(f"{name}k")).agg(F.collect_list("valid").alias(f"{name}v"))
        self.df = self.df.join(hits, F.col(f"`{var}`.id") == F.col(f"{name}k")).drop(f"{name}k")
        times = self.column(iv.union_all_sql(f"{name}v"), iv.VALIDITY)
        self.df = self.df.drop(f"{name}v")
        return self.column(iv.intersect_sql(times, "_b"), iv.VALIDITY)

    def fetch(self, var: str, rows: DataFrame) -> str:
        """The entries (owner, e) of a variable's entity, clipped to the binding."""
        self.count += 1
        name = f"_p{self.count}"
        grouped = rows.groupBy(F.col("owner").alias(f"{name}k")).agg(F.collect_list("e").alias(name))
        self.df = self.df.join(grouped, F.col(f"`{var}`.id") == F.col(f"{name}k"), "left").drop(f"{name}k")
        clip = f"transform(coalesce({name}, array()), e -> named_struct('v', e.v, 't', {iv.intersect_sql('e.t', '_b')}))"
        out = self.column(f"filter({clip}, e -> {iv.some_sql('e.t')})", ENTRIES)
        self.df = self.df.drop(name)
        return out

    def presence(self, x) -> str:
        if isinstance(x, Truth):
            return x.evaluated
        return self.column(iv.union_all_sql(f"transform({x.entries}, e -> e.t)"), iv.VALIDITY)

    def when_evaluated(self) -> str:
        return self.column(iv.within_sql("_b", self.g.axes), iv.VALIDITY)

    def truth(self, x) -> Truth:
        if isinstance(x, Truth):
            return x
        if x.kind not in ("boolean", "any"):
            raise QueryError("GMQL3001", "a condition is needed")
        times = f"transform(filter({x.entries}, e -> e.v.tag = 'boolean' AND e.v.b), e -> e.t)"
        return Truth(self.column(iv.union_all_sql(times), iv.VALIDITY), self.presence(x), x.temporal)

    def true_time(self, x) -> str:
        t = self.truth(x)
        if t.temporal:
            return self.column(iv.intersect_sql(t.true, "_b"), iv.VALIDITY)
        held = self.column(f"CASE WHEN {iv.some_sql(t.true)} THEN {t.evaluated} ELSE {iv.NEVER.sql()} END", iv.VALIDITY)
        return self.column(iv.intersect_sql(held, "_b"), iv.VALIDITY)

    def value(self, x) -> Value:
        if isinstance(x, Value):
            return x
        entry = lambda b, t: f"named_struct('v', {value_sql('boolean', b)}, 't', {t})"
        if not x.temporal:
            return Value(self.column(f"array({entry(iv.some_sql(x.true), x.evaluated)})", ENTRIES), False, "boolean")
        false = self.column(iv.subtract_sql(x.evaluated, x.true, self.g.axes), iv.VALIDITY)
        return Value(self.column(f"filter(array({entry('true', x.true)}, {entry('false', false)}), e -> {iv.some_sql('e.t')})", ENTRIES), True, "boolean")

    def evaluate(self, x):
        match x:
            case S.Lit(v):
                return self.scalar(literal_sql(v), "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number")
            case S.Param(name):
                if name not in self.params:
                    raise QueryError("GMQL2004", f"parameter {name} is not given")
                return self.evaluate(S.Lit(self.params[name]))
            case S.Var(name):
                self.entity(x)
                what = self.vars[name][0]
                return self.scalar(value_sql(what, f"`{name}`.id"), what)
            case S.Prop():
                return self.property(x)
            case S.Call(name, args):
                return self.call(name, args)
            case S.Is(y, what, negated):
                return self.is_test(y, what, negated)
            case S.Unary("NOT", y):
                inner = self.truth(self.evaluate(y))
                t = self.column(iv.subtract_sql("_b", self.true_time(inner), self.g.axes), iv.VALIDITY)
                return Truth(t, self.column("_b", iv.VALIDITY), inner.temporal)
            case S.Unary(op, y):
                v = self.number(self.evaluate(y))
                return v if op == "+" else self.arithmetic(self.scalar(literal_sql(0), "number"), "-", v)
            case S.Binary("AND" | "OR" as op, a, b):
                left, right = self.truth(self.evaluate(a)), self.truth(self.evaluate(b))
                join = iv.intersect_sql if op == "AND" else iv.union_sql
                true = self.column(join(self.true_time(left), self.true_time(right)), iv.VALIDITY)
                both = self.column(join(left.evaluated, right.evaluated), iv.VALIDITY)
                score = f"({left.score} + {right.score})" if op == "AND" else f"greatest({left.score}, {right.score})"
                return Truth(true, self.column(iv.intersect_sql(both, "_b"), iv.VALIDITY), left.temporal or right.temporal, self.column(score, "double"))
            case S.Binary("IN", a, b):
                return self.member(a, b)
            case S.Binary(op, a, b) if op in _COMPARE:
                return self.compare(self.value(self.evaluate(a)), op, self.value(self.evaluate(b)))
            case S.Binary(op, a, b):
                return self.arithmetic(self.number(self.evaluate(a)), op, self.number(self.evaluate(b)))
        raise QueryError("GMQL1001", "unknown expression")

    def number(self, x) -> Value:
        if isinstance(x, Truth) or x.kind not in ("number", "integer", "any"):
            raise QueryError("GMQL3009", "a number is needed")
        return x

    def pairs(self, x: Value, y: Value, what: str) -> str:
        """For each pair of entries that overlap, `what` of a.v and b.v as v, and the common time as t."""
        one = f"named_struct('v', {what}, 't', {iv.intersect_sql('a.t', 'b.t')})"
        return f"filter(flatten(transform({x.entries}, a -> transform({y.entries}, b -> {one}))), e -> {iv.some_sql('e.t')})"

    def compare(self, x: Value, op: str, y: Value) -> Truth:
        known = {x.kind, y.kind} - {"any", "null"}
        if op in ("<", "<=", ">", ">=") and len(known) > 1:
            raise QueryError("GMQL3001", f"{x.kind} {op} {y.kind}")
        hits = self.column(self.pairs(x, y, test_sql("a.v", op, "b.v")), f"array<struct<v:boolean,t:{iv.VALIDITY}>>")
        true = self.column(iv.union_all_sql(f"transform(filter({hits}, h -> h.v), h -> h.t)"), iv.VALIDITY)
        return Truth(true, self.column(iv.union_all_sql(f"transform({hits}, h -> h.t)"), iv.VALIDITY), x.temporal or y.temporal)

    def member(self, a, b) -> Truth:
        if not isinstance(b, S.Param) or not isinstance(self.params.get(b.name), (list, tuple)):
            return self.compare(self.value(self.evaluate(a)), "IN", self.value(self.evaluate(b)))
        x = self.value(self.evaluate(a))
        tests = [f"e.v.tag <> 'null' AND {same_sql('e.v', literal_sql(v))}" for v in self.params[b.name]] or ["false"]
        hit = " OR ".join(f"({t})" for t in tests)
        return Truth(self.column(iv.union_all_sql(f"transform(filter({x.entries}, e -> {hit}), e -> e.t)"), iv.VALIDITY), self.presence(x), x.temporal)

    def arithmetic(self, x: Value, op: str, y: Value) -> Value:
        hits = self.pairs(x, y, arithmetic_sql("a.v", op, "b.v"))
        return Value(self.column(f"filter({hits}, e -> e.v IS NOT NULL)", ENTRIES), x.temporal or y.temporal, "number")

    def is_test(self, y, what: str, negated: bool) -> Truth:
        x = self.value(self.evaluate(y))
        evaluated, present = self.when_evaluated(), self.presence(x)
        if what == "MISSING":
            gone = self.column(iv.subtract_sql(evaluated, present, self.g.axes), iv.VALIDITY)
            true = self.column(iv.subtract_sql(evaluated, gone, self.g.axes), iv.VALIDITY) if negated else gone
        else:
            null = self.column(iv.union_all_sql(f"transform(filter({x.entries}, e -> e.v.tag = 'null'), e -> e.t)"), iv.VALIDITY)
            true = self.column(iv.subtract_sql(present, null, self.g.axes), iv.VALIDITY) if negated else null
        return Truth(true, evaluated, x.temporal)

    def call(self, name: str, args: tuple):
        if name not in FUNCTIONS:
            raise QueryError("GMQL2007", f"unknown function {name}")
        low, high = FUNCTIONS[name]
        if not low <= len(args) <= high:
            raise QueryError("GMQL3008", f"{name} takes {low} to {high} arguments")
        if name == "FULLTEXT":
            return self.fulltext(*args)
        if name == "EXISTS":
            x = self.value(self.evaluate(args[0]))
            return Truth(self.presence(x), self.when_evaluated(), x.temporal)
        if name == "SCORE":
            return self.scalar(value_sql("number", "_score"), "number")
        if name in ("TYPE_REF", "REL_TYPE_REF"):
            if not isinstance(args[0], S.Lit) or not isinstance(args[0].value, str):
                raise QueryError("GMQL3008", "a string is needed")
            known, code = (self.node_types, "GMQL2001") if name == "TYPE_REF" else (self.rel_types, "GMQL2002")
            if args[0].value not in known:
                raise QueryError(code, f"unknown type {args[0].value}")
            return self.scalar(value_sql("type" if name == "TYPE_REF" else "reltype", quoted(args[0].value)), "type")
        if name in ("VALIDITY", "MATCHED_VALIDITY"):
            raise QueryError("GMQL3001", f"{name} stands in RETURN alone")
        var = self.entity(args[0], {"KIND": "node", "TITLE": "node", "START_NODE": "relation", "END_NODE": "relation"}.get(name))
        if name == "TYPE":
            return self.scalar(value_sql("type" if self.vars[var][0] == "node" else "reltype", f"`{var}`.type_id"), "type")
        if name == "TITLE":
            self.count += 1
            key = f"_t{self.count}"
            shown = titles(self.g).select(F.col("owner").alias(f"{key}k"), F.col("title").alias(key))
            self.df = self.df.join(shown, F.col(f"`{var}`.id") == F.col(f"{key}k"), "left").drop(f"{key}k")
            return self.scalar(value_sql("string", f"coalesce({key}, `{var}`.id)"), "string")
        field_ = {"ID": "id", "KIND": "kind", "SOURCE": "source", "START_NODE": "src", "END_NODE": "dst"}[name]
        return self.scalar(value_sql("node" if name.endswith("_NODE") else "string", f"`{var}`.{field_}"), "node" if name.endswith("_NODE") else "string")

    def fulltext(self, scope, query, needed: bool = False) -> Truth:
        """needed: bindings without a hit cannot stay."""
        if isinstance(query, S.Param):
            query = S.Lit(self.params.get(query.name))
        if not isinstance(query, S.Lit) or not isinstance(query.value, str):
            raise QueryError("GMQL3008", "the text query is a string")
        rows = self.spelt(self.g.texts)
        if isinstance(scope, S.Prop):
            under = (F.col("path") == scope.path) | F.col("path").startswith(scope.path + ".")
            if scope.path in PSEUDO:
                under = under | F.col("kind").isin(*PSEUDO[scope.path])
            rows, var, temporal = rows.where(under), self.entity(S.Var(scope.var)), True
        else:
            var, temporal = self.entity(scope), False
        rows = postings.scored(rows, self.g.postings, query.value, self.g.words)
        self.count += 1
        n = f"_f{self.count}"
        hits = rows.groupBy(F.col("owner").alias(f"{n}k")).agg(F.collect_list("valid").alias(f"{n}v"), F.max("_s").alias(f"{n}s"))
        self.df = self.df.join(hits, F.col(f"`{var}`.id") == F.col(f"{n}k"), "inner" if needed else "left").drop(f"{n}k")
        times = self.column(f"filter(transform(coalesce({n}v, array()), v -> {iv.intersect_sql('v', '_b')}), v -> {iv.some_sql('v')})", f"array<{iv.VALIDITY}>")
        true = self.column(iv.union_all_sql(times), iv.VALIDITY)
        score = self.column(f"CASE WHEN {iv.some_sql(true)} THEN {n}s ELSE 0.0D END", "double")
        return Truth(true, self.when_evaluated(), temporal, score)

    # VALID

    def coordinate(self, timeline, x) -> temporal.Span:
        if isinstance(x, S.Param):
            x = S.Lit(self.params.get(x.name))
        if isinstance(x, S.Unary) and x.op == "-" and isinstance(x.x, S.Lit):
            x = S.Lit(-x.x.value)
        if not isinstance(x, S.Lit) or x.value is None or isinstance(x.value, bool):
            raise QueryError("GMQL3002", "a coordinate is needed")
        return temporal.span(timeline, x.value)

    def window(self, v: S.Valid) -> iv.IntervalSet:
        timeline = self.g.timelines[v.timeline]
        if timeline.system == "pattern":
            r = v.range or S.Range(v.at, v.at, True, True)
            if r.lo is None or r.hi is None:
                raise QueryError("GMQL3002", "a pattern needs both ends")
            lo, hi = int(self.coordinate(timeline, r.lo).lo), int(self.coordinate(timeline, r.hi).hi) % 10_000
            if not (r.lo_inc and r.hi_inc):
                if lo == hi:
                    return iv.NEVER
                raise QueryError("GMQL3002", "a pattern takes closed ranges")
            return calendar.recur(timeline.real, divmod(lo, 100), divmod(hi, 100), *self.days())
        if v.op == "AT":
            at = self.coordinate(timeline, v.at)
            return iv.IntervalSet([temporal.interval(timeline.axis, at, at)])
        r = v.range
        lo, hi = (None if x is None else self.coordinate(timeline, x) for x in (r.lo, r.hi))
        return iv.IntervalSet([temporal.interval(timeline.axis, lo, hi, r.lo_inc, r.hi_inc)])

    def coarse_window(self) -> str | None:
        """A test on `valid` that every row of a binding that VALID accepts passes; None where there is none to be had.

        What overlaps or covers the window as a whole does so with each of its parts; a part of DURING may be wider.
        """
        v = self.q.valid
        if v is None or v.op not in ("AT", "OVERLAPS", "CONTAINS") or v.timeline not in self.g.timelines or self.g.timelines[v.timeline].system == "pattern":
            return None
        try:
            w = temporal.expand_window(self.window(v), self.g.mappings)
        except QueryError:  # said when the clause is applied
            return None
        if len({i.axis for i in w.ivs}) != len(w.ivs) or not w.ivs:
            return None
        if v.op == "CONTAINS" and len(w.ivs) > 1:
            return None
        one = "i.axis = '{a}' AND i.lo < {hi} AND {lo} < i.hi" if v.op != "CONTAINS" else "i.axis = '{a}' AND i.lo <= {lo} AND {hi} <= i.hi"
        self.coarse_set = w
        hits = " OR ".join(f"({one.format(a=i.axis, lo=i.lo.sql(), hi=i.hi.sql())})" for i in w.ivs)
        # times on an axis of its own, which the window does not reach, are left to the exact test
        return f"(valid.universal OR exists(valid.ivs, i -> {hits}))"

    def apply_valid(self) -> None:
        v = self.q.valid
        if v is None:
            self.df = self.df.withColumn("_m", F.col("_b"))
            return
        if v.op != "ANYTIME" and v.timeline is None:
            raise QueryError("GMQL4001", "ON is needed")
        if v.timeline is not None and v.timeline not in self.g.timelines:
            raise QueryError("GMQL4002", f"unknown timeline {v.timeline}")
        axis = None
        if v.timeline is not None:
            t = self.g.timelines[v.timeline]
            if t.system == "pattern" and self.days() is None:
                raise QueryError("GMQL4004", "WITHIN is needed")
            axis = t.real or t.axis
        if v.op == "ANYTIME":
            if v.timeline is not None:
                self.df = kept(self.df, "_b", iv.on_axes_sql("_b", [axis]), iv.some_sql("v"))
            self.df = self.df.withColumn("_m", F.col("_b"))
            return
        window = temporal.expand_window(self.window(v), self.g.mappings)
        scoped = iv.on_axes_sql("_b", dict.fromkeys((axis, *(i.axis for i in window.ivs))))
        self.df = kept(self.df.withColumn("_w", F.expr(window.sql())), "_b", scoped, iv.some_sql("v"))
        matched = f"struct({iv.intersect_sql('_b', '_w')} AS m, _b, _w)"
        accepts = {"AT": iv.some_sql("v.m"), "OVERLAPS": iv.some_sql("v.m"), "CONTAINS": iv.contains_sql("v._b", "v._w"), "DURING": iv.contains_sql("v._w", "v._b")}[v.op]
        kind = f"struct<m:{iv.VALIDITY},_b:{iv.VALIDITY},_w:{iv.VALIDITY}>"
        self.df = kept(self.df, "_mm", matched, accepts, kind).withColumn("_m", F.col("_mm.m")).drop("_w", "_mm")

    # RETURN

    def output(self, x) -> str:
        """A typed column of a returned expression; what changes with time is an array of (value, validity)."""
        if isinstance(x, S.Call) and x.name in ("VALIDITY", "MATCHED_VALIDITY"):
            if x.name == "MATCHED_VALIDITY":
                return "_m"
            return self.presence(self.value(self.evaluate(x.args[0]))) if x.args else "_b"
        v = self.value(self.evaluate(x))
        lane = {"string": "s", "number": "d", "integer": "i", "boolean": "b", "node": "s", "relation": "s", "type": "s"}.get(v.kind)
        if not v.temporal:
            if lane == "d":
                return self.column(f"CASE WHEN size({v.entries}) > 0 THEN coalesce({v.entries}[0].v.d, CAST({v.entries}[0].v.i AS DOUBLE)) END", "double")
            return self.column(f"{v.entries}[0].v.{lane or 's'}", {"s": "string", "b": "boolean", "i": "bigint"}[lane or "s"]) if lane else self.column("NULL", "string")
        values = f"array_distinct(transform({v.entries}, e -> e.v))"
        times = iv.union_all_sql(f"transform(filter({v.entries}, e -> e.v = w), e -> e.t)")
        # values in the order of their times, then of themselves
        rows = f"array_sort(transform({values}, w -> named_struct('t', {times}, 'v', w)))"
        return self.column(f"transform({rows}, r -> named_struct('v', r.v, 't', r.t))", ENTRIES)

    def whole(self, x, code: str = "GMQL3004") -> int:
        if isinstance(x, S.Param):
            x = S.Lit(self.params.get(x.name))
        if isinstance(x, S.Unary) and x.op == "-":
            raise QueryError("GMQL5002", "a negative number of rows")
        if not isinstance(x, S.Lit) or isinstance(x.value, bool) or not isinstance(x.value, int):
            raise QueryError(code, "a whole number is needed")
        if x.value < 0:
            raise QueryError("GMQL5002", "a negative number of rows")
        return x.value

    def build(self) -> DataFrame:
        q = self.q
        self.coarse = self.coarse_window()
        rest = [] if q.where is None else self.plan_conditions()
        self.check_patterns()
        self.add_patterns(q.patterns)
        if rest:
            # all see the binding's whole time; what they leave of it is what they have in common
            joined = [x for x in rest if isinstance(x, S.Call) and x.name == "FULLTEXT"]
            times, scores = [], []
            for x in [*(x for x in rest if x not in joined), *joined]:
                held = self.restrict(x)
                if held is None:
                    t = self.truth(self.evaluate(x)) if x not in joined or len(x.args) != 2 else self.fulltext(*x.args, needed=True)
                    held = self.true_time(t)
                    if t.score != "0.0D":
                        scores.append(t.score)
                times.append(held)
            held = times[0]
            for x in times[1:]:
                held = self.column(iv.intersect_sql(held, x), iv.VALIDITY)
            if scores:
                self.df = self.df.withColumn("_score", F.expr(" + ".join(["_score", *scores])))
            self.df = kept(self.df, "_b", held, iv.some_sql("v"))
        self.apply_valid()
        names = {}
        for x, alias in q.returns:
            if alias in names:
                raise QueryError("GMQL1001", f"two columns named {alias}")
            names[alias] = self.output(x)
        keys = []
        for x, up in q.order:
            if isinstance(x, S.Var) and x.name in names:
                col = names[x.name]
            else:
                col = self.output(x)
            if self.df.schema[col].dataType.typeName() in ("array", "struct"):
                raise QueryError("GMQL3003", "values that change with time have no order")
            keys.append((col, up))
        out = self.df.select(*[F.col(c).alias(a) for a, c in names.items()], *[F.col(c).alias(f"_o{i}") for i, (c, _) in enumerate(keys)])
        if q.distinct:
            out = out.dropDuplicates(list(names))
        if keys:
            out = out.orderBy(*[F.col(f"_o{i}").asc_nulls_last() if up else F.col(f"_o{i}").desc_nulls_last() for i, (_, up) in enumerate(keys)])
        if q.offset is not None:
            out = out.offset(self.whole(q.offset))
        if q.limit is not None:
            n = self.whole(q.limit)
            if self.most is not None and n > self.most:
                raise QueryError("GMQL5001", f"more than {self.most} rows")
            out = out.limit(n)
        return out.select(*names)

    def worth(self, x) -> int:
        """How few rows a node of a pattern may have, by what the query says of it: its id, a test on its row, a type."""
        return 3 if x.var in self.idents else 2 if x.var in self.filters else 1 if x.type is not None else 0

    def joinable(self, patterns: list[list]) -> list[list]:
        """The patterns of a connected group in an order, and cut and turned, such that each begins at a bound node.

        The first begins at the node of which the query says most. Then single nodes come, which only narrow what there
        is, then paths from a bound node on, those that hold more tests first; ties as they are written.
        """
        left, bound, out = list(enumerate(patterns)), set(), []
        best = lambda p: max(map(self.worth, p[::2]))
        while left:
            linked = [(n, p) for n, p in left if not bound or any(x.var in bound for x in p[::2])] or [(n, p) for n, p in left if any(x.var in bound for x in p)]
            n, p = min(linked, key=lambda e: (bool(bound) and len(e[1]) > 1, -best(e[1]), e[0]))
            left.remove((n, p))
            starts = [i for i in range(0, len(p), 2) if p[i].var in bound] or [i - 1 for i in range(1, len(p), 2) if p[i].var in bound] or [i for i in range(0, len(p), 2) if self.worth(p[i]) == best(p)]
            at = starts[0]
            if 0 < at < len(p) - 1 and p[at].var is None and not bound:  # both halves have to name where they meet
                at = 0
            out += [half for half in (p[at:], turned(p[: at + 1])) if len(half) > 1] or [p]
            bound |= {x.var for x in p if x.var}
        return out


def turned(p: list) -> list:
    """A pattern from its other end."""
    flip = {"out": "in", "in": "out", "either": "either"}
    return [S.RelPattern(x.var, x.type, flip[x.direction]) if isinstance(x, S.RelPattern) else x for x in reversed(p)]


def connected(patterns: list[list]) -> list[list[list]]:
    """The patterns in groups that share nodes, each in the order in which it is written."""
    groups: list[tuple[set, list]] = []
    for n, p in enumerate(patterns):
        names, members = {x.var for x in p if x.var}, [(n, p)]
        for g in [g for g in groups if g[0] & names]:
            groups.remove(g)
            names, members = names | g[0], members + g[1]
        groups.append((names, members))
    return [[p for _, p in sorted(m, key=lambda e: e[0])] for _, m in sorted(groups, key=lambda g: min(n for n, _ in g[1]))]


def run(graph: Graph, query: str, params: dict | None = None, profile: str = "REFERENCE") -> Result:
    """The lazy result of a query, or diagnostics."""
    try:
        plan = Plan(graph, S.parse(query), params or {}, profile)
        rows = plan.build()
        if plan.most is not None and plan.q.limit is None and rows.limit(plan.most + 1).count() > plan.most:
            raise QueryError("GMQL5001", f"more than {plan.most} rows")
        return Result(rows)
    except QueryError as e:
        return Result(None, [Diagnostic(e.code, e.message, e.at)])


def rows_of(graph: Graph, query: str, params: dict | None = None) -> DataFrame:
    """As run, for queries that are known to be right."""
    r = run(graph, query, params)
    if r.rows is None:
        raise ValueError(str(r.diagnostics))
    return r.rows


