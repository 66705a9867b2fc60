"""Structured queries: boolean expressions over a root node, as DataFrame plans.

A binding has a root, the node in focus, variables, a validity, a score and the assertions that it used. Every step joins
assertions, applies the temporal operator to each of them, and merges bindings with the same variables: times unite, the
score is the greatest, assertions collect.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import temporal
from tessella.functions import intervals as iv
from tessella.functions import text as tx
from tessella.functions.values import literal_sql, plain_test_sql, test_sql
from tessella.operators.graph import Graph, kept
from tessella.plans.planner import Diagnostic, Result
from tessella.plans.syntax import QueryError

#: Operators of property predicates.
OPERATORS = {"EQUALS": "=", "NOT_EQUALS": "!=", "LESS_THAN": "<", "LESS_THAN_OR_EQUALS": "<=", "GREATER_THAN": ">", "GREATER_THAN_OR_EQUALS": ">=", "CONTAINS": "CONTAINS"}


@dataclass(frozen=True)
class Nodes:
    id: str | None = None
    type: str | None = None
    derived: bool = True


@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class MatchNone:
    pass


@dataclass(frozen=True)
class And:
    operands: tuple


@dataclass(frozen=True)
class Or:
    operands: tuple


@dataclass(frozen=True)
class Not:
    operand: object


@dataclass(frozen=True)
class Property:
    path: str
    operator: str
    value: object


@dataclass(frozen=True)
class Text:
    text: str
    mode: str = "CONTAINS"
    case_sensitive: bool = False


@dataclass(frozen=True)
class Relation:
    type: str | None = None
    derived: bool = True
    direction: str = "OUTGOING"
    target: Nodes = Nodes()
    variable: str | None = None
    properties: tuple[Property, ...] = ()
    label: Text | None = None
    expression: object = MatchAll()


@dataclass(frozen=True)
class Window:
    """At (lo alone), or from lo up to hi, which `closed` takes in."""

    timeline: str
    lo: object
    hi: object = None
    closed: bool = False

    def set(self, graph: Graph) -> iv.IntervalSet:
        t = graph.timelines[self.timeline]
        lo = temporal.span(t, self.lo)
        hi, closed = (lo, True) if self.hi is None else (temporal.span(t, self.hi), self.closed)
        return temporal.expand_window(iv.IntervalSet([temporal.interval(t.axis, lo, hi, True, closed)]), graph.mappings)


@dataclass(frozen=True)
class GraphQuery:
    root: Nodes = Nodes()
    expression: object = MatchAll()
    window: Window | None = None
    operator: str = "OVERLAPS"
    variable: str = "root"
    offset: int = 0
    limit: int | None = 100


@dataclass
class _Plan:
    g: Graph
    q: GraphQuery
    carried: list[str] = field(default_factory=list)
    count: int = 0

    def names(self) -> list[str]:
        return ["root", "focus", "key", *self.carried]

    def held(self, df: DataFrame) -> DataFrame:
        """The rows of a table that the query's window does not rule out: each assertion has to meet it."""
        return df if self.q.window is None else self.g.candidates(df, self.q.window.set(self.g))

    def nodes(self, p: Nodes) -> DataFrame:
        df = self.held(self.g.nodes if p.id is None else self.g.with_id("nodes", "id", p.id))
        if p.type is not None:
            df = df.where(F.array_contains("types", p.type) if p.derived else F.col("type_id") == p.type)
        return df.select("id", F.col("valid").alias("_v"))

    def meet(self, df: DataFrame, used: str | None) -> DataFrame:
        """Bindings with an assertion's validity _v joined in, and its id added to what was used."""
        both = iv.intersect_sql("valid", "_v")
        if self.q.window is not None:
            df = df.withColumn("_w", F.expr(self.q.window.set(self.g).sql()))
            passes = {"ASSERTION_CONTAINS_QUERY": iv.contains_sql("_v", "_w"), "QUERY_CONTAINS_ASSERTION": iv.contains_sql("_w", "_v")}.get(self.q.operator, "true")
            both = f"CASE WHEN _v.universal THEN valid WHEN {passes} THEN {both} ELSE {iv.NEVER.sql()} END"
        df = kept(df, "valid", both, iv.some_sql("v"))
        if used:
            df = df.withColumn("matched", F.array_union("matched", F.array(F.col(used))))
        return df.drop("_v", "_w")

    def merge(self, df: DataFrame) -> DataFrame:
        grouped = df.groupBy(*self.names()).agg(
            F.first("vars").alias("vars"), F.collect_list("valid").alias("_sets"), F.max("score").alias("score"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched"),
        )
        return grouped.withColumn("valid", F.expr(f"CAST({iv.union_all_sql('_sets')} AS {iv.VALIDITY})")).drop("_sets")

    def evaluate(self, x, df: DataFrame) -> DataFrame:
        match x:
            case MatchAll():
                return df
            case MatchNone():
                return df.limit(0)
            case And(operands):
                for y in operands:
                    df = self.evaluate(y, df)  # each gives merged bindings
                return df
            case Or(operands):
                if not operands:
                    return df.limit(0)
                parts = [self.evaluate(y, df) for y in operands]
                out = parts[0]
                for y in parts[1:]:
                    out = out.unionByName(y)
                return self.merge(out)
            case Not(y):
                return self.negate(y, df)
            case Property():
                return self.merge(self.property(x, df, "focus"))
            case Text():
                return self.merge(self.text(x, df, "focus"))
            case Relation():
                return self.merge(self.relation(x, df))
        raise TypeError(x)

    def negate(self, y, df: DataFrame) -> DataFrame:
        """Bindings less the times at which the operand holds of them."""
        self.count += 1
        own = f"_k{self.count}"
        self.carried.append(own)
        inner = self.evaluate(y, df.withColumn(own, F.col("key")))
        self.carried.pop()
        gone = inner.groupBy("root", F.col("focus").alias("_f"), *self.carried, F.col(own).alias("key")).agg(F.collect_list("valid").alias("_sets"))
        gone = gone.withColumn("_gone", F.expr(f"CAST({iv.union_all_sql('_sets')} AS {iv.VALIDITY})")).drop("_sets", "_f")
        joined = df.join(gone, ["root", "key", *self.carried], "left").withColumn("_gone", F.expr(f"coalesce(_gone, {iv.NEVER.sql()})"))
        return kept(joined, "valid", iv.subtract_sql("valid", "_gone", self.g.axes), iv.some_sql("v")).drop("_gone")

    def property(self, p: Property, df: DataFrame, owner: str) -> DataFrame:
        rows = self.held(self.g.props.where(F.col("path") == p.path)).where(_hit(p, "value"))
        rows = rows.select(F.col("owner").alias("_o"), F.col("valid").alias("_v"), F.concat_ws("#", "owner", "path", F.expr(iv.display_sql("valid"))).alias("_id"))
        return self.meet(df.join(rows, F.col(owner) == F.col("_o")), "_id").drop("_o", "_id")

    def text(self, p: Text, df: DataFrame, owner: str) -> DataFrame:
        """Matching texts; the score adds BM25 over all texts of the graph."""
        terms = list(dict.fromkeys(tx.analyze(p.text)))
        scored = tx.bm25(self.g.texts, p.text, match=tx.matches_sql("text", tx.tokens_sql("text", terms), p.text, p.mode, p.case_sensitive), lengths=self.g.lengths)
        rows = scored.select(F.col("owner").alias("_o"), F.col("valid").alias("_v"), F.col("text_id").alias("_id"), F.col("score").alias("_s"))
        out = self.meet(df.join(rows, F.col(owner) == F.col("_o")), "_id")
        return out.withColumn("score", F.col("score") + F.col("_s")).drop("_o", "_id", "_s")

    def relation(self, p: Relation, df: DataFrame) -> DataFrame:
        rels = self.held(self.g.rels)
        if p.type is not None:
            rels = rels.where(F.array_contains("types", p.type) if p.derived else F.col("type_id") == p.type)
        # what a relation's own row says needs no join: it holds for as long as the relation does
        own = [y for y in p.properties if y.path in self.g.own]
        for y in own:
            rels = rels.where(_hit(y, f"own.`{y.path}`"))
        said = F.array(*[F.concat_ws("#", "rel_id", F.lit(y.path), F.expr(iv.display_sql("valid"))) for y in own]).cast("array<string>")
        ends = [F.col("rel_id").alias("_rid"), F.col("valid").alias("_v"), said.alias("_said")]
        out = rels.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), *ends)
        back = rels.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *ends)
        rels = {"OUTGOING": out, "INCOMING": back, "EITHER": out.unionByName(back.where("_from <> _to"))}[p.direction]
        self.count += 1
        here, rid = f"_h{self.count}", f"_r{self.count}"
        df = self.meet(df.join(rels, F.col("focus") == F.col("_from")), "_rid").drop("_from").withColumnRenamed("_rid", rid)
        df = df.withColumn("matched", F.array_union("matched", "_said")).drop("_said")
        df = self.meet(df.join(self.nodes(p.target), F.col("_to") == F.col("id")), None).drop("id")
        if p.variable is not None:
            known = F.element_at(F.col("vars"), F.lit(p.variable))
            df = df.where(known.isNull() | (known == F.col("_to")))
            added = F.when(known.isNull(), F.map_concat("vars", F.create_map(F.lit(p.variable), F.col("_to")))).otherwise(F.col("vars"))
            df = df.withColumn("vars", added).withColumn("key", F.expr("array_join(array_sort(transform(map_entries(vars), e -> concat(e.key, '=', e.value))), ';')"))
        df = df.withColumn(here, F.col("focus")).withColumn("focus", F.col("_to")).drop("_to")
        self.carried += [here, rid]
        for y in (y for y in p.properties if y not in own):
            df = self.merge(self.property(y, df, rid))
        if p.label is not None:
            df = self.merge(self.text(p.label, df, rid))
        df = self.evaluate(p.expression, df)
        del self.carried[-2:]
        return df.withColumn("focus", F.col(here)).drop(here, rid)


def _hit(p: Property, x: str) -> str:
    """SQL for whether a value satisfies a predicate; the plain form, if there is one, is for scans."""
    op = OPERATORS[p.operator]
    return (None if op == "CONTAINS" else plain_test_sql(x, op, p.value)) or test_sql(x, op, literal_sql(p.value), structured=True)


def run(graph: Graph, query: GraphQuery) -> Result:
    """root, score, validity (struct), matched and a column for each variable, best first; or diagnostics."""
    found = list(_problems(graph, query))
    if found:
        return Result(None, found)
    plan = _Plan(graph, query)
    window = query.window.set(graph) if query.window is not None else iv.ANYTIME
    df = plan.nodes(query.root).select(F.col("id").alias("root"), F.col("id").alias("focus"), "_v")
    df = df.withColumns(
        {
            "vars": F.create_map(F.lit(query.variable), F.col("root")),
            "key": F.concat(F.lit(f"{query.variable}="), F.col("root")),
            "valid": F.expr(window.sql()),
            "score": F.lit(0.0),
            "matched": F.array().cast("array<string>"),
        }
    )
    out = plan.merge(plan.evaluate(query.expression, plan.meet(df, None)))
    variables = sorted(set(_variables(query.expression)))
    out = out.orderBy(F.desc("score"), "root", "key").select("root", "score", "valid", "matched", *[F.element_at("vars", v).alias(v) for v in variables])
    out = out.offset(query.offset)
    return Result(out if query.limit is None else out.limit(query.limit))


def _variables(x):
    match x:
        case And(ys) | Or(ys):
            for y in ys:
                yield from _variables(y)
        case Not(y):
            yield from ()
        case Relation():
            if x.variable:
                yield x.variable
            yield from _variables(x.expression)


def _problems(g: Graph, q: GraphQuery):
    def types(p: Nodes):
        if p.type is not None and p.type not in g.node_types:
            yield Diagnostic("UNKNOWN_NODE_TYPE", p.type)

    def walk(x):
        match x:
            case And(ys) | Or(ys):
                for y in ys:
                    yield from walk(y)
            case Not(y):
                yield from walk(y)
            case Relation():
                if x.type is not None and x.type not in g.rel_types:
                    yield Diagnostic("UNKNOWN_RELATION_TYPE", x.type)
                yield from types(x.target)
                yield from walk(x.expression)

    yield from types(q.root)
    yield from walk(q.expression)
    if q.window is not None:
        if q.window.timeline not in g.timelines:
            yield Diagnostic("UNKNOWN_TIMELINE", q.window.timeline)
        else:
            try:
                if not q.window.set(g):
                    yield Diagnostic("INVALID_TEMPORAL_WINDOW", "the window is empty")
            except (QueryError, ValueError) as e:  # a coordinate that its timeline cannot read
                yield Diagnostic("INVALID_TEMPORAL_WINDOW", str(e))

