"""Graphs of assertions as DataFrames, and the relational work on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import intervals as iv
from tessella.functions.temporal import Mapping
from tessella.functions.values import VALUE

NODES = f"id string, type_id string, types array<string>, kind string, url string, valid {iv.VALIDITY}, source string"
RELS = f"rel_id string, src string, dst string, type_id string, types array<string>, label string, valid {iv.VALIDITY}, source string"
PROPS = f"owner string, path string, value {VALUE}, valid {iv.VALIDITY}, fallback boolean"
TEXTS = f"text_id string, owner string, kind string, path string, text string, valid {iv.VALIDITY}"


@dataclass(frozen=True)
class Timeline:
    """axis: the axis it measures; system: number, gregorian, julian, frame, timecode, era, dates or pattern; offset: axis =
    coordinate * scale + offset; spec: what else the system needs, as JSON.

    dates is a pattern of dates that do not recur (a month, a quarter, an ISO week). A pattern is a month and a day of every
    year, as 100 * month + day on an axis of its own; `real` is the calendar axis on which it recurs.
    """

    id: str
    axis: str
    system: str = "number"
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)
    real: str | None = None
    spec: str | None = None


@dataclass
class Graph:
    """The four tables and the small catalogs that queries are checked against.

    node_types and rel_types: each type's direct parents. properties: declared type of each (type, path), if known.
    endpoints: (source types, target types) of a relation type; None leaves it open. own: paths of properties that nodes or
    relations hold in a column `own` too, a struct by path: those with one value for an owner, valid whenever it is.
    narrow: gives the rows of a table (nodes, rels, props) with a given id in a column, where a source can find them by its
    own keys. postings: (term, text_id, tf), lengths: (text_id, n) and words: (term, text_id, places) of the texts, if they
    were kept. bucketed: whether the tables have the columns of intervals.BUCKET.
    """

    spark: SparkSession
    nodes: DataFrame
    rels: DataFrame
    props: DataFrame
    texts: DataFrame
    node_types: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rel_types: dict[str, tuple[str, ...]] = field(default_factory=dict)
    properties: dict[tuple[str, str], str] = field(default_factory=dict)
    endpoints: dict[str, tuple[tuple[str, ...] | None, tuple[str, ...] | None]] = field(default_factory=dict)
    timelines: dict[str, Timeline] = field(default_factory=dict)
    mappings: tuple[Mapping, ...] = ()
    own: frozenset[str] = frozenset()
    narrow: Callable[[str, str, str], DataFrame] | None = None
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    words: DataFrame | None = None
    bucketed: bool = False
    parsed: DataFrame | None = None  #: what is kept of the documents that it was read from

    def with_id(self, table: str, column: str, ident: str) -> DataFrame:
        """The rows of nodes, rels or props with an id in a column."""
        found = self.narrow(table, column, ident) if self.narrow else getattr(self, table)
        return found.where(F.col(column) == ident)

    def candidates(self, df: DataFrame, window: iv.IntervalSet | None) -> DataFrame:
        """The rows of one of the tables that may have a time in common with the window: what the buckets do not rule out."""
        return df.where(iv.bucket_test(window)) if self.bucketed and window is not None and not window.universal else df

    @property
    def axes(self) -> list[str]:
        return list(dict.fromkeys(t.axis for t in self.timelines.values()))


def kept(df: DataFrame, name: str, sql: str, test: str, kind: str = iv.VALIDITY) -> DataFrame:
    """df with column `name` as given by sql, without the rows where the test (on v, the new value) fails.

    The new column comes from a generator: a plain filter would be pushed below the projections that it reads, and their
    expressions written into it again and again.
    """
    new = F.explode(F.expr(f"filter(array(CAST({sql} AS {kind})), v -> {test})")).alias("_new")
    return df.select("*", new).drop(name).withColumnRenamed("_new", name)


def ancestors(parents: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """All types above each, nearest first; types on a cycle have none."""

    def walk(t: str, seen: tuple[str, ...]) -> list[str] | None:
        out: list[str] = []
        for p in parents.get(t, ()):
            if p in seen:
                return None
            above = walk(p, (*seen, p))
            if above is None:
                return None
            out += [p, *above]
        return out

    return {t: tuple(dict.fromkeys(walk(t, (t,)) or ())) for t in parents}


def resolve_fallbacks(props: DataFrame, axes: list[str]) -> DataFrame:
    """Fallback assertions hold where no timed assertion of the same owner and path does; those that never do go."""
    timed = props.where("NOT fallback").groupBy("owner", "path").agg(F.collect_list("valid").alias("_sets"))
    timed = timed.select("owner", "path", F.expr(iv.union_all_sql("_sets")).cast(iv.VALIDITY).alias("_timed"))
    joined = props.where("fallback").join(timed, ["owner", "path"], "left")
    rest = f"CASE WHEN _timed IS NULL THEN valid ELSE {iv.subtract_sql('valid', '_timed', axes)} END"
    held = kept(joined, "valid", rest, iv.some_sql("v")).select(*props.columns)
    return held.unionByName(props.where("NOT fallback"))


def derived_texts(props: DataFrame, rels: DataFrame) -> DataFrame:
    """Every string property that is not blank, and every label, as texts."""
    p = props.where("value.tag = 'string' AND trim(value.s) <> ''")
    p = p.select(F.concat_ws("#", "owner", "path").alias("text_id"), "owner", F.lit("PROPERTY_VALUE").alias("kind"), "path", F.col("value.s").alias("text"), "valid")
    r = rels.where("trim(label) <> ''").select(F.concat("rel_id", F.lit("#label")).alias("text_id"), F.col("rel_id").alias("owner"), F.lit("RELATION_LABEL").alias("kind"), F.lit(None).cast("string").alias("path"), F.col("label").alias("text"), "valid")
    return p.unionByName(r)


def duplicate_ids(items: DataFrame, group: str = "kind") -> DataFrame:
    """(group, id, n) of ids that stand more than once in their kind; all their members are to be left out."""
    return items.groupBy(group, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_duplicates(items: DataFrame, group: str = "kind") -> DataFrame:
    return items.join(duplicate_ids(items, group).select(group, "id"), [group, "id"], "left_anti").select(*items.columns)


def references(links: DataFrame, items: DataFrame, want: str | None = None) -> DataFrame:
    """links (ref) with outcome: ok, unknown, ambiguous or wrong kind, against items (id, kind)."""
    found = items.groupBy(F.col("id").alias("ref")).agg(F.count(F.lit(1)).alias("_n"), F.min("kind").alias("_kind"))
    wrong = (F.col("_kind") != want) if want else F.lit(False)
    outcome = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").when(wrong, "wrong kind").otherwise("ok")
    return links.join(found, "ref", "left").withColumn("outcome", outcome).drop("_n", "_kind")


def dangling(graph: Graph) -> DataFrame:
    """Relations one end of which is no node."""
    ids = graph.nodes.select("id")
    bad = graph.rels.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("rel_id", F.lit("src").alias("end"))
    return bad.unionByName(graph.rels.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("rel_id", F.lit("dst").alias("end")))


def endpoint_errors(graph: Graph, rel_type: str) -> DataFrame:
    """Relations of a type that join nodes of other types than it allows; they are diagnosed and kept."""
    sources, targets = graph.endpoints.get(rel_type, (None, None))
    ok = F.lit(True)
    ends = graph.rels.where(F.col("type_id") == rel_type)
    for side, allowed in (("src", sources), ("dst", targets)):
        if allowed is not None:
            types = graph.nodes.select(F.col("id").alias(side), F.col("types").alias(f"_{side}"))
            ends = ends.join(types, side)
            ok = ok & F.arrays_overlap(f"_{side}", F.array(*map(F.lit, allowed)))
    return ends.where(~ok).select("rel_id", "src", "dst")


def backlinks(graph: Graph, node: str, rel_type: str | None = None, limit: int = 100) -> tuple[DataFrame, list[str]]:
    """(src, title, rel_id, validity) of relations of exactly this type to a node, by source; more than `limit` are diagnosed."""
    rels = graph.with_id("rels", "dst", node)
    if rel_type:
        rels = rels.where(F.col("type_id") == rel_type)
    out = rels.join(titles(graph), rels["src"] == F.col("owner"), "left").select(
        "src", F.coalesce("title", "src").alias("title"), "rel_id", F.expr(iv.display_sql("valid")).alias("validity")
    )
    too_many = rels.limit(limit + 1).count() > limit
    return out.orderBy("src", "rel_id").limit(limit), ["GMQL5001"] if too_many else []


def titles(graph: Graph) -> DataFrame:
    """(owner, title): the first TITLE text of each owner."""
    return graph.texts.where("kind = 'TITLE'").groupBy("owner").agg(F.min_by("text", "text_id").alias("title"))


def links(graph: Graph, node: str, direction: str = "both", rel_type: str | None = None, subtypes: bool = True, window: iv.IntervalSet | None = None) -> DataFrame:
    """(direction, rel_id, type_id, other) of the relations at a node; window: of those that hold in it."""
    def at(column: str) -> DataFrame:
        rels = graph.candidates(graph.with_id("rels", column, node), window)
        rels = rels if window is None else rels.where(meets(window))
        return rels.where(F.array_contains("types", rel_type) if subtypes else F.col("type_id") == rel_type) if rel_type else rels

    out = at("src").select(F.lit("out").alias("direction"), "rel_id", "type_id", F.col("dst").alias("other"))
    into = at("dst").select(F.lit("in").alias("direction"), "rel_id", "type_id", F.col("src").alias("other"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].orderBy("direction", "type_id", "other", "rel_id")


def stats(graph: Graph) -> DataFrame:
    """(kind, n) of nodes, relations, properties and texts."""
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    kinds = graph.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(one(graph.rels, "Relation")).unionByName(one(graph.props, "Property")).unionByName(one(graph.texts, "Text"))


def meets(window: iv.IntervalSet, column: str = "valid") -> F.Column:
    """Whether a validity has a time in common with a window."""
    return F.expr(_meets_sql(window, column))


def _meets_sql(window: iv.IntervalSet, column: str) -> str:
    hits = " OR ".join(f"(i.axis = '{i.axis}' AND i.lo < {i.hi.sql()} AND {i.lo.sql()} < i.hi)" for i in window.ivs) or "false"
    return f"{column}.universal OR exists({column}.ivs, i -> {hits})"


def visible_at(df: DataFrame, axis: str, x) -> DataFrame:
    """Rows with their visibility at a coordinate: Full if they hold there or anytime, else Hidden."""
    hit = meets(iv.IntervalSet([iv.Interval.of(axis, x, x)]))
    return df.withColumn("visibility", F.when(hit, "Full").otherwise("Hidden"))


def view(graph: Graph, window: iv.IntervalSet) -> DataFrame:
    """(id, visibility) in a window: Full of nodes that hold in it; AssertionOnly of others, known or not, that have a
    property there or an end of a relation that holds there; else Hidden."""
    rels = graph.candidates(graph.rels, window).where(meets(window))
    # the window is tested in a generator, so that what is asked of the owners is asked first
    props = kept(graph.candidates(graph.props, window), "valid", "valid", _meets_sql(window, "v"))
    no, yes = F.lit(0), F.lit(1)
    full = F.coalesce(meets(window), F.lit(False)).cast("int")
    # one exchange by id, added up before it; what is asked of an id reaches the tables
    rows = graph.nodes.select("id", full.alias("_full"), (yes - full).alias("_other"), no.alias("_end"), no.alias("_prop"))
    rows = rows.unionByName(rels.select(F.explode(F.array("src", "dst")).alias("id"), no.alias("_full"), no.alias("_other"), yes.alias("_end"), no.alias("_prop")))
    rows = rows.unionByName(props.select(F.col("owner").alias("id"), no.alias("_full"), no.alias("_other"), no.alias("_end"), yes.alias("_prop")))
    seen = rows.groupBy("id").agg(F.sum("_full").cast("int").alias("_full"), F.sum("_other").cast("int").alias("_other"), F.max("_end").alias("_end"), F.max("_prop").alias("_prop"))
    other = "array_repeat(CASE WHEN _end + _prop > 0 THEN 'AssertionOnly' ELSE 'Hidden' END, _other)"
    unknown = "array_repeat('AssertionOnly', CASE WHEN _full + _other = 0 THEN _end ELSE 0 END)"  # ends that are no nodes; owners of no node are left out
    return seen.select("id", F.explode(F.expr(f"concat(array_repeat('Full', _full), {other}, {unknown})")).alias("visibility"))


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one that `order` puts last (a body property overrides one of the front matter)."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
