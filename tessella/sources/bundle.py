"""Graphs as folders of Parquet tables with a manifest that is checked when they are read.

A bundle is a folder of versions and a pointer, the file `current`, which names the one that holds. A version is written and
checked beside the others; one atomic rename of the pointer puts it in place, so there is always a whole bundle, and who has
opened a version goes on reading it. Tables are cut into parts by the document that a row comes from (the node that owns it).
A version may name parts of versions before it: when documents change, only the parts that hold their rows are written anew.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import intervals as iv
from tessella.functions.temporal import of_json, to_json
from tessella.operators import postings
from tessella.operators.graph import NODES, PROPS, RELS, TEXTS, Graph, Timeline

VERSION = 5
#: Parts of a table.
PARTS = 16
#: Fixed value: what the analyzer of texts is called; its postings are of no use to another.
ANALYZER = "words-1"
_TABLES = {"nodes": NODES, "rels": RELS, "props": PROPS, "texts": TEXTS}
#: Bytes of text, about, whose words are sorted together. Words are many times their texts as rows, and the texts have been
#: brought together by their own write, so nothing is exchanged: texts are written in row groups of so many bytes, a task reads
#: about one of them and writes a file, sorted by term, for each part that it meets; a look-up reads the row groups that hold its terms.
_INDEXED = 4 << 20
#: Bytes of written texts that a task reads: about what a row group takes.
_READ = 1 << 20
#: How files are written: strings that stand sorted as what differs from the one before (terms always, others where a dictionary is
#: too large), numbers as differences.
_WRITTEN = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#term": "false"}
#: Tables that a bundle may have besides; their rows go with the part of their text and do not name its document.
_INDEX = {
    "postings": "term string, text_id string, tf bigint, positions array<int>", "lengths": "text_id string, n bigint",
    "words": "term string, text_id string, places array<struct<at:int,before:string,after:string>>",
}


_OWNERS = "owners"  #: a table that a version has while it is written


class BundleError(ValueError):
    """A folder that is no bundle, or one that does not agree with its manifest."""


def scratch(spark: SparkSession) -> str:
    """A new folder for bundles that a session keeps: under spark.checkpoint.dir, which all executors share; of this machine
    where that is unset, in a local session alone."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base and not context.master.startswith("local"):
        raise BundleError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/bundle-{uuid.uuid4().hex}"


def _files(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path, lambda p: path(p).getFileSystem(conf)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is a bundle that can be read."""
    try:
        return bool(_manifest(spark, folder))
    except BundleError:
        return False


def _columns(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def _part(doc: str) -> F.Column:
    return F.pmod(F.xxhash64(doc), F.lit(PARTS)).cast("int")


def _states(df: DataFrame) -> dict[int, list]:
    """Rows and an order-free digest of each part."""
    columns = [c for c in df.columns if c != "part"]
    rows = df.groupBy("part").agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)"))).collect()
    return {r[0]: [r[1], str(r[2])] for r in rows}


def _schema(name: str) -> str:
    return f"{_TABLES[name]}, {iv.BUCKET}, doc string" if name in _TABLES else _INDEX[name]


def _tables(graph: Graph, at: str) -> dict[str, DataFrame]:
    """The graph's tables with the document of each row: a node is its own, a relation is of its source, and what a relation
    owns as well. Relations that own something are written at `at` first: where they are few, as mostly, no table is exchanged
    to meet them."""
    spark, apart = graph.spark, [t.axis for t in graph.timelines.values() if t.system == "pattern"]
    owners = graph.props.select("owner").unionByName(graph.texts.select("owner"))
    of_rels = graph.rels.select(F.col("rel_id").alias("owner"), F.col("src").alias("_src")).join(owners, "owner", "left_semi").dropDuplicates(["owner"])
    with _short_exchanges(spark):
        of_rels.write.parquet(f"{at}/{_OWNERS}")
    of_rels = spark.read.schema("owner string, _src string").parquet(f"{at}/{_OWNERS}")
    docs = {"nodes": lambda df: df.withColumn("doc", F.col("id")), "rels": lambda df: df.withColumn("doc", F.col("src"))}
    owned = lambda df: df.join(of_rels, "owner", "left").withColumn("doc", F.coalesce("_src", "owner")).drop("_src")
    out = {}
    for name, schema in _TABLES.items():
        df = getattr(graph, name).select(*_columns(spark, schema)).withColumn("_b", F.expr(iv.bucket_sql("valid", apart))).select("*", "_b.*").drop("_b")
        out[name] = docs.get(name, owned)(df).select(*_columns(spark, _schema(name)))
    return out


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """Within the block, a setting of the session."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _short_exchanges(spark: SparkSession):
    """Within the block, what a write has exchanged is removed from disk when the write has ended."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _laid_out(name: str, df: DataFrame) -> DataFrame:
    """Rows of a part together, nodes and relations by the buckets of their times, properties by path and value."""
    keys = {"props": ["path", "value.tag", "value.s", "value.i", "value.d", "owner"]}.get(name)
    keys = keys or ([*("t_axis", "t_level", "t_bucket"), df.columns[0]] if name in ("nodes", "rels") else [df.columns[0]])
    return df.withColumn("part", _part("doc")).repartitionByRange("part", *keys).sortWithinPartitions("part", *keys)


def _catalog(graph: Graph) -> dict:
    return {
        "node_types": graph.node_types, "rel_types": graph.rel_types, "properties": [[*k, v] for k, v in graph.properties.items()], "endpoints": graph.endpoints,
        "timelines": [[t.id, t.axis, t.system, str(t.scale), str(t.offset), t.real, t.spec] for t in graph.timelines.values()], "mappings": [to_json(m) for m in graph.mappings],
    }


def write(graph: Graph, folder: str, errors: int = 0, index: bool = True, declared: DataFrame | None = None) -> None:
    """Writes a version, reads it back to check it, then points to it; a target that is not a bundle is not replaced.

    Graphs with errors are refused. index: keeps the texts' postings too; add_index() makes them later. declared: the documents (path, text) that declare
    types and timelines, for update().
    """
    if errors:
        raise BundleError(f"{errors} errors; no bundle is written")
    spark = graph.spark
    path, fs_of = _files(spark)
    if fs_of(folder).exists(path(folder)):
        _manifest(spark, folder)
    version = f"v-{uuid.uuid4().hex}"
    _write_version(spark, folder, version, _tables(graph, f"{folder}/{version}"), {}, _catalog(graph), tuple(_INDEX) if index else (), declared)


def _write_version(spark: SparkSession, folder: str, version: str, tables: dict[str, DataFrame], kept: dict, catalog: dict, index: tuple[str, ...], declared: DataFrame | None) -> None:
    """kept: {table: {part: [version, rows, digest]}} of the parts that stay as they are. index: the index tables to make, of
    the texts that are written or, where none are, of those that stay."""
    at, states = f"{folder}/{version}", dict(kept)

    def put(name: str, df: DataFrame) -> None:
        schema, options = f"{_schema(name)}, part int", {"parquet.block.size": str(_INDEXED)} if name == "texts" else {}
        with _short_exchanges(spark):
            df.write.partitionBy("part").options(**_WRITTEN, **options).parquet(f"{at}/{name}")
        made = _states(spark.read.schema(schema).parquet(f"{at}/{name}"))
        states[name] = {str(k): [version, *v] for k, v in made.items()} | kept.get(name, {})

    for name, df in tables.items():
        put(name, _laid_out(name, df))
    path, fs_of = _files(spark)
    fs_of(at).delete(path(f"{at}/{_OWNERS}"), True)
    if index:
        texts = _table(spark, folder, "texts", {k: p for k, p in states["texts"].items() if p[0] == version or not tables})
        with _set(spark, "spark.sql.files.maxPartitionBytes", str(_READ)):
            for name, df in zip(_INDEX, postings.build(texts, ("part",), laid_out=False, by=()), strict=True):
                if name not in index:
                    continue
                keys = [c for c in ("term", "text_id") if c in df.columns]
                put(name, df.select(*_columns(spark, _schema(name)), "part").sortWithinPartitions("part", *keys))
    if declared is not None:
        declared.select("path", "text").write.parquet(f"{at}/declared")
    manifest = {"version": VERSION, "analyzer": ANALYZER, "parts": PARTS, "tables": states, "declared": declared is not None, "catalog": catalog}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{at}/manifest")
    if tables:  # put() has read the rows that it wrote
        _owned(folder, {name: _table(spark, folder, name, parts) for name, parts in states.items() if name in _TABLES})
    _point(spark, folder, version)


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Makes a version the current one by one rename, and deletes those that neither it nor the one before it needs."""
    path, fs_of = _files(spark)
    fs, pointer = fs_of(folder), f"{folder}/current"
    before = _current(spark, folder) if fs.exists(path(pointer)) else None
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(f"{folder}/{version}/pointer")
    (written,) = [s.getPath() for s in fs.listStatus(path(f"{folder}/{version}/pointer")) if s.getPath().getName().startswith("part-")]
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    uri = fs.makeQualified(path(folder)).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(written), fs.makeQualified(path(pointer)), how)
    needed = {version, before}
    for v in (version, before):
        if v and fs.exists(path(f"{folder}/{v}/manifest")):
            needed |= {p[0] for parts in _manifest_of(spark, folder, v)["tables"].values() for p in parts.values()}
    for s in fs.listStatus(path(folder)):
        if s.getPath().getName().startswith("v-") and s.getPath().getName() not in needed:
            fs.delete(s.getPath(), True)


def _current(spark: SparkSession, folder: str) -> str:
    """The name of the version that holds, read as one file: it may be replaced at any time, never be half there."""
    path, fs_of = _files(spark)
    stream = fs_of(folder).open(path(f"{folder}/current"))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _manifest_of(spark: SparkSession, folder: str, version: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{version}/manifest").first()[0])


def _manifest(spark: SparkSession, folder: str) -> tuple[str, dict]:
    """The current version and its manifest."""
    path, fs_of = _files(spark)
    fs = fs_of(folder)
    found = sorted(s.getPath().getName() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []
    if "current" not in found or any(not x.startswith("v-") for x in found if x not in ("current", ".current.crc")):
        raise BundleError(f"{folder}: {found} is not a bundle")
    version = _current(spark, folder)
    if not fs.exists(path(f"{folder}/{version}/manifest")):
        raise BundleError(f"{folder}: version {version} is missing")
    manifest = _manifest_of(spark, folder, version)
    if manifest.get("version") != VERSION or manifest.get("parts") != PARTS:
        raise BundleError(f"{folder}: version {manifest.get('version')}")
    return version, manifest


def _table(spark: SparkSession, folder: str, name: str, parts: dict) -> DataFrame:
    """A table out of its parts, whichever version wrote them, with the column `part`."""
    by_version: dict[str, list[str]] = {}
    for k, p in parts.items():
        by_version.setdefault(p[0], []).append(f"{folder}/{p[0]}/{name}/part={k}")
    out = None
    for version, paths in by_version.items():
        one = spark.read.schema(f"{_schema(name)}, part int").option("basePath", f"{folder}/{version}/{name}").parquet(*paths)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], f"{_schema(name)}, part int") if out is None else out


def read(spark: SparkSession, folder: str, check: bool = True) -> Graph:
    """The graph of a bundle's current version. check: its parts agree with the manifest, and every property and text is of a
    node or a relation."""
    return _read_version(spark, folder, _manifest(spark, folder)[0], check)


def _owned(folder: str, every: dict[str, DataFrame]) -> None:
    """Refuses tables with a property or text of no node or relation. Owners that are nodes go first: mostly none is left to meet
    the relations, which are then not exchanged."""
    for name in ("props", "texts"):
        lost = every[name].select("owner").join(every["nodes"].select(F.col("id").alias("owner")), "owner", "left_anti").distinct()
        if lost.head(1):
            found = lost.join(every["rels"].select(F.col("rel_id").alias("owner")), "owner", "left_anti").head(1)
            if found:
                raise BundleError(f"{folder}: {name} of {found[0][0]}, which is neither a node nor a relation")


def _read_version(spark: SparkSession, folder: str, version: str, check: bool = True) -> Graph:
    m = _manifest_of(spark, folder, version)
    every = {name: _table(spark, folder, name, parts) for name, parts in m["tables"].items()}
    if check:
        for name, df in every.items():
            if _states(df) != {int(k): p[1:] for k, p in m["tables"][name].items()}:
                raise BundleError(f"{folder}: {name} does not agree with the manifest")
        _owned(folder, every)
    every = {name: df.drop("part", "doc") for name, df in every.items()}
    c = m["catalog"]
    endpoints = {k: tuple(None if e is None else tuple(e) for e in v) for k, v in c["endpoints"].items()}
    kept = every if m.get("analyzer") == ANALYZER else {}  # postings of another analyzer are left alone; texts are scanned
    return Graph(
        spark, every["nodes"], every["rels"], every["props"], every["texts"], {k: tuple(v) for k, v in c["node_types"].items()},
        {k: tuple(v) for k, v in c["rel_types"].items()}, {(a, b): d for a, b, d in c["properties"]}, endpoints, {t[0]: Timeline(*t[:3], Fraction(t[3]), Fraction(t[4]), *t[5:]) for t in c["timelines"]},
        tuple(map(of_json, c["mappings"])), postings=kept.get("postings"), lengths=kept.get("lengths"), words=kept.get("words"), bucketed=True,
    )


def declared(spark: SparkSession, folder: str) -> DataFrame | None:
    """The documents that declare types and timelines, if the bundle kept them."""
    version, m = _manifest(spark, folder)
    return spark.read.schema("path string, text string").parquet(f"{folder}/{version}/declared") if m["declared"] else None


def update(graph: Graph, folder: str, docs: DataFrame, errors: int = 0) -> bool:
    """A version in which the documents (id, source) have the rows of `graph`, which holds these alone; all others keep theirs.

    Only the parts with rows of these documents, or of what stood in their files before, are read and written. False, and
    nothing done, where that cannot be right: the catalogs differ, or an id is another file's already.
    """
    if errors:
        raise BundleError(f"{errors} errors; no bundle is written")
    spark = graph.spark
    version, m = _manifest(spark, folder)
    if json.loads(json.dumps(_catalog(graph))) != m["catalog"] or not m["declared"]:
        return False
    nodes = _table(spark, folder, "nodes", m["tables"]["nodes"])
    changed = docs.select(F.col("id").alias("_id"), F.col("source").alias("_source")).where("_id IS NOT NULL").distinct()
    sources = docs.select(F.col("source").alias("_source")).distinct()
    if nodes.join(changed, F.col("id") == F.col("_id")).where("source <> _source").head(1):
        return False
    before = nodes.join(sources, F.col("source") == F.col("_source")).select(F.col("id").alias("doc"))
    gone = before.unionByName(changed.select(F.col("_id").alias("doc"))).distinct()
    touched = {str(r[0]) for r in gone.select(_part("doc")).distinct().collect()}
    tables, fresh_version = {}, f"v-{uuid.uuid4().hex}"
    for name, fresh in _tables(graph, f"{folder}/{fresh_version}").items():
        old = _table(spark, folder, name, {k: p for k, p in m["tables"][name].items() if k in touched}).drop("part")
        tables[name] = old.join(gone, "doc", "left_anti").select(*fresh.columns).unionByName(fresh)
    kept = {name: {k: p for k, p in parts.items() if k not in touched} for name, parts in m["tables"].items()}
    _write_version(spark, folder, fresh_version, tables, kept, m["catalog"], tuple(x for x in _INDEX if x in m["tables"]), declared(spark, folder))
    return True


def add_index(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(_INDEX)) -> None:
    """A version with these index tables besides, where the current one lacks any; all that it has stays as it is."""
    _, m = _manifest(spark, folder)
    lacking = tuple(x for x in _INDEX if x in names and x not in m["tables"])
    if lacking:
        _write_version(spark, folder, f"v-{uuid.uuid4().hex}", {}, m["tables"], m["catalog"], lacking, declared(spark, folder))
