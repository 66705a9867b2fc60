"""Bundles, demo documents, rendering, rebuilding."""

from __future__ import annotations

import json
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessella.operators import render
from tessella.plans.planner import rows_of, run
from tessella.sources import bundle, demo, markdown
from tests.test_markdown import SOUND, ids, railway  # noqa: F401


def test_demo(spark):
    docs = demo.documents(spark, 60, 7)
    g, problems = markdown.load(docs)
    assert docs.count() == 60 and problems.where("severity = 'error'").count() == 0
    assert g.nodes.count() == 54 and 54 <= g.rels.count() <= 162
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, demo.documents(spark, 60, 7).collect()))
    assert demo.documents(spark, 1).count() == 24


def test_bundle(spark, railway, tmp_path):  # noqa: F811
    g, _ = railway
    folder = str(tmp_path / "bundle")
    bundle.write(g, folder)
    back = bundle.read(spark, folder)
    query = "MATCH (a:Stop)-[t:trackTo]->(b) WHERE t.length > 3 VALID ON Works AT 60 RETURN ID(a)"
    assert ids(back, query) == ids(g, query) == ["harbour"]
    assert back.postings is not None
    assert back.words is not None and back.bucketed
    for text in ("holidays", "trains OR holidays", "trai* here", "水車", '"closed on"', '"losed o"', '" on"', '"on holidays."', '"n h" trains', '"closed" OR waits', '"closed  on"', "waits"):
        query = f"MATCH (s:Stop) WHERE FULLTEXT(s, '{text}') RETURN ID(s) AS id, SCORE() AS score ORDER BY id"
        assert rows_of(back, query).collect() == rows_of(g, query).collect()
    with pytest.raises(bundle.BundleError):
        bundle.write(g, folder, errors=1)
    (part, *_) = (tmp_path / "bundle").glob("v-*/nodes/part=*/*.parquet")
    shutil.copy(part, part.with_name("part-more.parquet"))
    with pytest.raises(bundle.BundleError):
        bundle.read(spark, folder)
    assert bundle.read(spark, folder, check=False).nodes.count() > g.nodes.count()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("")
    with pytest.raises(bundle.BundleError):
        bundle.write(g, str(tmp_path / "other"))


def test_phrases_need_no_text(spark, tmp_path):
    """By places of words: what a scan of the texts finds, without reading any."""
    import random

    from tessella.operators import postings

    rng = random.Random(5)
    words, signs = ["a", "ab", "aba", "b_a", "ÄB", "水", "9"], [" ", " ", ", ", "-", "\n", ""]
    texts = [("".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(12))),) for _ in range(300)] + [("",), ("..",), (None,)]
    df = spark.createDataFrame([(str(i), *t) for i, t in enumerate(texts)], "text_id string, text string")
    _, _, held = postings.build(df)
    held.write.parquet(str(tmp_path / "words"))
    held = spark.read.parquet(str(tmp_path / "words"))
    for phrase in ("a", "ab", "b a", "a, b", ", a", "ab aba ab", "a a a", "ba-", "äb", "AB\nA", "水9", "a-b_a ", "a ab aba b"):
        assert postings.phrase_parts(phrase)
        got = {r[0] for r in postings.phrase_texts(held, phrase).collect()}
        assert got == {str(i) for i, (t,) in enumerate(texts) if t and phrase.lower() in t.lower()}, phrase
    assert postings.phrase_parts("..") == []
    physical = postings.phrase_texts(held, "ab aba ab")._jdf.queryExecution().toString()
    assert "EqualTo(term,aba)" in physical and "StringStartsWith(term,ab)" in physical and "text:" not in physical.split("ReadSchema")[-1]


def test_windows_read_buckets(spark, tmp_path):
    """A window becomes a filter of the scan; nothing that it has to find is ruled out."""
    import random

    from tessella.functions import intervals as iv
    from tessella.functions.intervals import ANYTIME, Interval, IntervalSet
    from tessella.operators.graph import Graph, NODES, PROPS, RELS, TEXTS, Timeline, meets

    rng = random.Random(9)
    sets = [ANYTIME, IntervalSet(), IntervalSet([Interval.of("t", 5, None)]), IntervalSet([Interval.of("t", None, -7)]), IntervalSet([Interval.of("u", 1, 2)]), IntervalSet([Interval.of("t", 1, 2), Interval.of("u", 1, 2)]), IntervalSet([Interval.of("p", 1, 2)])]
    for _ in range(60):
        lo, size = rng.randrange(-5000, 5000), rng.choice([0, 1, 3, 60, 900, 10**6, 2**50])
        sets.append(IntervalSet([Interval.of("t", lo, lo + size, rng.random() < 0.5 or size == 0, True), *[Interval.of("t", lo + 2 * size, lo + 3 * size)] * (rng.random() < 0.2)]))
    nodes = None
    for i in range(0, len(sets), 50):
        rows = " UNION ALL ".join(f"SELECT 'n{k}' AS id, 'T' AS type_id, array('T') AS types, 'Node' AS kind, CAST(NULL AS STRING) AS url, {s.sql()} AS valid, 'x' AS source" for k, s in enumerate(sets[i : i + 50], i))
        nodes = spark.sql(rows) if nodes is None else nodes.unionByName(spark.sql(rows))
    none = lambda schema: spark.createDataFrame([], schema)
    g = Graph(spark, nodes, none(RELS), none(PROPS), none(TEXTS), {"T": ()}, timelines={a: Timeline(a, a, *(("pattern",) if a == "p" else ())) for a in "tup"})
    assert nodes.schema.fieldNames() == spark.createDataFrame([], NODES).columns
    bundle.write(g, str(tmp_path / "b"))
    back = bundle.read(spark, str(tmp_path / "b"))
    for lo, hi in ((0, 0), (-3, 40), (4999, 10**7), (-(2**40), -(2**39)), (17, None), (None, -4990)):
        w = IntervalSet([Interval.of("t", lo, hi)])
        kept = {r["id"] for r in back.candidates(back.nodes, w).select("id").collect()}
        assert {f"n{k}" for k, s in enumerate(sets) if s.intersect(w)} <= kept
        assert "n4" not in kept and "n6" in kept  # on another axis; one that recurs may come to lie on this
        exact = {r["id"] for r in back.candidates(back.nodes, w).where(meets(w)).select("id").collect()}
        assert exact == {f"n{k}" for k, s in enumerate(sets) if s.intersect(w)}
    few = back.candidates(back.nodes, IntervalSet([Interval.of("t", 3, 3)]))
    assert few.count() < len(sets) / 2
    df = rows_of(back, "MATCH (n:T) VALID ON t AT 3 RETURN ID(n) AS id")
    physical = df._jdf.queryExecution().toString()
    assert "EqualTo(t_axis,t),EqualTo(t_level,0)" in physical.split("PushedFilters", 1)[1]
    assert {r[0] for r in df.collect()} == {f"n{k}" for k, s in enumerate(sets) if s.universal or s.intersect(IntervalSet([Interval.of("t", 3, 3)]))} - ({"n0"} if "n0" not in {r[0] for r in rows_of(g, "MATCH (n:T) VALID ON t AT 3 RETURN ID(n) AS id").collect()} else set())


def test_render(railway):  # noqa: F811
    g, _ = railway
    df = rows_of(g, "MATCH (s:Stop) WHERE s.tracks > 0 RETURN ID(s) AS id, s.tracks AS tracks, VALIDITY() AS v ORDER BY id")
    assert [r[0] for r in render.tsv(df).collect()] == [
        "harbour\t2.0 @ Works: [40, 64]; 6.0 @ Works: (64, 90]\tWorks: [40, 90]", "mill\t4.0 @ Works: [40, 90]\tWorks: [40, 90]"
    ]
    assert json.loads(render.json_rows(df.select("id")).first()[0]) == {"id": "harbour"}
    assert render.markdown_table(df.select("id")) == "| id |\n| --- |\n| harbour |\n| mill |"


def test_embed(railway):  # noqa: F811
    g, _ = railway
    text = 'x\n::: embed:query="MATCH (s:Stop) WHERE s.tracks > 0 RETURN ID(s) AS id ORDER BY id"\nold\n:::\n::: embed:back-link=trackTo\n:::\n'
    out, problems = render.embed(g, "mill", text)
    assert not problems and "| harbour |\n| mill |\n:::" in out and "| harbour | Harbour Street | Works: [40, 70] |" in out
    same, problems = render.embed(g, "mill", text.replace("RETURN", "RETURN LIMIT 101,") + '::: embed:query="MATCH (s) RETURN ID(s) LIMIT 101"\n:::\n')
    assert same.startswith("x\n") and {d.code for d in problems} == {"GMQL1001", "GMQL5001"}


def test_versions(spark, railway, tmp_path):  # noqa: F811
    """There is a bundle at every moment, and who has opened a version goes on reading it."""
    g, _ = railway
    folder = str(tmp_path / "bundle")
    bundle.write(g, folder)
    held, first = bundle.read(spark, folder), bundle._current(spark, folder)
    bundle.write(g, folder)
    assert bundle._current(spark, folder) != first and held.nodes.count() == g.nodes.count() == bundle.read(spark, folder).nodes.count()
    bundle.write(g, folder)
    assert len(list((tmp_path / "bundle").glob("v-*"))) == 2  # the current one and the one before it
    assert not (tmp_path / "bundle" / first).exists()
    (tmp_path / "bundle" / "current").write_text("v-none\n")
    (tmp_path / "bundle" / ".current.crc").unlink(missing_ok=True)
    with pytest.raises(bundle.BundleError):
        bundle.read(spark, folder)
    lost = replace(g, props=g.props.unionByName(g.props.limit(1).withColumn("owner", F.lit("nobody"))))
    with pytest.raises(bundle.BundleError, match="nobody"):
        bundle.write(lost, str(tmp_path / "lost"))


def _content(g):
    tables = [g.nodes.selectExpr("id", "type_id", "source", "to_json(valid) AS v"), g.rels.selectExpr("rel_id", "dst", "source", "to_json(valid) AS v"), g.props.selectExpr("owner", "path", "to_json(value) AS x", "to_json(valid) AS v")]
    tables += [g.texts.selectExpr("text_id", "owner", "text"), g.postings.selectExpr("term", "text_id", "tf"), g.words.selectExpr("term", "text_id", "to_json(places) AS p"), g.lengths.selectExpr("text_id", "n")]
    return [sorted(map(tuple, t.collect()), key=str) for t in tables]


def test_changed_documents_rewrite_their_own_rows(spark, tmp_path):
    from tessella.streaming import rebuild

    docs = dict(SOUND) | {f"stop{i}.md": f"---\nid: stop{i}\ntype: Stop\nprops: {{sign: Stop {i}, notice: {{default: x}}, tracks: {i}, goods: [grain]}}\n---\n# Stop {i}\n\nTo @link{{}}[the mill](mill trackTo).\n" for i in range(24)}
    table = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    folder = str(tmp_path / "out")
    assert not rebuild.apply(spark, table(docs), folder)  # there is none yet
    rebuild.rebuild(spark, table(docs), folder)
    before = bundle._manifest(spark, folder)[1]["tables"]
    first = bundle._current(spark, folder)
    changed = {"stop3.md": docs["stop3.md"].replace("tracks: 3", "tracks: 33").replace("the mill", "a mill"), "stop9.md": docs["stop9.md"].replace("id: stop9", "id: halt9"), "new.md": docs["stop1.md"].replace("stop1", "fresh")}
    assert rebuild.apply(spark, table(changed), folder)
    after = bundle._manifest(spark, folder)[1]["tables"]
    touched = {k for k in after["nodes"] if after["nodes"][k][0] != first}
    want = {str(r[0]) for r in spark.createDataFrame([(x,) for x in ("stop3", "stop9", "halt9", "fresh")], "doc string").select(bundle._part("doc")).collect()}
    assert touched == want & set(after["nodes"]) and set(before["nodes"]) - set(after["nodes"]) <= want
    assert all(after[t][k] == before[t][k] for t in after for k in before[t] if k not in want)
    rebuild.rebuild(spark, table(docs | changed), str(tmp_path / "whole"))
    assert _content(bundle.read(spark, folder)) == _content(bundle.read(spark, str(tmp_path / "whole")))
    assert ids(bundle.read(spark, folder), "MATCH (s:Stop) WHERE s.tracks = 33 RETURN ID(s)") == ["stop3"]
    # what needs all documents, or may not be written
    assert not rebuild.apply(spark, table({"line.md": SOUND["line.md"].replace("Works", "Works2")}), folder)
    assert not rebuild.apply(spark, table({"other.md": changed["stop3.md"]}), folder)  # an id of another file
    with pytest.raises(bundle.BundleError):
        rebuild.apply(spark, table({"stop3.md": "---\nid: [torn\n---\n"}), folder)
    assert ids(bundle.read(spark, folder), "MATCH (s:Stop) WHERE s.tracks = 33 RETURN ID(s)") == ["stop3"]


def test_rebuild(spark, tmp_path):
    from tessella.streaming.rebuild import watch

    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in SOUND.items():
        (docs / name).write_text(text)
    watch(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    g = bundle.read(spark, str(tmp_path / "out"))
    assert ids(g, "MATCH (s:Stop) RETURN ID(s)") == ["harbour", "mill"]
    assert run(g, "MATCH (s:Port) RETURN s").diagnostics[0].code == "GMQL2001"


def test_words_of_a_text_are_grouped_where_the_text_is(spark):
    """Texts are exchanged once, by their ids; words are not exchanged by term, and none carries all gaps of its text."""
    from tessella.operators import postings

    df = spark.createDataFrame([("a", "One, two; one."), ("b", "..."), ("c", None)], "text_id string, text string")
    _, _, words = postings.build(df, laid_out=False)
    plan = words._jdf.queryExecution().optimizedPlan().toString() + words._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text_id" in plan and "hashpartitioning(term" not in plan
    got = {(r["term"], r["text_id"]): [tuple(x) for x in r["places"]] for r in words.collect()}
    assert got == {("one", "a"): [(0, "", ", "), (2, "; ", ".")], ("two", "a"): [(1, ", ", "; ")]}


def test_words_are_not_exchanged(spark):
    """Texts are exchanged, once; the words of each are grouped inside its row."""
    from tessella.operators import postings

    df = spark.createDataFrame([("t1", 0, "ab cd ab"), ("t2", 1, ""), ("t3", 1, None), ("t4", 1, "…ab")], "text_id string, part int, text string")
    rows, lengths, words = postings.build(df, ("part",), laid_out=False, by=("part",), parts=3)
    for made in (rows, words):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    assert {tuple(r) for r in rows.select("term", "text_id", "tf").collect()} == {("ab", "t1", 2), ("cd", "t1", 1), ("ab", "t4", 1)}
    assert {(r.term, r.text_id): list(r.positions) for r in rows.collect()} == {("ab", "t1"): [0, 2], ("cd", "t1"): [1], ("ab", "t4"): [0]}
    held = {(r.term, r.text_id): [tuple(p) for p in r.places] for r in words.collect()}
    assert held == {("ab", "t1"): [(0, "", " "), (2, " ", "")], ("cd", "t1"): [(1, " ", " ")], ("ab", "t4"): [(0, "…", "")]}


def test_index_files_hold_terms_as_differences(spark, railway, tmp_path):  # noqa: F811
    """Sorted terms cost what differs from the one before, and rows of the index do not name their document again."""
    import pyarrow.parquet as pq

    bundle.write(railway[0], str(tmp_path / "bundle"))
    for name in ("postings", "words"):
        (f, *_) = (tmp_path / "bundle").glob(f"v-*/{name}/part=*/*.parquet")
        held = pq.ParquetFile(f)
        columns = {held.metadata.row_group(0).column(i).path_in_schema: held.metadata.row_group(0).column(i) for i in range(held.metadata.num_columns)}
        assert "doc" not in columns and "DELTA_BYTE_ARRAY" in columns["term"].encodings
        assert columns["term"].has_column_index or columns["term"].statistics.has_min_max  # look-ups still pass row groups by


def test_an_index_is_made_where_the_texts_were_written(spark, railway, tmp_path, monkeypatch):  # noqa: F811
    """No text is exchanged for the index, whose files follow those of the texts; what a relation owns goes with its source."""
    from tessella.operators import postings

    df = spark.createDataFrame([("t1", 0, "ab cd ab"), ("t2", 1, None)], "text_id string, part int, text string")
    for made in postings.build(df, ("part",), laid_out=False, by=()):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    graph = railway[0]
    rels = {r["rel_id"]: r["src"] for r in graph.rels.select("rel_id", "src").collect()}
    want = {(r["owner"], r["path"]): rels.get(r["owner"], r["owner"]) for r in graph.props.select("owner", "path").collect()}
    texts = sorted(map(tuple, graph.texts.select("text_id", "text").collect()))
    words = sorted((r["term"], r["text_id"]) for r in postings.build(graph.texts)[0].select("term", "text_id").collect())
    monkeypatch.setattr(bundle, "_READ", 1 << 9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    bundle.write(graph, str(tmp_path / "bundle"))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    (folder,) = (tmp_path / "bundle").glob("v-*")
    assert not (folder / "owners").exists()
    props = spark.read.parquet(str(folder / "props"))
    assert {(r["owner"], r["path"]): r["doc"] for r in props.select("owner", "path", "doc").collect()} == want
    back = bundle.read(spark, str(tmp_path / "bundle"))
    assert sorted(map(tuple, back.texts.select("text_id", "text").collect())) == texts
    assert sorted((r["term"], r["text_id"]) for r in back.postings.select("term", "text_id").collect()) == words


def test_index_is_made_when_it_is_asked_for(spark, railway, tmp_path):
    """A bundle without an index gets the tables that are named, in a version that keeps all its other parts."""
    folder = str(tmp_path / "b")
    bundle.write(railway[0], folder, index=False)
    before = bundle._manifest(spark, folder)[1]["tables"]
    assert set(before) == set(bundle._TABLES)
    bundle.add_index(spark, folder, ("words",))
    version, m = bundle._manifest(spark, folder)
    assert {k: v for k, v in m["tables"].items() if k != "words"} == before and {p[0] for p in m["tables"]["words"].values()} == {version}
    bundle.add_index(spark, folder, ("words",))
    assert bundle._manifest(spark, folder)[0] == version
    whole = str(tmp_path / "whole")
    bundle.write(railway[0], whole)
    some, every = bundle.read(spark, folder), bundle.read(spark, whole)
    assert some.postings is None and some.lengths is None
    assert sorted(map(str, some.words.collect())) == sorted(map(str, every.words.collect())) != []


def test_a_session_makes_no_index_before_a_phrase(spark, tmp_path, monkeypatch):
    """A query on times has its bundle written without an index."""
    from tessella.plans import catalog

    made, write = [], bundle.write
    monkeypatch.setattr(catalog, "_KEPT", {})
    monkeypatch.setattr(bundle, "write", lambda *a, **k: (made.append(k.get("index", True)), write(*a, **k))[1])
    sf = "/root/testdata/sf0.001"
    catalog.kept_graph(spark, sf)
    folder = next(iter(catalog._KEPT.values()))
    assert made == [False] and "words" not in bundle._manifest(spark, folder)[1]["tables"]
    assert catalog.kept_graph(spark, sf, ("words",)).words is not None and made == [False]
