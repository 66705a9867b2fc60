"""A grid of plans over a graph without indexes and over its bundle, which has buckets of times, postings and places of words:
both have to give the same rows, scores and times."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tessella.plans import structured as st
from tessella.plans.planner import run
from tessella.sources import bundle
from tests.test_markdown import railway  # noqa: F401


@pytest.fixture(scope="module")
def pair(spark, railway, tmp_path_factory):  # noqa: F811
    folder = str(tmp_path_factory.mktemp("grid") / "bundle")
    bundle.write(railway[0], folder)
    return railway[0], bundle.read(spark, folder)


def same(pair, plans, rows_of):
    """Compares plans a few at a time, each side in one job."""
    for i in range(0, len(plans), 8):
        found = []
        for graph in pair:
            every = None
            for n, p in enumerate(plans[i : i + 8], i):
                one = rows_of(graph, p)
                one = one.select(F.lit(n).alias("plan"), F.to_json(F.struct(*one.columns)).alias("row"))
                every = one if every is None else every.unionByName(one)
            found.append(sorted(map(tuple, every.collect())))
        assert found[0] == found[1]
        yield len(found[0])


def test_structured_grid(pair):
    roots = [st.Nodes(), st.Nodes(type="Site"), st.Nodes(id="mill")]
    tests = [
        st.MatchAll(), st.Property("tracks", "GREATER_THAN", 3), st.Text("holidays", "ALL_TERMS"), st.Text("closed on", "PHRASE"),
        st.Or((st.Property("sign", "EQUALS", "Mill"), st.Text("trains", "ANY_TERM"))), st.Not(st.Property("tracks", "GREATER_THAN", 3)), st.Relation("trackTo"),
    ]
    windows = [(None, "OVERLAPS"), (st.Window("Works", 60), "AT"), (st.Window("Works", 40, 55, True), "ASSERTION_CONTAINS_QUERY"), (st.Window("Works", 30, 95), "QUERY_CONTAINS_ASSERTION")]
    plans = [st.GraphQuery(root, x, window, op, limit=None) for (root, x), (window, op) in itertools.product(itertools.product(roots, tests), windows)]
    plans = plans[::7] + plans[1::12]  # a part of the grid; every root, test and window is among them

    def rows_of(graph, q):
        r = st.run(graph, q)
        assert not r.diagnostics, r.diagnostics
        return r.rows.select("root", F.round("score", 9).alias("score"), "valid", "matched")

    assert sum(same(pair, plans, rows_of)) > 20


def test_pattern_grid(pair):
    wheres = ["", "WHERE s.tracks > 3", "WHERE FULLTEXT(s, 'holidays OR trai*')", "WHERE FULLTEXT(s.body, '\"closed on\"')", "WHERE NOT FULLTEXT(s, '\"n holid\" closed')", "WHERE s.sign = 'Mill' OR s.tracks = 2"]
    valids = ["", "VALID ON Works AT 60", "VALID ON Works OVERLAPS [30, 45)", "VALID ON Works CONTAINS [41, 50]", "VALID ON Works DURING [0, 95]", "VALID ANYTIME"]
    heads = ["MATCH (s:Stop)", "MATCH (s:Stop)-[t:trackTo]->(u)", "MATCH (u)<-[:trackTo]-(s)"]
    plans = [f"{h} {w} {v} RETURN ID(s) AS s, SCORE() AS score, VALIDITY() AS v, MATCHED_VALIDITY() AS m" for i, (h, w, v) in enumerate(itertools.product(heads, wheres, valids)) if (i + i // 6) % 8 == 0]

    def rows_of(graph, q):
        r = run(graph, q)
        assert not r.diagnostics, (q, r.diagnostics)
        return r.rows

    assert sum(same(pair, plans, rows_of)) > 10
