"""Centroid clustering, the n-gram Jaccard join and ranked search against brute force; edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import centroids, near_dups, search, set_join
from tests.llm.test_corpus_operators import brute_near, planted
from tests.llm.test_text_operators import LONG, SF, empty, odd  # noqa: F401


# centroid clustering


def brute_clusters(rows, k, rounds, dims, scale):
    """Every distance in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)][:k]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs)) for _, v in kept]
        if turn < rounds:
            own = {j: [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == j] for j in range(len(cs))}
            cs = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(cs)]
    total = Counter()
    for d, j in near:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, near, strict=True)), key=str)


def clusters(df, **options):
    out = centroids.cluster(df, **options).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(8)]) for i in range(400)]  # many ties
    rows += [(400 + i, rows[0][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    assert clusters(df, dims=8, k=5, scale=4) == brute_clusters(rows, 5, 3, 8, 4)


def test_clusters_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 0.0]), (7, [0.5, -0.5]), (7, [0.5, -0.5]), (None, [3.0, 4.0]), (8, [1e30, -1e30]), (9, [1e30, 1.0]), (10, [-0.3, 2e9])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_clusters(kept, 3, 3, 2, 64)
    most = 2**63 - 1
    assert clusters(df, dims=2, k=3) == sorted(((*r[:2], *(min(x, most) for x in r[2:5]), r[5]) for r in want), key=str)
    assert clusters(df, dims=2, k=16, rounds=0) == sorted(((*r[:2], *(min(x, most) for x in r[2:5]), r[5]) for r in brute_clusters(kept, 16, 0, 2, 64)), key=str)
    assert centroids.cluster(empty(spark, df), dims=2).count() == 0
    assert centroids.cluster(df, dims=5).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 200, 10_000, 2**20, 2**26]), st.integers(1, 9))
def test_screening_is_rigorous(seed, size, k):
    """The true value lies in the interval, and what is nearest is what integers say, near and exact ties included."""
    rng = np.random.default_rng(seed)
    c = rng.integers(-size, size + 1, (k, 64))
    c[rng.integers(0, k)] = c[0]
    x = np.concatenate((rng.integers(-size, size + 1, (20, 64)), (c[rng.integers(0, k, 10)] + c[rng.integers(0, k, 10)]) // 2, c))
    held = centroids.Centroids([tuple(map(int, row)) for row in c])
    u = 2.0**-24
    low, high = held.intervals(x, 64 * u / (1 - 64 * u), u)
    true = [[sum(int(b) ** 2 - 2 * int(a) * int(b) for a, b in zip(row, own, strict=True)) for own in c] for row in x]
    assert all(lo <= t <= hi for ls, ts, hs in zip(low, true, high, strict=True) for lo, t, hi in zip(ls, ts, hs, strict=True))
    best, away = held.nearest(x)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, own, strict=True)), j) for j, own in enumerate(c)) for row in x]
    assert [(int(d), int(j)) for d, j in zip(away, best, strict=True)] == want


# n-gram Jaccard join


def brute_join(rows, p):
    near = brute_near(rows, p.shingle) if p.percent == 80 else None
    if near is not None:
        return near
    from tests.llm.test_corpus_operators import Union

    sets = [(i, near_dups.shingle_set(t, p.shingle)) for i, t in rows if t and i is not None]
    union = Union()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= p.percent * len(a | b):
                union.join(i, j)
    return union


@pytest.mark.parametrize(("shingle", "percent", "boundary", "part"), [(4, 85, None, 400), (4, 85, 60, 2), (1, 40, 6, 3)])
def test_set_join(spark, shingle, percent, boundary, part):
    rng = random.Random(shingle)
    rows = planted() + [(10_000 + i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))) for i in range(60 if percent < 85 else 200)]
    p = set_join.Params(shingle=shingle, percent=percent, boundary=boundary, part=part)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    union, texts = brute_join(rows, p), dict(rows)
    got = set_join.set_join(df, p).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(near_dups.shingle_set(texts[r["doc_id"]], shingle)), union.root(r["doc_id"]))


def test_set_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    union = brute_join(rows, set_join.Params())
    assert {r["doc_id"]: r["component_id"] for r in set_join.op12_heavy_light_join(spark, SF).collect()} == {i: union.root(i) for i, _ in rows}


def test_set_join_edges(spark, odd):  # noqa: F811
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.set_join(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (4, 1, 4), (4, 1, 4), (5, 3, 5), (6, 1, 6)], key=str)
    assert set_join.set_join(empty(spark, odd)).count() == 0
    base = [f"w{i}" for i in range(200)]
    rows = [(9, " ".join(base)), (7, " ".join(base).upper()), (7, "another text"), (8, " ".join([*base[:-1], "x"])), (3, "\t".join([*base[:-1], "y"]))]
    got = set_join.set_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(3, 3), (7, 3), (7, 3), (8, 3), (9, 3)]


def test_boundary_has_the_least_cost():
    costs = [(2, 1.0, 3.0), (6, 5.0, 6.0), (9, 20.0, 8.0), (12, 1.0, 40.0), (20, 99.0, 12.0)]
    total = {b: sum(light if size <= b else heavy for size, light, heavy in costs) for b in [0, *(s for s, _, _ in costs)]}
    assert total[set_join.boundary(costs)] == min(total.values()) and set_join.boundary([]) == 0
    assert set_join.boundary([(3, 5.0, 5.0)]) == 0


# ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(brute_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, length, df = len(held), sum(s for _, _, s in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 50 + (50 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(brute_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted(map(tuple, search.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aZ9 _-é\x00 \x85\n", max_size=40), st.integers(1, 8))
def test_terms(text, piece):
    assert [t.decode() for part in search.terms(text, piece) for t in part] == brute_terms(text)


def test_search(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert found(docs.repartition(5), items) == want
    assert sorted(map(tuple, search.op13_impact_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str) == want
    assert found(docs, items, most_terms=300) == want  # many blocks of items


def test_shards_are_bounded_and_exact(spark, tmp_path, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = search.build_index(docs, search.corpus_totals(docs), str(tmp_path / "i"), postings=500, most_docs=7)
    sizes = [(r["n_docs"], len(r["docs"]) // 4) for r in index.select("n_docs", "docs").collect()]
    assert max(n for n, _ in sizes) <= 7 and len(sizes) > 20 and sum(n for n, _ in sizes) == docs.where("text RLIKE '[a-zA-Z0-9]'").count()
    rows = index.collect()
    for r in rows[:20]:
        starts = np.frombuffer(r["starts"], np.int64)
        assert len(starts) == len(r["terms"]) + 1 and len(set(r["terms"])) == len(r["terms"]) and starts[-1] == len(r["impacts"]) // 4
    block = next(search.item_blocks(items, 10**9))
    scored = search._score(index, block, 3).collect()
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 3)
    best = {}
    for r in scored:
        best.setdefault(block[r["item"]][0], []).append((-r["score"], r["doc_id"]))
    got = [(item, rank, i, -s) for item, own in best.items() for rank, (s, i) in enumerate(sorted(own)[:3], 1)]
    assert sorted(got, key=str) == want


def test_search_ties_and_edges(spark, odd):  # noqa: F811
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words"), (7, None), (8, ""), (61, "Same, WORDS; here!"), (61, "same words here"), (99, LONG)]
    items = [(1, "words"), (2, None), (3, "..."), (None, "here"), (4, "absent"), (1, "SAME"), (5, "wörd more")]
    dd = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int").repartition(4)
    ii = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    merged = [(1, "words SAME"), (None, "here"), (4, "absent"), (5, "wörd more")]
    for k in (1, 50, 61, 62, 63, 500):
        assert found(dd, ii, k=k) == brute_search(docs, merged, k)
    assert found(empty(spark, dd), ii) == [] and found(dd, empty(spark, ii)) == []
    assert found(dd.where("text IS NULL OR text = ''"), ii) == []
    some = spark.createDataFrame([(1, "a text")], "item_id long, text string")
    assert {r[2] for r in found(odd, some)} == {None}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=40), st.integers(1, 12))
def test_top_k_is_tie_safe(rows, k):
    scores, ids = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    got = search.top_k(scores, ids, k)
    assert sorted((-scores[i], ids[i]) for i in got) == sorted((-s, i) for s, i in rows if s > 0)[:k]


def test_index_is_read_a_shard_at_a_time(spark, tmp_path):
    """Each shard is a row group of its own, which is what Spark's reader holds at once."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"term{i} and term{i + 1}") for i in range(60)], "doc_id long, text string").coalesce(1)
    index = search.build_index(docs, search.corpus_totals(docs), f"file://{tmp_path}", postings=10)
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "index").glob("part-*.parquet")]
    assert index.count() == sum(m.num_rows for m in files) == sum(m.num_row_groups for m in files) >= 15
