"""Near-duplicates, substring dedup, the language model, licences and the pipeline against brute force; edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import common, decontaminate, graph, language_model, licenses, near_dups, quality, substrings
from tests.llm.test_text_operators import SF, brute_counts, empty, odd  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


# components


def test_components(spark, tmp_path):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    union = Union()
    for a, b in links:
        if a is not None and a != b:
            union.join(a, b)
    got = graph.components(spark.createDataFrame(links, "a long, b long"), str(tmp_path / "c"), "x")
    assert {(r["id"], r["component"]) for r in got.collect()} == {(x, union.root(x)) for x in list(union.up)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "d"), "x").count() == 0


# near-duplicates


def brute_near(rows, size):
    sets = [(i, near_dups.shingle_set(t, size)) for i, t in rows if t and i is not None]
    union = Union()
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            union.join(a, b)
    return union


def planted(seed=4):
    """Groups of near copies around 0.8, chains, short texts, and texts that share common words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for n in (1, 2, 3, 5, 12, 40, 60, 150, 400):
        for _ in range(6):
            base = rng.choices(vocab[:60] + vocab, k=n)
            for edits in (0, 0, 1, 2, n // 30, n // 15, n // 10, n // 8):
                ws = list(base)
                for _ in range(edits):
                    ws[rng.randrange(len(ws))] = rng.choice(vocab)
                rows.append((k, " ".join(ws)))
                k += 1
            for _ in range(3):  # a chain: each a little further from the last
                ws = rows[-1][1].split()
                for _ in range(max(1, n // 20)):
                    ws[rng.randrange(len(ws))] = rng.choice(vocab)
                rows.append((k, " ".join(ws)))
                k += 1
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], t) for i, t in rows]


@pytest.mark.parametrize(("size", "rounds"), [(2, 1), (5, 0)])
def test_near_duplicates(spark, size, rounds):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    union = brute_near(rows, size)
    got = near_dups.near_duplicates(df, near_dups.Params(shingle=size, rounds=rounds)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r["n_shingles"] == len(near_dups.shingle_set(texts[r["doc_id"]], size))
        assert r["component_id"] == union.root(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_query(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    union = brute_near(rows, 2)
    got = near_dups.op9_bottomk_near_dups(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: union.root(i) for i, _ in rows}


def test_near_duplicates_edges(spark, odd):  # noqa: F811
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (0, 4, None, True), (4, 1, 4, True), (4, 1, 4, True), (5, 3, 5, True), (6, 1, 6, True)], key=str)
    assert near_dups.near_duplicates(empty(spark, odd)).count() == 0
    kept = near_dups.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    twice = spark.createDataFrame([(9, "a b c d e f g"), (7, "A b c d E f g"), (8, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dups.keep_one(twice).collect()) == [7, 8]


def test_sketches_share_enough():
    """The chance that sketches of sets at the limit share fewer values than the lists rely on."""
    p = near_dups.Params()
    fewer = lambda k, r: sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(r))
    assert fewer(p.k, p.shared) < 1e-7 and fewer(p.brief, p.brief_shared) < 1e-7


# substring dedup


def brute_cut(rows, size):
    first = {}
    for i, t in rows:
        ws = common.words(t)
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k : k + size])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = collections.Counter()
    for i, t in rows:
        ws = common.words(t)
        keep = [True] * len(ws)
        for k in range(len(ws) - size + 1):
            if i is not None and first[tuple(ws[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        out[(i, len(ws), keep.count(False), " ".join(w for w, c in zip(ws, keep, strict=True) if c))] += 1
    return out


def passages(seed=8):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(50)]
    shared = [rng.choices(vocab, k=n) for n in (49, 50, 51, 70, 130)]
    rows = []
    for i in range(150):
        ws = rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            ws += rng.choice(shared) + rng.choices(vocab, k=rng.randrange(0, 30))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(ws)))
    rows += [(200 + i, "same " * 60) for i in range(4)] + [(3, rows[120][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [2000, 2])
def test_substring_dedup(spark, heavy):
    rows = passages()
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), heavy=heavy)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == brute_cut(rows, 50)


def test_substring_query(spark, docs):
    want = brute_cut([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    got = substrings.op6_superkmer_dedup(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == {
        (i, n, m, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, m, t), c in want.items()
    }


def test_substring_edges(spark, odd):  # noqa: F811
    got = substrings.dedup(odd, digests=True)
    assert got.count() == 8 and {r["n_removed"] for r in got.collect()} == {0}
    assert substrings.dedup(empty(spark, odd)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=0, max_size=120))
def test_minimiser_runs(values):
    h = common.mix64(np.array(values, np.uint64) + np.uint64(1))
    mini, first, windows = substrings.minimiser_runs(h, 20, 4)
    assert windows.sum() == max(0, len(values) - 19)
    assert first.tolist() == [int(x) for x in np.cumsum([0, *windows[:-1]])] if len(first) else True


def test_oracles(spark):
    """The registered SQL gives what the queries give, and names only queries that exist."""
    import duckdb

    from tessella.llm import queries

    every, c = queries.queries(), duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(queries.oracle_sql()) <= set(every)
    for name, sql in queries.oracle_sql().items():
        df, want = every[name](spark, SF), c.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


# language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(spark, docs, order):
    every = docs.select("doc_id", "text").limit(60)
    rows = every.collect()
    model = language_model.train(every, order)
    got = {r["doc_id"]: r for r in language_model.score(every, model).collect()}
    toks = {r["doc_id"]: [common.lower_ascii(w) for w in common.words(r["text"])] + ["</s>"] for r in rows}
    train = [t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    raw = collections.Counter(itertools.chain(*train))
    total, types = sum(raw.values()), len(raw)
    grams = {order: collections.Counter()}
    for t in train:
        t = ["<s>"] * (order - 1) + t
        grams[order].update(tuple(t[i - order + 1 : i + 1]) for i in range(order - 1, len(t)))
    for n in range(order - 1, 0, -1):
        grams[n] = collections.Counter(g[1:] for g in grams[n + 1])
    cut = {n: language_model.discounts(*[sum(c == k for c in g.values()) for k in (1, 2, 3, 4)]) for n, g in grams.items()}
    after = {n: collections.defaultdict(lambda: [0, 0, 0, 0]) for n in grams}
    for n, g in grams.items():
        for key, c in g.items():
            after[n][key[:-1]][0] += c
            after[n][key[:-1]][min(c, 3)] += 1

    def p(n, key):
        if n == 0:
            return 1 / (types + 1)
        low, s = p(n - 1, key[1:]), after[n].get(key[:-1])
        if not s:
            return low
        c = grams[n].get(key, 0)
        return max(c - (cut[n][min(c, 3) - 1] if c else 0), 0) / s[0] + sum(x * y for x, y in zip(cut[n], s[1:], strict=True)) / s[0] * low

    for i, t in toks.items():
        r, padded = got[i], ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(order, tuple(padded[k - order + 1 : k + 1]))) for k in range(order - 1, len(padded)))
        base = sum(math.log10((raw[w] + 1) / (total + types + 1)) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(raw[w] > 0 for w in t), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    # what may follow a context adds up to one
    if order == 2:
        known = [*raw, "<never>"]
        assert math.isclose(sum(p(2, (train[0][0], w)) for w in known), 1, rel_tol=1e-9)


def test_frequent_grams(spark):
    """Counts of 255 and more have an array of their own."""
    df = spark.createDataFrame([(i, "a b " * 200) for i in range(7)], "doc_id long, text string")
    model = language_model.train(df, 2)
    r = language_model.score(df, model).first()
    assert r["n_known"] == 401 and r["score"] / r["n_tokens"] > -0.02


def test_language_model_query(spark, docs):
    """The query scores trigrams."""
    want = {r["doc_id"]: r["score"] for r in language_model.score(docs, language_model.train(docs, 3)).collect()}
    got = {r["doc_id"]: r["score"] for r in language_model.op4_kneser_ney(spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], x, rel_tol=1e-9) for i, x in want.items())


def test_language_model_edges(spark, odd):  # noqa: F811
    got = language_model.score(odd, language_model.train(odd)).collect()
    assert len(got) == 8 and all(math.isfinite(r["score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got)[:3] == [1, 1, 1]
    none = empty(spark, odd)
    model = language_model.train(none)
    assert language_model.score(none, model).count() == 0
    assert language_model.score(odd, model).where("score <> 0").count() == 0


# licences


@pytest.fixture(scope="module")
def classifier(docs):
    return licenses.fit(licenses.corpus_paragraphs(docs))


def test_held_out_accuracy(classifier):
    held = licenses.variants(99, 6)
    right = 0
    for family, text in held:
        p = classifier.probabilities(text)
        right += max(p, key=p.get) == family
    assert right / len(held) > 0.95


#: Notices and sentences in other words than those of the templates.
OTHER_WORDS = (
    ("mit", "Copyright 2019 The Authors. This project is distributed under the terms of the MIT license."),
    ("mit", "The software is provided under the MIT License, see LICENSE.txt"),
    ("apache", "This product is licensed to you under the Apache License, Version 2.0."),
    ("apache", "Distributed under the Apache 2.0 license."),
    ("gpl", "This file is part of a program that is distributed under the GNU General Public License version 2."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("agpl", "Available under the terms of the GNU Affero General Public License version 3 or later."),
    ("bsd", "Licensed under the 3-clause BSD license."),
    ("bsd", "Use of this code is governed by a BSD-style license."),
    ("cc", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license."),
    ("cc", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("mpl", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("isc", "Licensed under the ISC license."),
    ("public-domain", "This work has been released into the public domain by its author."),
    ("reserved", "Copyright 2015 by the publisher. All rights reserved worldwide."),
    ("unknown", "The driver must carry his license at all times."),
    ("unknown", "The apache tribe lived in the south west of the country."),
    ("unknown", "The general public may visit the gardens free of charge."),
    ("unknown", "Rights to the film were sold to a studio last spring."),
    ("unknown", "Students need the permission of the dean to change their courses."),
    ("unknown", "The new version of the game was released under great applause."),
)


def test_other_words_than_the_templates(spark, classifier):
    """The classifier names most of them; what the templates confirm is never of another family."""
    best = [max(p, key=p.get) for p in (classifier.probabilities(t) for _, t in OTHER_WORDS)]
    assert sum(b == f for b, (f, _) in zip(best, OTHER_WORDS, strict=True)) >= 0.8 * len(OTHER_WORDS)
    df = spark.createDataFrame(list(enumerate(t for _, t in OTHER_WORDS)), "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in licenses.scan(df, classifier).collect() if r["family"] != "unknown"}
    assert len(found) >= 8 and all(OTHER_WORDS[i][0] == f for i, f in found.items())


def test_license_scan(spark, docs, classifier):
    extra = [(1, "the license of my heart\nReleased under the MIT License. Have fun\nCopyright (c) 2021 ACME. All rights reserved.\nplain"), (2, None), (3, ""), (4, "\n".join(licenses.ORDINARY))]
    df = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.selectExpr("doc_id + 100", "text").toDF("doc_id", "text"))
    got = {(r["doc_id"], r["paragraph"]): r for r in licenses.scan(df, classifier).collect()}
    assert [got[1, i]["family"] for i in range(3)] == ["unknown", "mit", "reserved"]
    assert all(r["family"] == "unknown" for (d, _), r in got.items() if d == 4)
    for r in df.collect():
        for i, line in enumerate((r["text"] or "").split("\n")):
            import re

            assert ((r["doc_id"], i) in got) == bool(re.search(licenses.STEMS.replace(r"\x20", " "), line))
            if (r["doc_id"], i) in got:
                p = classifier.probabilities(line)
                best = max(p, key=p.get)
                x = got[r["doc_id"], i]
                assert x["predicted"] == best and math.isclose(x["probability"], p[best], abs_tol=1e-6)


def test_license_edges(spark, odd, classifier):  # noqa: F811
    assert licenses.scan(odd, classifier).count() == 0
    assert licenses.scan(empty(spark, odd), classifier).count() == 0
    plan = licenses.scan(odd, classifier)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert all(__import__("re").search(licenses.STEMS.replace(r"\x20", " "), t) for _, t in licenses.TEMPLATES)


def test_licenses_without_a_stem(spark, docs, classifier):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU GPL as published by the Free Software Foundation."
    texts = ["Released under CC BY 4.0.", "This content is available under CC BY-SA 4.0.", gpl, "It can be read by all under the roof."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["\n".join(["plain words", *texts]), *texts])], "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(df, classifier).collect()}
    assert got == {(0, 1): "cc", (0, 2): "cc", (0, 3): "gpl", (1, 0): "cc", (2, 0): "cc", (3, 0): "gpl"}


def test_wrapped_licenses(spark, classifier):
    import textwrap

    gpl = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )
    bsd, agpl, mit = (next(t for f, t in licenses.TEMPLATES if f == x) for x in ("bsd", "agpl", "mit"))
    rows, want = [], set()
    for i, (family, text) in enumerate((("gpl", gpl), ("bsd", bsd), ("agpl", agpl), ("mit", mit))):
        for j, (width, mark) in enumerate(((66, ""), (40, " * "), (66, "# "))):
            lines = [mark + x for x in textwrap.wrap(text, width)]
            n = 10 * i + j
            rows.append((n, "\n".join(["A first line of prose", mark.rstrip(), "Some words before", *lines, "import something", mark.rstrip(), "A last line"])))
            want.add((n, family))
        rows.append((10 * i + 9, "\n\n".join(textwrap.wrap(text, 24))))  # blank lines between: no notice
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in licenses.scan(df, classifier).collect() if r["family"] != "unknown"]
    assert {(r["doc_id"], r["family"]) for r in got} == want and len(got) == len(want)
    assert all(r["paragraph"] >= 2 and (r["lines"] > 1 or r["family"] in ("agpl", "mit")) for r in got)  # a line of these may do alone
    adjoining = "Released under the MIT License.\n" + "\n".join(textwrap.wrap(bsd, 66))
    got = licenses.scan(spark.createDataFrame([(1, adjoining)], "doc_id long, text string"), classifier).collect()
    assert sorted((r["paragraph"], r["family"]) for r in got if r["family"] != "unknown") == [(0, "mit"), (1, "bsd")]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_anchors_lose_nothing(data):
    import re

    _, text = data.draw(st.sampled_from(licenses.TEMPLATES))
    ws = sorted(set(licenses.tokens(text)))
    for least in (0.3, 0.6, 0.9):
        k = licenses.needed(len(ws), least)
        assert k / len(ws) >= least > (k - 1) / len(ws)
        some = data.draw(st.permutations(ws))[:k]
        joined = "".join(w + data.draw(st.sampled_from([" ", "-", "/x1.0", ". "])) for w in some)
        if len(set(ws) & set(licenses.tokens(joined))) >= k:
            assert re.search(licenses.anchors(least), joined.title())


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline
    import public_tokenizers

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zstandard

    packer = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress
    good = {}
    for i, t in rows.items():
        n, *_, rep = brute_counts(t)
        if n >= 20 and 100 * rep <= 30 * n and quality.judge(t.encode(), quality.Bands(), packer)[4]:
            good[i] = t
    union = brute_near(good.items(), 5)
    single = {i: t for i, t in good.items() if union.root(i) == i}
    items = [(r["item_id"], decontaminate.normalise(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items, 0.06)
    clean = {i for i, t in single.items() if not matcher.find(decontaminate.normalise(t))}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == clean
    from tests.llm.test_text_operators import whole

    assert public_tokenizers.path("byte_bpe_50k.json")
    for i, r in got.items():
        assert r["ids"] == whole([r["decoded"]])[0]
        if "[" not in r["decoded"]:
            assert r["decoded"] == rows[i]
    assert all(len(s) == 2 and callable(s[1]) for s in corpus_pipeline.STAGES)


def test_pipeline_edges(spark, docs, odd, tmp_path):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and clashing columns beside sound documents; and no documents at all."""
    import corpus_pipeline

    sound = docs.select("doc_id", "text").limit(40).selectExpr("doc_id + 1000 AS doc_id", "text", "'s' AS shard", "1 AS row", "'i' AS ids", "'k' AS kept", "2 AS _h", "3 AS n", "4 AS at", "'src' AS source")
    every = odd.unionByName(sound)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    every.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, every, str(tmp_path)).columns == every.columns
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "ids", "decoded"] and 0 < got.count() <= 40 and got.where("doc_id < 1000 OR doc_id IS NULL").count() == 0
    empty(spark, every).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
