"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph's words and word pairs are hashed to features; a sparse multinomial logistic regression gives each licence
family and the unknown class a probability. It is fitted on labelled paragraphs, a bounded sample: variants of the
templates below, made by rule, ordinary sentences about licences, and paragraphs of the corpus at hand as the unknown
class. The L1 penalty leaves weights to few features. Probabilities are calibrated on held-out variants by a temperature.
A prediction counts only if the paragraph also holds enough of the words of a template of that family.

Scanning is native: texts are split, hashed and looked up in a literal table of weights inside the JVM, without a shuffle.
Paragraphs are passed over only if they have no stem and too few words of every template: none of these could be confirmed.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table

#: Short notices of licence families.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike License."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "Licensed under the GNU General Public License, version 2 or later."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "Released under the ISC License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "Released under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain without any license."),
    ("public-domain", "The author has dedicated the work to the public domain by waiving all rights reserved under copyright law."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright 2020 Example Inc. All rights reserved."),
    ("reserved", "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved."),
)
#: Sentences that speak of licences and rights without granting any.
ORDINARY = (
    "She renewed her driving license at the office last week.",
    "The committee discussed the license fees for television sets.",
    "He has a license to fish in the lake until autumn.",
    "Human rights were the topic of the conference.",
    "The court ruled that the copyright claim had no merit.",
    "You need permission from your teacher to leave early.",
    "The public library is open to the general public on Sunday.",
    "The software update fixes several errors in the source code.",
    "The redistribution of wealth was the aim of the reform.",
    "Our warranty covers all parts for two years.",
    "Tickets are released under the usual terms at noon.",
    "The work was published by the foundation in two volumes.",
    "Version 3 of the program is much faster than version 2.",
    "The author has lived in the city since 2004.",
    "All seats are reserved for members of the club.",
    "The MIT campus lies on the river.",
    "Apache helicopters flew over the town.",
    "A common creative exercise is to write for ten minutes.",
    "The licensed plumber came on Monday.",
    "Licensing rules differ from state to state.",
)
#: Fixed value: what has one of these gets a row, confirmed or not; every template holds one.
STEMS = r"(?i)licen[cs]|rights\x20reserved|permission|public\x20domain|redistribution"

#: Words too common to look for first.
COMMON = frozenset("a all an and any are as by can for free in is it no not of or that the this to under use with without work you".split())

UNKNOWN = "unknown"
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
_BITS = 12
_TOKEN = r"[a-z0-9]+(?:[.-][0-9]+)*"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.translate({c: c + 32 for c in range(65, 91)}))


def needed(words: int, least: float) -> int:
    """How many of a template's distinct words make its likeness `least` or more."""
    return next(k for k in range(words + 1) if k == words or k / words >= least)


def anchors(least: float) -> str:
    """A pattern that every text matches which has `least` or more of the distinct words of some template.

    If k of n words are needed, n - k + 1 of them cannot all be missing; the longest that are not common are taken.
    """
    wanted = set()
    for _, text in TEMPLATES:
        ws = sorted(set(tokens(text)), key=lambda w: (w in COMMON, -len(w), w))
        wanted.update(ws[: len(ws) - max(1, needed(len(ws), least)) + 1])
    ends = ((w.replace(".", "[.]").replace("-", "[-]"), "0-9" if re.search("[.-]", w) else "a-z0-9") for w in sorted(wanted))
    # a word may begin right after the digits of another
    return r"(?i)(?<![a-z])(?:" + "|".join(f"{w}(?![{after}])" for w, after in ends) + ")"


def _words(text: str) -> str:
    """SQL for the tokens of a text."""
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '({_TOKEN})', 1)"


def _likely(words: str, least: float) -> str:
    """SQL for whether the array of words has `least` or more of the distinct words of some template."""
    sets = sorted({tuple(sorted(set(tokens(t)))) for _, t in TEMPLATES})
    every = ",".join(f"'{w}'" for w in sorted({w for s in sets for w in s}))
    held = f"array_intersect({words}, array({every}))"
    return f"""exists(transform(array({held}), h -> exists({_arrays(sets)}, s -> size(array_intersect(split(s, ','), h)) / size(split(s, ',')) >= {least!r}D)), x -> x)"""


def feature(gram: str) -> int:
    """As in SQL: the number of the first three bytes of the MD5 digest, cut to _BITS."""
    return int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) & ((1 << _BITS) - 1)


def features(text: str) -> dict[int, float]:
    """Each distinct word and pair of neighbours once; of unit length, so that long paragraphs weigh no more."""
    ws = tokens(text)
    found = {feature(g) for g in {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}}
    return dict.fromkeys(found, 1 / math.sqrt(len(found))) if found else {}


def variants(seed: int, times: int) -> list[tuple[str, str]]:
    """Labelled paragraphs by rule: each template and ordinary sentence with words before, after, left out or repeated."""
    rng = np.random.default_rng(seed)
    filler = [w for t in ORDINARY for w in tokens(t)]
    out = []
    for family, text in (*TEMPLATES, *((UNKNOWN, t) for t in ORDINARY)):
        for i in range(times):
            ws = text.split()
            if i and len(ws) > 4:
                ws = [w for w in ws if rng.random() > 0.08 * (i % 3)]
            before = list(rng.choice(filler, rng.integers(0, 6))) if i % 2 else []
            after = list(rng.choice(filler, rng.integers(0, 9))) if i % 4 > 1 else []
            out.append((family, " ".join([*before, *ws, *after])))
    return out


def corpus_paragraphs(docs: DataFrame, most: int = 400, least: float = 0.6) -> list[str]:
    """Up to `most` paragraphs that would not be looked at, of the documents with the least id hashes: a bounded sample for the unknown class."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    wanted = [r[0] for r in ids.collect()]
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 20) & ~x.rlike(STEMS))
    first = F.expr(f"get(filter(lines, x -> NOT {_likely(_words('x'), least)}), 0)")
    rows = docs.where(F.col("doc_id").isin(wanted)).select(lines.alias("lines")).select(F.substring(first, 1, 1000).alias("p")).where("p IS NOT NULL")
    return sorted(r[0] for r in rows.limit(most).collect())


class Classifier:
    """Weights by feature and class, and the temperature."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes = (*FAMILIES, UNKNOWN)
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, text: str) -> dict[str, float]:
        z = self.bias.copy()
        for f, v in features(text).items():
            z += v * self.weights[f]
        e = np.exp((z - z.max()) / self.temperature)
        return dict(zip(self.classes, (e / e.sum()).tolist(), strict=True))


def fit(unlabelled: list[str], penalty: float = 2e-4, steps: int = 400, times: int = 8) -> Classifier:
    """Proximal gradient descent on the mean log loss with an L1 penalty; the temperature by search on other variants.

    The labelled sample has `times` variants of each fixed text and the given corpus paragraphs: the documented bound.
    """
    classes = (*FAMILIES, UNKNOWN)

    def matrix(rows):
        x = np.zeros((len(rows), 1 << _BITS))
        for i, (_, text) in enumerate(rows):
            for f, v in features(text).items():
                x[i, f] = v
        return x, np.array([classes.index(c) for c, _ in rows])

    def soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    half = len(unlabelled) // 2
    x, y = matrix([*variants(1, times), *((UNKNOWN, t) for t in unlabelled[half:])])
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    share = np.bincount(y, minlength=len(classes))
    each = (1 / np.maximum(1, share))[y]
    each /= each.sum()
    w, b = np.zeros((len(used), len(classes))), np.zeros(len(classes))
    hot = np.eye(len(classes))[y]
    rate, v, t = 8.0, w.copy(), 1.0
    for _ in range(steps):
        g = (soft(x @ v + b) - hot) * each[:, None]
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        b -= rate * 0.1 * g.sum(axis=0)
    whole = np.zeros((1 << _BITS, len(classes)))
    whole[used] = np.round(w, 4)
    hx, hy = matrix([*variants(2, times), *((UNKNOWN, t) for t in unlabelled[:half])])
    z = hx @ whole + b
    loss = lambda k: -np.log(soft(z / k)[np.arange(len(hy)), hy] + 1e-12).mean()
    return Classifier(whole, np.round(b, 4), min((0.05 * 1.15**i for i in range(40)), key=loss))


def _arrays(rows: list[list]) -> str:
    return "split('" + ";".join(",".join(map(str, r)) for r in rows) + "', ';')"


def _candidates(least: float) -> str:
    """SQL for what to judge of a text's `lines`, given the `near` templates: structs of the first line, how many, stem and words.

    Lines with a stem or enough words of a template; and stretches of two or more lines without one that has no word, each
    from a line with words of a template to one that adds the needed or a further word. A stretch has at most as many lines
    as the template has words, so that a notice is whole even if each of its words is a line.
    """
    held = "transform(lines, l -> CASE WHEN l RLIKE '[A-Za-z0-9]' THEN " + _words("l") + " END)"
    grown = "array_union(a.h, array_intersect(t.words, x))"
    stretches = f"""flatten(transform(near, t -> flatten(transform(held, (first, i) -> CASE WHEN arrays_overlap(first, t.words) THEN aggregate(
        slice(held, i + 1, t.most), struct(CAST(array() AS array<string>) AS h, 0 AS n, true AS open, CAST(array() AS array<struct<i:int,n:int>>) AS got),
        (a, x) -> CASE WHEN NOT a.open OR x IS NULL THEN struct(a.h AS h, a.n AS n, false AS open, a.got AS got) ELSE struct(
          {grown} AS h, a.n + 1 AS n, true AS open,
          CASE WHEN a.n > 0 AND size({grown}) >= t.need AND size({grown}) > size(a.h) THEN array_append(a.got, struct(i AS i, a.n + 1 AS n)) ELSE a.got END AS got) END,
        a -> a.got) ELSE CAST(array() AS array<struct<i:int,n:int>>) END))))"""
    joined = f"""CASE WHEN size(near) > 0 AND size(lines) > 1 THEN flatten(transform(array({held}), held -> array_distinct({stretches})))
      ELSE CAST(array() AS array<struct<i:int,n:int>>) END"""
    single = "filter(transform(lines, (l, i) -> struct(i AS i, 1 AS n, l RLIKE stems AS stem, l AS p)), x -> x.stem OR size(near) > 0)"
    every = f"concat({single}, transform({joined}, x -> struct(x.i AS i, x.n AS n, false AS stem, array_join(slice(lines, x.i + 1, x.n), ' ') AS p)))"
    every = f"transform({every}, x -> struct(x.i AS i, x.n AS n, x.stem AS stem, {_words('x.p')} AS w))"
    return f"filter({every}, x -> x.stem OR {_likely('x.w', least)})"


def scan(docs: DataFrame, model: Classifier, threshold: float = 0.5, least: float = 0.6, close: float = 0.5) -> DataFrame:
    """A row for each paragraph of docs (doc_id, text): a line that has a stem or whose family is confirmed, or several
    lines that hold a notice together.

    doc_id, paragraph (the number of its first line from 0), family (unknown if the likeliest class is, if its probability is
    under the threshold or no template confirms it; of classes that are `close` to it in probability or more, the one whose
    template is most alike), predicted (the likeliest class), probability, template (its number, -1 if none), likeness
    (the share of the template's distinct words that the paragraph has; `least` or more confirms) and lines (how many).
    Paragraphs of several lines are confirmed, hold no line confirmed as the same family and share no line: the likest go
    first, then the shortest. Null and empty texts have no paragraphs; null and repeated doc_ids are rows like others;
    other columns are ignored.
    """
    used = np.flatnonzero(np.abs(model.weights).sum(axis=1))
    place = {int(f): i for i, f in enumerate(used)}
    slots = ",".join(str(place.get(f, -1)) for f in range(1 << _BITS))
    weights = ",".join(repr(round(float(x), 4)) for x in model.weights[used].reshape(-1))
    classes, k = model.classes, len(model.classes)
    families = "array(" + ",".join(f"'{c}'" for c in classes) + ")"
    bias = ",".join(f"{x:.4f}D" for x in model.bias)
    quoted = [",".join(f"'{w}'" for w in sorted(set(tokens(t)))) for _, t in TEMPLATES]
    templates = ",".join(
        f"named_struct('words', array({q}), 'need', {needed(len(set(tokens(t))), least)}, 'most', {len(tokens(t))}, 'owner', {classes.index(f)})"
        for q, (f, t) in zip(quoted, TEMPLATES, strict=True)
    )
    stems = "'" + STEMS.replace("\\", "\\\\") + "'"

    # what lacks a stem needs enough words of a template: first one of the anchors, then the count
    stem, anchored = F.col("text").rlike(STEMS), F.col("text").rlike(anchors(least))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(stem | anchored)
    every = ",".join(f"'{w}'" for w in sorted({w for _, t in TEMPLATES for w in tokens(t)}))
    near = f"flatten(transform(array(array_intersect({_words('text')}, array({every}))), h -> filter(array({templates}), t -> size(array_intersect(t.words, h)) >= t.need)))"
    rows = rows.select("doc_id", F.split("text", "\n").alias("lines"), F.expr(near).alias("near"))
    c = _candidates(least).replace("RLIKE stems", f"RLIKE {stems}")
    rows = rows.select("doc_id", F.expr(c).alias("c"))

    def step(**more: str) -> None:
        nonlocal rows
        fields = ", ".join(f"x.{f.name} AS {f.name}" for f in rows.schema["c"].dataType.elementType.fields if f.name not in more)
        rows = rows.withColumn("c", F.expr(f"transform(c, x -> struct({fields}, {', '.join(f'{e} AS {n}' for n, e in more.items())}))"))

    pairs = "transform(slice(x.w, 2, greatest(size(x.w) - 1, 0)), (v, i) -> concat(get(x.w, i), ' ', v))"
    step(f=f"array_distinct(transform(array_union(x.w, {pairs}), g -> cast(conv(substring(md5(g), 1, 6), 16, 10) as int) & {(1 << _BITS) - 1}))")
    step(at=f"filter(transform(x.f, v -> cast(get(split('{slots}', ','), v) as int)), i -> i >= 0)")
    # one sum for each class over the features that have weights
    table_sql = f"CAST(split('{weights}', ',') AS array<double>)"
    step(z=f"""transform(array({bias}), (b, c) -> (b + coalesce(aggregate(x.at, 0.0D, (s, i) -> s + get({table_sql}, i * {k} + c)), 0.0D) / sqrt(greatest(size(x.f), 1))) / {model.temperature!r}D)""")
    step(top="array_max(x.z)")
    step(probability="1 / aggregate(x.z, 0.0D, (s, v) -> s + exp(v - x.top))", class_="cast(array_position(x.z, x.top) - 1 as int)")
    step(best=f"""array_max(transform(array({templates}), (t, i) ->
      named_struct('likeness', CASE WHEN exp(get(x.z, t.owner) - x.top) >= {close!r}D THEN size(array_intersect(t.words, x.w)) / size(t.words) ELSE 0.0D END,
                   'own', t.owner = x.class_, 'number', -i, 'owner', t.owner)))""")
    sure = f"x.class_ <> {classes.index(UNKNOWN)} AND x.probability >= {threshold!r}D AND x.best.likeness >= {least!r}D"
    rows = rows.withColumn("c", F.expr(f"""transform(c, x -> struct(
      -x.best.likeness AS unlike, x.n AS n, x.i AS i, x.stem AS stem, CASE WHEN {sure} THEN get({families}, x.best.owner) ELSE '{UNKNOWN}' END AS family,
      get({families}, x.class_) AS predicted, x.probability AS probability, CASE WHEN x.best.likeness > 0 THEN -x.best.number ELSE -1 END AS template))"""))
    # a stretch of lines that a line or a better stretch speaks for goes
    shared = "y.i < x.i + x.n AND x.i < y.i + y.n"
    rows = rows.withColumn("c", F.expr(f"""aggregate(array_sort(filter(c, x -> x.n > 1 AND x.family <> '{UNKNOWN}')), filter(c, x -> x.n = 1 AND (x.stem OR x.family <> '{UNKNOWN}')),
      (a, x) -> CASE WHEN exists(a, y -> {shared} AND (y.n > 1 OR y.family = x.family)) THEN a ELSE array_append(a, x) END)"""))  # fmt: skip
    # an outer generator: of an inner one, Spark makes a filter on the size of `c` and writes all of the above out again below
    return rows.select("doc_id", F.inline_outer("c")).where("n IS NOT NULL").select(
        "doc_id", F.col("i").cast("long").alias("paragraph"), "family", "predicted", "probability", "template", (-F.col("unlike")).alias("likeness"), F.col("n").alias("lines"),
    )


def op5_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(corpus_paragraphs(docs)))
