"""Text analysis in columns: words, identifier parts and CJK grams; text queries; term frequency and BM25."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import quoted

_CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af"
_RUN = rf"[{_CJK}]+|[\p{{L}}\p{{Nd}}_&&[^{_CJK}]]+"
#: Places inside an identifier where a part ends: aB, a1, 1a, ABc.
_EDGE = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: A run without such a place or a low line, which is its only token; most are.
_PLAIN = r"^\p{Lu}?\p{Ll}+$"


def tokens_sql(text: str, needles: Sequence[str] | None = None) -> str:
    """All tokens of a text, in lower case: an identifier and its distinct parts; single CJK signs, then pairs.

    needles: only the runs of the text that hold one of these are cut into tokens; a token lies in its run.
    """
    parts = f"flatten(transform(filter(split(r, '_'), p -> trim(p) <> ''), p -> split(p, {quoted(_EDGE)})))"
    word = f"filter(array_distinct(concat(array(r), {parts})), p -> trim(p) <> '')"
    signs = "filter(split(r, ''), c -> c <> '')"
    pairs = "CASE WHEN length(r) > 1 THEN transform(sequence(1, length(r) - 1), k -> substring(r, k, 2)) ELSE CAST(array() AS array<string>) END"
    runs = f"regexp_extract_all({text}, {quoted(_RUN)}, 0)"
    if needles is not None:
        runs = f"filter({runs}, r -> {' OR '.join(f'contains(lower(r), {quoted(n)})' for n in needles) or 'false'})"
    each = f"transform({runs}, r -> CASE WHEN r RLIKE {quoted(_PLAIN)} THEN array(r) WHEN r RLIKE {quoted(f'^[{_CJK}]')} THEN concat({signs}, {pairs}) ELSE {word} END)"
    return f"transform(flatten({each}), t -> lower(t))"


_PY_RUN = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]+|(?:(?![\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af])\\w)+")


def analyze(text: str) -> list[str]:
    """The same on the driver, for the constant text of a query."""

    def kind(c: str) -> str:
        return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" if c.isalpha() else "-"

    out = []
    for run in _PY_RUN.findall(text):
        if "\u3040" <= run[0] <= "\u30ff" or "\u3400" <= run[0] <= "\u4dbf" or "\u4e00" <= run[0] <= "\u9fff" or "\uac00" <= run[0] <= "\ud7af":
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
            continue
        found = {run: None}
        for part in filter(str.strip, run.split("_")):
            start = 0
            for i in range(1, len(part)):
                a, b, c = kind(part[i - 1]), kind(part[i]), kind(part[i + 1]) if i + 1 < len(part) else ""
                if a == "l" and b == "u" or a in "ulo" and b == "d" or a == "d" and b in "ulo" or a == b == "u" and c == "l":
                    found[part[start:i]] = None
                    start = i
            found[part[start:]] = None
        out += [p for p in found if p.strip()]
    return [t.lower() for t in out]


def split_or(query: str) -> list[str]:
    """Clauses between OR, which stands in white space outside quotes."""
    out, start, i, quoted_ = [], 0, 0, False
    while i < len(query):
        if query[i] == '"':
            quoted_ = not quoted_
        around = query[i - 1 : i].isspace() and query[i + 2 : i + 3].isspace()
        if not quoted_ and query[i : i + 2].upper() == "OR" and around:
            out.append(query[start:i])
            i += 2
            start = i
        else:
            i += 1
    return [c.strip() for c in (*out, query[start:]) if c.strip()]


def clauses(query: str) -> list[list[tuple[str, object]]]:
    """The query's clauses as (phrase | prefix | word, text or the terms of a word)."""
    out = []
    for clause in split_or(query):
        parts: list[tuple[str, object]] = []
        for phrase, raw in re.findall(r'"([^"]+)"|(\S+)', clause):
            if phrase:
                parts.append(("phrase", phrase.removesuffix("*")))
            elif raw.endswith("*"):
                parts.append(("prefix", raw[:-1].lower()))
            else:
                parts.append(("word", list(dict.fromkeys(analyze(raw)))))
        if parts:
            out.append(parts)
    return out


def needles_of(query: str) -> list[str]:
    """What a run must hold to give a token that the query looks at."""
    return sorted({n for c in clauses(query) for kind, x in c if kind != "phrase" for n in ([x] if kind == "prefix" else x)})


def may_match_sql(text: str, query: str) -> str:
    """A test that every matching text passes, in substrings alone.

    Not on a sigma: what it becomes in lower case depends on what stands beside it.
    """
    every = []
    for c in clauses(query):
        parts = [n for kind, x in c for n in ([x.lower()] if kind == "phrase" else [x] if kind == "prefix" else x)]
        every.append(" AND ".join(f"contains(low, {quoted(n)})" for n in parts if not set(n) & {"\u03c3", "\u03c2"}) or "true")
    return f"exists(array(lower({text})), low -> {' OR '.join(f'({x})' for x in every)})" if every else "false"


def query_score_sql(text: str, query: str, count: Callable[[str], str], starting: Callable[[str], str], holding: Callable[[str], str] | None = None) -> str:
    """The score of a text under a query: `a b` (both), `a OR b`, `"a phrase"`, `prefix*`; 0 where it does not match.

    A clause's score adds up its terms': mean counts of the tokens of a word, 1 for a phrase, tokens with a prefix. count
    and starting give SQL for how many tokens are a term, or begin with one; holding, if given, for whether a phrase is
    there (over 0), else the text itself says so.
    """
    out = []
    for clause in clauses(query):
        tests, scores = [], []
        for kind, x in clause:
            if kind == "phrase":
                tests.append(f"{holding(x)} > 0" if holding else f"contains(lower({text}), lower({quoted(x)}))")
                scores.append("1.0D")
            elif kind == "prefix":
                tests.append(f"{starting(x)} > 0")
                scores.append(f"CAST({starting(x)} AS DOUBLE)")
            elif x:
                tests += [f"{count(t)} > 0" for t in x]
                scores.append("(" + " + ".join(map(count, x)) + f") / CAST({len(x)} AS DOUBLE)")
            else:
                scores.append("0.0D")
        out.append(f"CASE WHEN {' AND '.join(tests) or 'true'} THEN {' + '.join(scores)} ELSE 0.0D END")
    return f"greatest({', '.join(out)})" if len(out) > 1 else (out or ["0.0D"])[0]


def matches_sql(text: str, tokens: str, query: str, mode: str, case_sensitive: bool = False) -> str:
    """CONTAINS and PHRASE: a substring; ALL_TERMS and ANY_TERM: tokens."""
    if mode in ("CONTAINS", "PHRASE"):
        return f"contains({text}, {quoted(query)})" if case_sensitive else f"contains(lower({text}), {quoted(query.lower())})"
    terms = list(dict.fromkeys(analyze(query)))
    if not terms:
        return "false"
    arr = "array(" + ", ".join(map(quoted, terms)) + ")"
    test = f"size(array_except({arr}, {tokens})) = 0" if mode == "ALL_TERMS" else f"arrays_overlap({arr}, {tokens})"
    return f"{_holds_sql(text, terms, ' AND ' if mode == 'ALL_TERMS' else ' OR ')} AND {test}"


def _holds_sql(text: str, terms: Sequence[str], joined: str) -> str:
    """A test in substrings that a text passes if it has all (joined by AND) or some (by OR) of the terms among its tokens.

    Not on a sigma, as in may_match_sql().
    """
    tests = ["true" if set(t) & {"\u03c3", "\u03c2"} else f"contains(low, {quoted(t)})" for t in terms]
    return f"exists(array(lower({text})), low -> {joined.join(tests)})"


def _length_sql(text: str) -> str:
    """How many tokens a text has. Where no run is cut, they are its runs, which are counted without being looked at."""
    return f"CASE WHEN {text} RLIKE {quoted(f'[_{_CJK}]|{_EDGE}')} THEN size({tokens_sql(text)}) ELSE size(regexp_extract_all({text}, {quoted(_RUN)}, 0)) END"


def bm25(texts: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, match: str | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """texts (text_id, text) with a score for each: BM25 over all texts, distinct query terms; no terms score 1.

    match: SQL; only texts that it holds of are scored, after all have been counted. lengths: (text_id, n) of the texts, if
    they were kept. Documents, their lengths and the terms' document frequencies are counted in one aggregation, which has
    one row; the texts are looked at twice rather than kept.
    """
    terms = list(dict.fromkeys(analyze(query)))
    wanted = texts.where(match) if match else texts
    if not terms:
        return wanted.withColumn("score", F.lit(1.0))

    def sized(df: DataFrame) -> DataFrame:
        if lengths is not None:
            df = df.join(lengths.select("text_id", F.col("n").alias("_n")), "text_id")
        else:
            df = df.withColumn("_n", F.expr(_length_sql("text")))
        # only the runs that hold a term are cut, and only of texts that hold one
        return df.withColumn("_tokens", F.expr(f"CASE WHEN {_holds_sql('text', terms, ' OR ')} THEN {tokens_sql('text', terms)} ELSE CAST(array() AS array<string>) END"))

    toks = sized(texts)
    has: list[Column] = [F.sum(F.array_contains("_tokens", t).cast("long")) for t in terms]
    stats = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("avgdl"), *[h.alias(f"df{i}") for i, h in enumerate(has)]).first()
    total, avg = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df = stats[f"df{i}"] or 0
        tf = F.expr(f"CAST(size(filter(_tokens, x -> x = {quoted(t)})) AS DOUBLE)")
        idf = F.log(F.lit(1 + (total - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.lit(avg)))
    return sized(wanted).withColumn("score", score).drop("_tokens", "_n")
