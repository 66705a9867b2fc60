"""Lengths of texts and the words that BM25 counts, without cutting every run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx

ODD = ["plain words here", "Title And more", "parseHTTPRequest2xx", "snake_case __ _", "\u3053\u3093\u306b\u3061\u306f abc", "a1 b2", "HTTP", "\u00aa\u00ba b", "", "...", None, "\u039f\u0394\u039f\u03a3 red", "Red bolt, RED"]


def test_lengths(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "text string")
    rows = df.select("text", F.expr(tx._length_sql("text")).alias("n"), F.expr(f"size({tx.tokens_sql('text')})").alias("want")).collect()
    assert [r["n"] for r in rows] == [r["want"] for r in rows]
    assert {r["text"]: r["n"] for r in rows}["parseHTTPRequest2xx"] == len(tx.analyze("parseHTTPRequest2xx"))


def test_texts_without_a_term_are_not_cut(spark):
    """A substring test stands before the tokens, in the matches and in the scores."""
    df = spark.createDataFrame(list(enumerate(ODD)), "text_id int, text string")
    match = tx.matches_sql("text", tx.tokens_sql("text", ["red"]), "red", "ALL_TERMS")
    assert "contains(low, 'red')" in match.split(" AND ")[0]
    got = tx.bm25(df, "red", match=match)
    assert sorted(r["text_id"] for r in got.collect()) == [11, 12]
    every = {r["text_id"]: r["score"] for r in tx.bm25(df, "red").where("text IS NOT NULL").collect()}
    assert {k for k, v in every.items() if v > 0} == {11, 12} and every[12] > every[11]
