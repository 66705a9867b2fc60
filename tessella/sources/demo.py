"""Seeded synthetic documents: timelines, types and nodes that link to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, count: int = 1000, seed: int = 42) -> DataFrame:
    """(path, text) of at least 24 documents, equal for equal seeds; made row by row from hashes of their numbers.

    A node has one to three links, a name, an age and a validity on one of the timelines.
    """
    count = max(24, count)
    heads = {
        "Story": "kind: Timeline", "Common": "kind: Timeline\ncoordinate: gregorian", "Being": "kind: NodeType\nprops:\n  name: {type: string}",
        "Person": "kind: NodeType\nextends: Being\nprops:\n  age: {type: number}", "Place": "kind: NodeType\nprops:\n  name: {type: string}", "knows": "kind: RelType\nprops:\n  weight: {type: number}",
    }
    fixed = spark.createDataFrame([(f"{k}.md", f"---\nid: {k}\n{v}\n---\n") for k, v in heads.items()], "path string, text string")
    people = count - len(heads)
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    start = h("start", 900)
    lines = F.concat_ws(
        "\n",
        F.transform(
            F.sequence(F.lit(1), h("links", 3) + 1),
            lambda k: F.concat(F.lit("@link{weight="), (k / 10).cast("string"), F.lit("}[friend](n"), F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(people)).cast("string"), F.lit(" knows)")),
        ),
    )
    text = F.concat(
        F.lit("---\nid: n"), F.col("id").cast("string"), F.lit("\ntype: "), F.when(h("type", 5) == 0, "Place").otherwise("Person"),
        F.lit("\nvalidTime: [{timeline: Story, from: "), start.cast("string"), F.lit(", to: "), (start + h("length", 300)).cast("string"),
        F.lit("}]\nprops: {name: name"), F.col("id").cast("string"), F.lit(", age: "), h("age", 90).cast("string"), F.lit("}\n---\n# Node "), F.col("id").cast("string"), F.lit("\n\n"), lines, F.lit("\n"),
    )
    return fixed.unionByName(spark.range(people).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("path"), text.alias("text")))
