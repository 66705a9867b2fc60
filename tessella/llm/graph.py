"""Connected components of a table of links, without any vertex's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _with_least(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """edges with the least neighbour of u; as a table, so that the join can split a hot u."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), folder, name)
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def components(links: DataFrame, folder: str, name: str, most: int = 60) -> DataFrame:
    """(id, component) of every end of links (a, b): component is the least id that can be reached.

    Large-star and small-star steps in turn (about log^2 of the longest path); each result is written to the shared
    folder, so lineage stays short. Null ends and loops add nothing; an empty table gives an empty result.
    """
    cur = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialise(cur, folder, f"{name}-0")
    state = _state(cur)
    for i in range(1, most + 1):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, folder, f"{name}-{i}a").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), folder, f"{name}-{i}b")
        small = _with_least(large, folder, f"{name}-{i}c")  # here u > v throughout: the neighbours of u that are less than it
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        cur = materialise(tied.where("u <> v").distinct(), folder, f"{name}-{i}")
        new = _state(cur)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
