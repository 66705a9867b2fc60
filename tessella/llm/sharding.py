"""Proportional stratified interleaving.

Rows of each source are ranked by a seeded hash; the fractional rank (2 * rank + 1) / (2 * rows of the source) puts
every source evenly over [0, 1); the order by fractional rank, cut at equal row counts, gives shards that all match the
mixture. The law is `rows`: shard sizes are at most one row apart.

Both rankings are exact and need no window over a whole source or table: rows are numbered within narrow ranges of the
ranking key, whose counts, summed up over the ranges before, give the offset. Ranges follow the hash, so a hot source
is cut into as many ranges as its rows need and equal texts (which have different ids) spread too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import materialise, shared_folder, table

_BITS = 40  #: of the ranking keys; rows that tie there are told apart by the full hash and the id


def _numbered(df: DataFrame, group: list[str], part: str, order: list, out: str) -> DataFrame:
    """out: the row's place (from 0) in its group, ordered by part and then order; _of: the group's rows."""
    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*group)
    before = whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_of"))
    within = F.row_number().over(W.partitionBy(*group, part).orderBy(*order))
    return df.join(offsets, [*group, part]).withColumn(out, F.col("_before") + within - 1).drop("_before", part)


def interleave(rows: DataFrame, key: str, source: str, shards: int = 16, seed: int = 17, range_rows: int | None = None) -> DataFrame:
    """All rows with `shard` (0 to shards - 1), `slot` (0 upwards within the shard) and `position` (in the whole order).

    Null sources are a source of their own; null and repeated keys are told apart by the rest of the row, so the
    result is one assignment of every row; rows that are equal throughout take any order. An empty table stays empty.
    Columns named shard, slot or position are replaced, as withColumn would; range_rows is about how many rows share a ranking range (the
    root of their number if not given, so that neither the ranges nor what each holds grow fast); it changes the plan
    but never the result.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot", "position")]
    packed = rows.select(F.struct(*names).alias("_all"), F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"))
    total = packed.count()
    if total == 0:
        return rows.select(*names).selectExpr("*", "CAST(NULL AS INT) AS shard", "CAST(NULL AS BIGINT) AS slot", "CAST(NULL AS BIGINT) AS position")
    ranges = max(16, math.ceil(total / (range_rows or max(256, math.isqrt(total)))))
    # the whole row counts, so that rows of one key, or without one, spread over the ranges too
    hashed = packed.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("")),
            "_h": F.xxhash64(F.lit(seed), F.col("_key"), F.col("_all")),
            "_tie": F.xxhash64(F.lit(seed + 1), F.col("_all")),
        }
    )
    unit = F.shiftrightunsigned("_h", 64 - _BITS)
    part = F.floor(unit.cast("double") / F.lit(2.0**_BITS) * ranges).cast("long")
    ranked = _numbered(hashed.withColumn("_part", part), ["_source"], "_part", ["_h", "_key", "_tie"], "_rank")
    ranked = ranked.withColumn("_frac", (2 * F.col("_rank") + 1) / (2 * F.col("_of"))).drop("_of")
    placed = _numbered(
        ranked.withColumn("_part", F.floor(F.col("_frac") * F.lit(ranges)).cast("long")).withColumn("_whole", F.lit(0)),
        ["_whole"], "_part", ["_frac", "_source", "_h", "_key", "_tie"], "_position",
    )
    share, more = divmod(total, shards)
    long_end = (share + 1) * more  # the first `more` shards hold one row more
    p = F.col("_position")
    if share == 0:
        shard = p
        start = p
    else:
        shard = F.when(p < long_end, F.floor(p / (share + 1))).otherwise(more + F.floor((p - long_end) / share))
        start = F.when(p < long_end, F.floor(p / (share + 1)) * (share + 1)).otherwise(long_end + F.floor((p - long_end) / share) * share)
    return placed.select("_all.*", shard.cast("int").alias("shard"), (p - start).cast("long").alias("slot"), p.cast("long").alias("position"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes each shard as its own folder of Parquet files, rows in slot order within a file."""
    n = assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = assigned.withColumn("_block", F.floor(F.col("slot") / 100_000))
    spread.repartition(int(n), "shard", "_block").sortWithinPartitions("shard", "slot").drop("_block").write.partitionBy("shard").parquet(path)


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
    )
    # the texts are read once; ranking passes over these narrow rows
    narrow = materialise(docs, shared_folder(spark), "narrow")
    return interleave(narrow, "doc_id", "source").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
