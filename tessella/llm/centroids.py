"""Centroid clustering (k-means) over integer vectors, exact in every assignment.

* A vector's squared distances to the centroids differ only in |c|^2 - 2 x.c. One float32 matrix product gives these for a
  whole batch, and the error of each is bounded before it is known: a float32 sum of 64 products differs from the true one
  by at most gamma * |x| |c| whatever the order of summation, gamma = d u / (1 - d u), u = 2^-24. So every centroid has an
  interval that surely holds its true value; only those whose interval reaches below the least upper end can be nearest.
* Where that leaves one, it is the nearest. Where intervals overlap, the distances of the shortlisted centroids are
  computed in 64-bit integers, and the smallest number wins a tie.
* Components so long (2^27 for 64 of them) that squares would leave 64 bits are told apart: such vectors,
  and all vectors while a centroid is that long, are compared in Python's integers. No input makes the result approximate.
* A round is one map over the source, whose tasks send a row for each cluster, component and 40-bit limb of their sums;
  the driver sees as many rows as the centroids have numbers. Nothing is cached and only the last assignment is written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, materialise, shared_folder, slices, table

_LIMB = 40
_MOST = (1 << 63) - 1


def wide_from(dims: int) -> int:
    """From here on a component's squared differences could sum to more than 63 bits: 2^27 for 64 components."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64 where all are narrow, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    if not scaled.size or np.abs(scaled).max() < wide_from(x.shape[1]):
        return scaled.astype(np.int64)
    exact = lambda v: math.floor(v * scale) if abs(v) < 2.0**60 else int(v) * scale
    return np.array([[exact(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def kept_vectors(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """vec_id of the kept rows, and their integers in two parts (narrow ones, wide ones) with the rows' order."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(whole)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(whole), dims)
    fine = np.isfinite(x).all(axis=1)
    x, whole = x[fine], whole[fine]
    with np.errstate(over="ignore"):
        wide = (np.abs(x) * scale >= wide_from(dims) - 1).any(axis=1)
    order = np.concatenate((np.flatnonzero(~wide), np.flatnonzero(wide)))
    return ids.take(pa.array(whole[order])), [integers(x[~wide], scale), integers(x[wide], scale)], whole[order]


class Centroids:
    """Centroids with what the screening needs to know of them."""

    def __init__(self, rows: list[tuple[int, ...]]):
        self.rows = rows
        self.wide = any(abs(v) >= wide_from(len(row)) for row in rows for v in row)
        if not self.wide:
            self.exact = np.array(rows, np.int64)
            self.single = self.exact.astype(np.float32)
            self.square = (self.exact**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance to it."""
        if x.dtype == object or self.wide:
            return self._nearest_wide(x)
        dims, u = x.shape[1], 2.0**-24
        low, high = self.intervals(x, dims * u / (1 - dims * u), u)
        likely = low <= high.min(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        open_rows = np.flatnonzero(likely.sum(axis=1) > 1)
        if len(open_rows):
            row, number = np.nonzero(likely[open_rows])
            distance = ((x[open_rows[row]] - self.exact[number]) ** 2).sum(axis=1)
            order = np.lexsort((number, distance, row))
            first = order[np.concatenate(([True], np.diff(row[order]) != 0))]
            best[open_rows] = number[first]
        return best, ((x - self.exact[best]) ** 2).sum(axis=1)

    def intervals(self, x: np.ndarray, gamma: float, u: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|^2 - 2 x.c for each vector and centroid.

        Integers from 2^24 on are rounded themselves, by u in each factor; the sums beside the product are in float64,
        whose own roundings (2^-53 each) are covered by a thousandth more and by 2^-40 of the terms.
        """
        dot = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(self.square.astype(np.float64))[None, :]
        value = self.square[None, :] - 2 * dot
        off = 1.001 * 2 * (gamma + 2 * u + u * u) * (1 + 2 * u) ** 2 * lengths + 2.0**-40 * (self.square[None, :] + 2 * lengths)
        return value - off, value + off

    def _nearest_wide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, away = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        for i, row in enumerate(x.tolist()):
            away[i], best[i] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(self.rows))
        return best, away


def _vectors(table: DataFrame) -> DataFrame:
    return table.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "embedding")


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int) -> list[tuple[int, ...]]:
    """The k kept vectors with the least sha256 of `1:<vec_id>`, the components deciding between rows of one id.

    Each row is tested by columns alone, and only k rows leave Spark.
    """
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    hashed = vectors.where(fine & F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), F.col("embedding").cast("array<double>").alias("e"))
    rows = hashed.orderBy("h", "e").limit(k).collect()
    return [tuple(int(v) for v in integers(np.array([r["e"]], float), scale)[0]) for r in rows]


def _moved(vectors: DataFrame, old: Centroids, dims: int, scale: int) -> list[tuple[int, ...]]:
    """The centroids after one round: floor(sum / count) of each one's vectors; without any, as before."""
    sent = vectors.sparkSession.sparkContext.broadcast(old)
    k = len(old.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in slices(batches):
            for x in kept_vectors(batch, dims, scale)[1]:
                if not len(x):
                    continue
                best, _ = sent.value.nearest(x)
                for j in np.unique(best):
                    own = x[best == j]
                    count[j] += len(own)
                    sums[j] += own.sum(axis=0).astype(object)
        rows = [(int(j), -1, 0, int(count[j])) for j in np.flatnonzero(count)]
        for j in np.flatnonzero(count):
            for i, v in enumerate(sums[j]):
                rest, limb, sign = abs(int(v)), 0, -1 if v < 0 else 1
                while rest:
                    rows.append((int(j), i, limb, sign * (rest & ((1 << _LIMB) - 1))))
                    rest, limb = rest >> _LIMB, limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["cluster", "component", "limb", "value"])

    parts = arrow_map(vectors, run, "cluster long, component long, limb long, value long").groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value"))
    count, sums = [0] * k, [[0] * dims for _ in range(k)]
    for r in parts.collect():
        if r["component"] < 0:
            count[r["cluster"]] = r["value"]
        else:
            sums[r["cluster"]][r["component"]] += r["value"] << (_LIMB * r["limb"])
    sent.destroy()
    return [tuple(s // count[j] for s in sums[j]) if count[j] else old.rows[j] for j in range(k)]


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, folder: str | None = None) -> DataFrame:
    """For each kept row of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dims components, none null or non-finite; others have no row. Rows without a vec_id are
    assigned but start no centroid. Repeated rows count each; with fewer than k vectors there are as many centroids as
    vectors, an empty table gives an empty result. Distances and their sums beyond 63 bits are given as 2^63 - 1; what is
    nearest is exact beyond that too. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = _vectors(rows)
    schema = "vec_id long, cluster int, distance long"
    start = first_centroids(vectors, k, dims, scale)
    if not start:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    now = Centroids(start)
    for _ in range(rounds):
        now = Centroids(_moved(vectors, now, dims, scale))
    sent = spark.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, parts, _ = kept_vectors(batch, dims, scale)
            if len(ids):
                best, away = (np.concatenate(c) for c in zip(*(sent.value.nearest(x) for x in parts if len(x)), strict=True))
                away = np.array([min(int(v), _MOST) for v in away], np.int64) if away.dtype == object else away
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    assigned = materialise(arrow_map(vectors, run, schema), folder or shared_folder(spark), "assigned")
    whole = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(whole.alias("d")).collect()}
    total = min(sum(inertia.values()), _MOST)
    facts = [(j, inertia.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(now.rows)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_interval_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
