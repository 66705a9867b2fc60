"""Substring dedup by super-k-mers.

A window is `size` consecutive words of one document. The minimiser of a window is the least hash among its m-word
grams; consecutive windows share it until a lesser one enters or it leaves, and such a run of windows (a super-k-mer) is
one string of words. Equal windows have equal minimisers, so a bucket for each minimiser sees every copy of its windows.

1. Each document sends (minimiser, id), without text. Only minimisers met in two ids can hold a repeat.
2. The runs of these minimisers travel as packed strings to their buckets: first equal strings become one with their least
   id, then the windows of a bucket are sorted, and in each group of equal ones the least id is the first.
   A minimiser with more distinct strings than `heavy` (a passage within very many contexts) has them cut into single
   windows, grouped by their whole content, where aggregation alone finds the least id: no task holds an unbounded group.
3. The runs' windows that start in a lesser id too go back to their documents as word ranges, and the kept words remain.

Windows are compared word for word; hashes route, and 128 bits name the strings that a bucket's answer goes back to. Bloom filters of fixed size keep texts without a shared
minimiser, and those that lose nothing, out of the exchanges; full ones would let all through. What is read again is
written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WORD, WordHasher, arrow_map, bloom, bloom_hits, delete_folder, filter_batches, map_batches, materialise, mix64, shared_folder, signed, slices, table

GRAM = 8  #: words of a minimiser's gram


def minimiser_runs(hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows that share a minimiser at one place.

    hashes: of the words. Ties go to the leftmost gram, so equal windows choose alike.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = hashes[: len(hashes) - gram + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, gram):
            g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - gram + 1 + i]
        g = mix64(g)
    width = size - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.empty(n, np.int64)
    for a in range(0, n, 4096):  # argmin takes the first of equal ones; blocks bound the memory of long texts
        at[a : a + 4096] = view[a : a + 4096].argmin(axis=1)
    at += np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at[first]], first, np.diff(np.append(first, n))


def _minimisers(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(doc_id, mini) for each minimiser of each row of docs (doc_id, row, text)."""
    hasher = WordHasher(seed=6)

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_numpy()
        hashes, at = hasher.column(batch.column(1))
        minis, which = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k in np.flatnonzero(np.diff(at) >= size).tolist():
            minis.append(np.unique(minimiser_runs(hashes[at[k] : at[k + 1]], size, gram)[0]))
            which.append(np.full(len(minis[-1]), k))
        return {"doc_id": pa.array(ids[np.concatenate(which)]), "mini": pa.array(signed(np.concatenate(minis)))}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, mini long")


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, row, text) that may have one of the ids: other texts are held back before an exchange."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids))
    return filter_batches(docs.select("doc_id", "row", "text"), lambda batch: bloom_hits(sent.value, batch.column(0).to_numpy()))


def _offsets(packed: str) -> list[int]:
    """Where each word of a string packed with single blanks begins, and one past the end of the last with its blank."""
    out, at = [0], packed.find(" ")
    while at >= 0:
        out.append(at + 1)
        at = packed.find(" ", at + 1)
    out.append(len(packed) + 1)
    return out


def _windows(packed: str, size: int) -> list[str]:
    off = _offsets(packed)
    return [packed[off[i] : off[i + size] - 1] for i in range(len(off) - size)]


def _flush(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _pack(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """Packed strings (doc_id, row, mini, first, packed) of the runs of each text whose minimiser is wanted."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("mini", pa.int64()), ("first", pa.int32()), ("packed", pa.string())])
    hasher = WordHasher(seed=6)

    def run(batches):
        for batch in slices(batches, rows=500):
            held, out = 0, []
            hashes, at = hasher.column(batch.column(2))
            for k, (doc_id, row, text, wanted) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                ws = WORD.findall(text)
                minis, first, windows = minimiser_runs(hashes[at[k] : at[k + 1]], size, gram)
                for i in np.flatnonzero(np.isin(signed(minis), np.array(wanted, np.int64))).tolist():
                    a = int(first[i])
                    out.append((doc_id, row, int(signed(minis[i : i + 1])[0]), a, " ".join(ws[a : a + int(windows[i]) + size - 1])))
                    held += len(out[-1][4])
                    if held > 4_000_000:
                        yield _flush(out, schema)
                        held, out = 0, []
            if out:
                yield _flush(out, schema)

    return arrow_map(texts, run, "doc_id long, row long, mini long, first int, packed string")


_STRING = [("mini", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]


def _single(strings: DataFrame, size: int) -> DataFrame:
    """(mini, s1, s2, own, at, window) for each window of each string."""
    schema = pa.schema([*_STRING, ("own", pa.int64()), ("at", pa.int32()), ("window", pa.string())])

    def run(batches):
        for batch in slices(batches, rows=200):
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            out = [(m, a, b, own, i, w) for m, a, b, p, own in rows for i, w in enumerate(_windows(p, size))]
            if out:
                yield _flush(out, schema)

    return arrow_map(strings, run, "mini long, s1 long, s2 long, own long, at int, window string")


def _first_ids(strings: DataFrame, size: int) -> DataFrame:
    """(mini, s1, s2, least: array<long>): for each distinct string the least id in which each of its windows starts.

    strings: (mini, s1, s2, packed, least id of this string), partitioned and sorted by mini, light minimisers only.
    """
    schema = pa.schema([*_STRING, ("least", pa.list_(pa.int64()))])

    def bucket(rows: list[tuple]) -> list[tuple]:
        windows = sorted((w, i, k, r[4]) for k, r in enumerate(rows) for i, w in enumerate(_windows(r[3], size)))
        found: list[dict[int, int]] = [{} for _ in rows]
        a = 0
        while a < len(windows):
            b, least = a, windows[a][3]
            while b < len(windows) and windows[b][0] == windows[a][0]:
                least = min(least, windows[b][3])
                b += 1
            for _, i, k, _ in windows[a:b]:
                found[k][i] = least
            a = b
        return [(*r[:3], [x[i] for i in range(len(x))]) for r, x in zip(rows, found, strict=True)]

    def run(batches):
        rows: list[tuple] = []
        out: list[tuple] = []
        for batch in slices(batches):
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and r[0] != rows[0][0]:
                    out += bucket(rows)
                    rows = []
                rows.append(r)
                if len(out) >= 5000:
                    yield _flush(out, schema)
                    out = []
        out += bucket(rows)
        if out:
            yield _flush(out, schema)

    return arrow_map(strings, run, "mini long, s1 long, s2 long, least array<long>")


def repeats(docs: DataFrame, folder: str, size: int = 50, gram: int = GRAM, heavy: int = 2000) -> DataFrame:
    """(doc_id, row, at): the places of the windows of docs (doc_id, row, text) that start in a lesser doc_id too."""
    minis = materialise(_minimisers(docs, size, gram), folder, "minimisers")
    shared = minis.groupBy("mini").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("mini")
    shared = materialise(shared, folder, "shared")  # as a table, so that a join with it can split a hot minimiser
    wanted = minis.join(shared, "mini").groupBy("doc_id").agg(F.collect_set("mini").alias("wanted"))
    wanted = materialise(wanted, folder, "wanted")
    delete_folder(docs.sparkSession, f"{folder}/minimisers")
    texts = _holding(docs, wanted.select("doc_id")).join(wanted, "doc_id")
    packed = materialise(_pack(texts.select("doc_id", "row", "text", "wanted"), size, gram), folder, "packed")

    name = {"s1": F.xxhash64("packed"), "s2": F.xxhash64(F.lit(1), F.length("packed"), "packed")}
    key = ["mini", "s1", "s2"]
    strings = materialise(packed.groupBy("mini", "packed").agg(F.min("doc_id").alias("own")).withColumns(name), folder, "strings")
    places = materialise(packed.withColumns(name).select("doc_id", "row", "first", *key), folder, "places")
    delete_folder(docs.sparkSession, f"{folder}/packed")
    crowded = materialise(strings.groupBy("mini").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select("mini"), folder, "crowded")
    light = strings.join(crowded, "mini", "left_anti").select(*key, "packed", "own")
    least = _first_ids(light.repartition("mini").sortWithinPartitions("mini"), size)

    single = materialise(_single(strings.join(crowded, "mini", "left_semi").select(*key, "packed", "own"), size), folder, "single")
    first = materialise(single.groupBy("window").agg(F.min("own").alias("least")), folder, "first")
    rows = single.join(first, "window").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("x"))
    least = materialise(least.unionByName(rows.select(*key, F.col("x.least").alias("least"))), folder, "least")

    back = places.join(least, key)
    hits = F.expr("transform(filter(sequence(0, size(least) - 1), i -> least[i] < doc_id), i -> i + first)")
    found = back.select("doc_id", "row", hits.alias("at")).where("size(at) > 0")
    return found.groupBy("doc_id", "row").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))


def cut_words(ws: list[str], starts: list[int], size: int) -> list[str]:
    """The words that no window starting at one of `starts` (ascending) covers."""
    out, at = [], 0
    for s in starts:
        if s > at:
            out += ws[at:s]
        at = max(at, s + size)
    return out + ws[at:]


def dedup(docs: DataFrame, size: int = 50, folder: str | None = None, digests: bool = False, heavy: int = 2000) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed and the kept words (`kept_text`, or its SHA-256).

    A word goes if a window of `size` words that covers it also starts in a row with a smaller doc_id. Rows of one
    doc_id are the same document: neither is before the other. Null and empty texts have no words; rows with a null
    doc_id are before and after none, so they stay whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    hits = materialise(repeats(rows.where("doc_id IS NOT NULL"), folder, size, heavy=heavy), folder, "hits")
    for name in ("shared", "wanted", "strings", "places", "crowded", "single", "first", "least"):
        delete_folder(spark, f"{folder}/{name}")
    name = "kept_sha256" if digests else "kept_text"
    sent = spark.sparkContext.broadcast(bloom(hits.select("row")))

    def cut(batch: pa.RecordBatch, starts: list) -> dict:
        n, removed, kept = [], [], []
        for text, at in zip(batch.column(2).to_pylist(), starts, strict=True):
            ws = WORD.findall(text)
            left = cut_words(ws, sorted(set(at)), size) if at else ws
            n.append(len(ws))
            removed.append(len(ws) - len(left))
            whole = " ".join(left)
            kept.append(hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest() if digests else whole)
        return {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), name: pa.array(kept, pa.string())}

    def whole(batch: pa.RecordBatch) -> dict:  # rows that surely lose nothing stay where they are
        batch = batch.filter(pa.array(~bloom_hits(sent.value, batch.column(1).to_numpy())))
        return cut(batch, [None] * batch.num_rows)

    schema = f"doc_id long, n_words long, n_removed long, {name} string"
    rows = rows.select("doc_id", "row", "text")
    joined = filter_batches(rows, lambda batch: bloom_hits(sent.value, batch.column(1).to_numpy())).join(hits, ["doc_id", "row"], "left")
    changed = map_batches(joined.select("doc_id", "row", "text", "at"), lambda batch: cut(batch, batch.column(3).to_pylist()), schema)
    return map_batches(rows, whole, schema).unionByName(changed)


def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digests=True)
