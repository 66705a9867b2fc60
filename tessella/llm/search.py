"""Ranked lexical search over document-sharded postings.

* Tasks cut the documents into shards of bounded size. A shard is one row: its distinct terms and, in compressed sparse
  rows (CSR), each term's documents with their integer impacts. An impact is all of the score that depends on the
  document (tf and length); what depends on the term's frequency in the corpus is a weight that a query brings along. So
  an index serves any queries, and no part of it grows with the corpus.
* A query's document frequencies are sums of row lengths over all shards. Each shard is then scored for itself, a term at
  a time, in one dense array of 64-bit sums; argpartition finds the k-th score, all documents above it are taken and,
  of those that reach it, the ones with the least ids. A task keeps k documents an item over all its shards; what tasks
  keep is merged in groups of tasks and then as a whole, so no step reads more than a bounded number of rows a group.
* Items come in blocks of bounded size, so driver and workers hold one block at a time however long the benchmark is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, materialise, shared_folder, slices, table

#: Every byte of a term is itself or its lower-case letter, every other byte a blank; beyond ASCII all belongs to terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max

#: A row of the index takes some 15 MB. Parquet's writer holds 100 rows before it looks at their size, and its reader makes one
#: batch of a row group, so both would hold all shards of a task at once: a row group is one row.
_WRITTEN = {"parquet.block.row.count.limit": "1"}

_INDEX = "shard long, n_docs int, terms array<string>, starts binary, docs binary, impacts binary, ids array<bigint>"


def terms(text: str | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, in UTF-8, in lists of about a megabyte of text; null has none."""
    if not text:
        return
    data = text.encode().translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        cut = len(data) if at + piece >= len(data) else data.find(b" ", at + piece)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def _counted(text: str | None) -> Counter:
    out: Counter = Counter()
    for part in terms(text):
        out.update(part)
    return out


def corpus_totals(docs: DataFrame) -> tuple[int, int]:
    """N (documents with a term) and L (all terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = sum(map(len, terms(text)))
                n += own > 0
                length += own
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "length": pa.array([length], pa.int64())})

    row = arrow_map(docs.selectExpr("CAST(text AS STRING) AS text"), run, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return row[0] or 0, row[1] or 0


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _Shard:
    """Postings under construction: for each document its terms' numbers and impacts, turned into CSR at the end."""

    def __init__(self, n: int, length: int):
        self.n, self.length = n, length
        self.words: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.term, self.impact, self.sizes = [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        total = sum(counts.values())
        m = 50 + 50 * total * self.n // self.length
        number = self.words
        self.term.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.impact.append((1_000_000_000 * tf // (1000 * tf + 20 * m)).astype(np.int32))
        self.sizes.append(len(counts))
        self.ids.append(doc_id)
        self.postings += len(counts)

    def row(self, shard: int) -> pa.RecordBatch:
        term = np.concatenate(self.term)
        order = np.argsort(term, kind="stable")
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)[order]
        starts = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bincount(term, minlength=len(self.words)), out=starts[1:])
        names = pa.array(self.words, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(self.ids)], pa.int32()),
            "terms": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
            "starts": [starts.tobytes()], "docs": [docs.tobytes()], "impacts": [np.concatenate(self.impact)[order].tobytes()],
            "ids": pa.array([self.ids], pa.list_(pa.int64())),
        })


def build_index(docs: DataFrame, totals: tuple[int, int], folder: str, name: str = "index", postings: int = 1_000_000, most_docs: int = 16_384) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder: a row a shard. No shuffle.

    A shard is closed at about `postings` postings or at most_docs documents. Every row with a term is indexed; null
    texts and texts without terms have no postings. Repeated rows are documents of their own; other columns are ignored.
    """
    n, length = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        shard, made = _Shard(n, length), 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _counted(text)
                if not counts:
                    continue
                shard.add(doc_id, counts)
                if shard.postings >= postings or len(shard.ids) >= most_docs:
                    row = shard.row(part + made)
                    shard, made = _Shard(n, length), made + 1
                    yield row
                    del row
        if shard.ids:
            yield shard.row(part + made)

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return materialise(arrow_map(rows, run, _INDEX), folder, name, **_WRITTEN)


def item_blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """(item_id, its distinct terms) in blocks of about most_terms; rows of one item_id are one item, items without a term go."""
    rows = items.selectExpr("CAST(item_id AS BIGINT) AS item_id", "CAST(text AS STRING) AS text").distinct().orderBy(F.col("item_id").asc_nulls_last(), "text")
    block: list[tuple[int | None, list[str]]] = []
    held, item, own = 0, None, None
    for row in rows.toLocalIterator():
        if own is None or row["item_id"] != item:
            if own:
                block.append((item, sorted(own)))
                held += len(own)
                if held >= most_terms:
                    yield block
                    block, held = [], 0
            item, own = row["item_id"], set()
        own.update(t.decode() for part in terms(row["text"]) for t in part)
    if own:
        block.append((item, sorted(own)))
    if block:
        yield block


def _frequencies(index: DataFrame, names: list[str]) -> dict[str, int]:
    """The number of documents that hold each name; a number for each of a block's terms reaches the driver."""
    sent = index.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(sent.value, pa.string()), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, found = _places(wanted, batch.column(0)[i].values)
                total[found] += np.diff(np.frombuffer(batch.column(1)[i].as_py(), np.int64))[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = arrow_map(index.select("terms", "starts"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    sent.destroy()
    return {names[r["term"]]: r["df"] for r in rows}


def _places(wanted: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For the wanted terms that a shard holds: their rows in it, and their places among the wanted."""
    at = pc.index_in(wanted, value_set=held)
    there = at.is_valid().to_numpy(zero_copy_only=False)
    return at.drop_null().to_numpy(), np.flatnonzero(there)


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, ties by the least id; in no order."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    own = scores[some]
    least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    above, level = some[own > least], some[own == least]
    need = k - len(above)
    if need < len(level):
        level = level[np.argpartition(ids[level], need - 1)[:need]]
    return np.concatenate((above, level))


def _score(index: DataFrame, block: list, k: int) -> DataFrame:
    """(item, doc_id, score, task): the k best of each task's shards for each item of the block."""
    names = sorted({t for _, own in block for t in own})
    n_docs = int(index.agg(F.sum("n_docs")).first()[0] or 0)
    df = _frequencies(index, names)
    number = {t: i for i, t in enumerate(names)}
    queries = [[(number[t], weight(n_docs, df[t])) for t in own if t in df] for _, own in block]
    sent = index.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        wanted = pa.array(names, pa.string())
        best: list = [None] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                at, found = _places(wanted, batch.column(0)[i].values)
                row_of = dict(zip(found.tolist(), at.tolist(), strict=True))
                starts, docs, impacts = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.int64), (2, np.int32), (3, np.int32)))
                held = batch.column(4)[i].values
                ids = held.fill_null(_LAST).to_numpy(zero_copy_only=False)
                total = np.zeros(len(ids), np.int64)
                for q, query in enumerate(queries):
                    total[:] = 0
                    for t, w in query:
                        row = row_of.get(t)
                        if row is not None:
                            a, b = starts[row], starts[row + 1]
                            total[docs[a:b]] += w * impacts[a:b].astype(np.int64)
                    top = top_k(total, ids, k)
                    if not len(top):
                        continue
                    new = (total[top], ids[top], ~held.is_valid().to_numpy(zero_copy_only=False)[top])
                    if best[q] is not None:
                        new = tuple(np.concatenate(x) for x in zip(best[q], new, strict=True))
                        keep = top_k(new[0], new[1], k)
                        new = tuple(x[keep] for x in new)
                    best[q] = new
        task = TaskContext.get().partitionId()
        for q, own in enumerate(best):
            if own is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own[0]), q)), pa.array(own[1], mask=own[2]), pa.array(own[0]), pa.array(np.full(len(own[0]), task))],
                    names=["item", "doc_id", "score", "task"],
                )

    return arrow_map(index.select("terms", "starts", "docs", "impacts", "ids"), run, "item long, doc_id long, score long, task long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, folder: str | None = None, most_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0, ties by doc_id.

    Null texts have no terms: such items get no rows, such documents are not among the N of the corpus. Rows of one
    item_id (also of a null one) are one item with the terms of all its texts. Repeated documents are ranked each for
    itself; those with a null doc_id come after others of their score. Other columns are ignored; an empty table of
    documents or items gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    totals = corpus_totals(docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not totals[0]:
        return out
    index = build_index(docs, totals, folder)
    best, order = None, [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for i, block in enumerate(item_blocks(items, most_terms)):
        scored = _score(index, block, k).withColumn("part", F.expr("task DIV 64"))
        first = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
        merged = scored.withColumn("rank", first).where(F.col("rank") <= k)
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "item long, item_id long")
        one = materialise(merged.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), folder, f"best-{i}")
        best = one if best is None else best.unionByName(one)
    return out if best is None else best


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
