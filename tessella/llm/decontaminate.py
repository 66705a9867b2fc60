"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (A-Z lower-cased, white space to one blank). A test item of m code points may lie in a document with
up to e = floor(errors * m) edits. Cut into e + 1 pieces, at least one piece then lies there unchanged: an Aho-Corasick
automaton over all pieces finds every such place in one pass, and Myers' bit-parallel distance, with a whole item in one
integer, decides within the window around it. Exact: no item within its budget is missed, none beyond it is reported.

The test items are the stated query set. They are read to the driver in blocks of at most `block_chars` code points (a
bounded broadcast), one at a time, and each block makes one pass over the documents, so neither the items' number nor the
documents' matters to memory. No shuffle of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import WORD, arrow_map, filter_batches, lower_ascii, materialise, shared_folder, slices, table


def normalise(text: str | None) -> str:
    return " ".join(WORD.findall(lower_ascii(text))) if text else ""


def budget(m: int, errors: float) -> int:
    return int(m * errors)


def pieces(item: str, errors: float) -> list[tuple[int, str]]:
    """The item cut into budget + 1 parts of near equal length, with their places."""
    m = len(item)
    k = budget(m, errors) + 1
    cuts = [m * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Myers:
    """Approximate search for one pattern; Python's integers hold the whole bit vectors."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the pattern to any substring of text, and the first place at which such a one ends."""
        m, peq = self.m, self.peq
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(text):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end


class Matcher:
    """All items of a block against one text at a time."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.items, self.myers = items, {}
        self.budgets = [budget(len(t), errors) for _, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for at, piece in pieces(text, errors):
                places.setdefault(piece, []).append((k, at))
        for piece, owners in places.items():
            self.auto.add_word(piece, (len(piece), owners))
        self.any = bool(places)
        if self.any:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, least distance, end of the first best match in the normalised text) of each item within its budget."""
        if not self.any:
            return []
        spans: dict[int, list[list[int]]] = {}
        for stop, (length, owners) in self.auto.iter(text):
            for k, at in owners:
                e = self.budgets[k]
                begin = max(0, stop + 1 - length - at - e)
                end = min(len(text), stop + 1 - length - at + len(self.items[k][1]) + e)
                got = spans.setdefault(k, [])
                if got and begin <= got[-1][1] and got[-1][0] <= end:  # overlapping windows become one
                    got[-1][0], got[-1][1] = min(begin, got[-1][0]), max(end, got[-1][1])
                else:
                    got.append([begin, end])
        out = []
        for k, windows in spans.items():
            item_id, item = self.items[k]
            best, where = self.budgets[k] + 1, -1
            for a, b in windows:
                exact = text.find(item, a, b)
                if exact >= 0:
                    d, end = 0, exact - a + len(item)
                else:
                    if k not in self.myers:
                        self.myers[k] = Myers(item)
                    d, end = self.myers[k].best(text[a:b])
                if (d, a + end) < (best, where) or where < 0 and d < best:
                    best, where = d, a + end
            if best <= self.budgets[k]:
                out.append((item_id, best, where))
        return sorted(out)


@functools.lru_cache(maxsize=1)
def _worker_matcher(items: tuple[tuple[int, str], ...], errors: float) -> Matcher:
    return Matcher(list(items), errors)


def blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The normalised items (item_id, text), repeated ones once, in blocks for the driver; items without words go."""
    block, held = [], 0
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        if not text or row["item_id"] is None:
            continue
        if block and held + len(text) > block_chars:
            yield tuple(block)
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield tuple(block)


_FOUND = "doc_id long, item_id long, distance int, item_chars int, end_char long"


def _block_matches(docs: DataFrame, sent, errors: float) -> DataFrame:
    def run(batches):
        matcher = _worker_matcher(sent.value, errors)
        lengths = {i: len(t) for i, t in sent.value}
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(doc_id, i, d, lengths[i], end) for i, d, end in matcher.find(normalise(text))]
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "distance", "item_chars", "end_char"])

    return arrow_map(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"), run, _FOUND)


def matches(docs: DataFrame, items: DataFrame, errors: float = 0.06, block_chars: int = 4_000_000, folder: str | None = None) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, end_char): each document and item with a match within the item's budget.

    end_char: where the first best match ends, in code points of the normalised text. Null and empty texts, items
    without words and items without an id match nothing; an empty item table gives an empty result. Repeated
    documents give repeated rows; other columns are ignored. Of several blocks each is matched and written to the shared
    folder before the next is read, so that driver and workers hold one at a time.
    """
    spark = docs.sparkSession
    found, sent, every = None, None, blocks(items, block_chars)
    for i, block in enumerate(every):
        if sent is not None:  # there is a block before this one: write what it finds, and let it go
            folder = folder or shared_folder(spark)
            one = materialise(_block_matches(docs, sent, errors), folder, f"matches-{i}")
            found = one if found is None else found.unionByName(one)
            sent.destroy()
        sent = spark.sparkContext.broadcast(block)
    if sent is None:
        return spark.createDataFrame([], _FOUND)
    last = _block_matches(docs, sent, errors)
    return last if found is None else found.unionByName(last)


def drop_contaminated(docs: DataFrame, items: DataFrame, errors: float = 0.06, block_chars: int = 4_000_000, folder: str | None = None) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows with null or empty texts stay.

    One pass a block; after each but the last, what is left is written to the shared folder.
    """
    spark = docs.sparkSession

    def without(docs: DataFrame, sent) -> DataFrame:
        def clean(batch: pa.RecordBatch) -> list[bool]:
            matcher = _worker_matcher(sent.value, errors)
            return [not t or not matcher.find(normalise(t)) for t in batch.column("text").to_pylist()]

        return filter_batches(docs, clean)

    sent = None
    for i, block in enumerate(blocks(items, block_chars)):
        if sent is not None:
            folder = folder or shared_folder(spark)
            docs = materialise(without(docs, sent), folder, f"clean-{i}")
            sent.destroy()
        sent = spark.sparkContext.broadcast(block)
    return docs if sent is None else without(docs, sent)


def op10_pigeonhole_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
