"""Quality rules by compression bands.

zstandard ratios (bytes / compressed bytes) of the whole text and of its fixed chunks are held against limits for
their length: text that shrinks too much repeats itself, text that hardly shrinks is noise. One narrow map over the
texts: no shuffle, memory bounded by an Arrow batch and the longest text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import WORD, filter_batches, map_batches, table


@dataclass(frozen=True)
class Bands:
    """Limits on the ratio by length in bytes: lengths from `lengths[i]` take `low[i]` and `high[i]`.

    chunk: bytes of a chunk. most_bad: the share of bytes that may lie in chunks outside their limits. most_run: how many
    such chunks may follow one another, however long the text.
    """

    lengths: tuple[int, ...] = (0, 256, 512, 1024, 2048, 4096, 8192, 32768)
    low: tuple[float, ...] = (0.0, 1.05, 1.2, 1.4, 1.5, 1.5, 1.5, 1.5)
    high: tuple[float, ...] = (2.0, 2.1, 2.2, 2.3, 2.35, 2.45, 2.6, 3.0)
    chunk: int = 4096
    most_bad: float = 0.25
    most_run: int = 1
    level: int = 3

    def within(self, n: int, ratio: float, high: Sequence[float] | None = None) -> bool:
        i = bisect_right(self.lengths, n) - 1
        return self.low[i] <= ratio <= (high or self.high)[i]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    ws = WORD.findall(text)
    n = len(ws)
    symbols = sum(map(text.count, "#*$%&|<>"))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 8:
        windows = list(zip(*(ws[i : n - 7 + i] for i in range(8)), strict=True))
        if len(set(windows)) < n - 7:
            first, covered = {}, bytearray(n)
            for i, w in enumerate(windows):
                if (j := first.setdefault(w, i)) != i:
                    covered[i : i + 8] = covered[j : j + 8] = b"\x01" * 8
            repeat = covered.count(1)
    return n, sum(map(len, ws)), symbols, dup, repeat


def judge(data: bytes, bands: Bands, packer) -> tuple[float, float, float, float, bool]:
    """Whole ratio, least and greatest chunk ratio, share of bytes in bad chunks, verdict."""
    n = len(data)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, False
    ratio = n / len(packer(data))
    least = most = ratio
    bad = run = longest = 0
    if n > bands.chunk:
        ratios = []
        for i in range(0, n, bands.chunk):
            piece = data[i : i + bands.chunk]
            r = len(piece) / len(packer(piece))
            ratios.append(r)
            if not bands.within(len(piece) - 1, r):
                bad += len(piece)
                run += 1
                longest = max(longest, run)
            else:
                run = 0
        least, most = min(ratios), max(ratios)
    return ratio, least, most, bad / n, bands.within(n, ratio) and bad <= bands.most_bad * n and longest <= bands.most_run


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, most_chunk_ratio double, bad_share double"
)


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """A row for each row of docs (doc_id, text) with the base counts, the ratios and the verdict.

    Null and empty texts have no words: they fail the base rule and are not kept. A null doc_id stays null; repeated
    rows are judged each for itself; other columns of docs are ignored. An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> dict:
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress
        rows = []
        for text in batch.column("text").to_pylist():
            counts = base_counts(text)
            n, _, _, _, repeat = counts
            failed = n < 20 or 100 * repeat > 30 * n
            found = judge((text or "").encode("utf-8", "surrogatepass"), bands, packer)
            rows.append((*counts, failed, found[4] and not failed, *found[:4]))
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return {"doc_id": batch.column("doc_id")} | {n: pa.array(c, t) for n, t, c in zip(names, types, columns, strict=True)}

    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"), run, SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs whose text passes, with all their columns; one pass, without a join.

    Rows with null or empty texts go.
    """
    def keep(batch: pa.RecordBatch) -> list[bool]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress
        out = []
        for text in batch.column("text").to_pylist():
            n, _, _, _, repeat = base_counts(text)
            out.append(not (n < 20 or 100 * repeat > 30 * n) and judge(text.encode("utf-8", "surrogatepass"), bands, packer)[4])
        return out

    return filter_batches(docs, keep)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
