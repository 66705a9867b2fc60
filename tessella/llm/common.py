"""What the corpus operators share: words, Arrow helpers, shared storage."""

from __future__ import annotations

import contextlib
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
#: The same class for Java's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """Runs of anything but blank and U+0009 to U+000D; null gives none."""
    return WORD.findall(text) if text else []


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z alone."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def lower_ascii_col(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, nbytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows and bytes, so that a worker never makes Python objects of many long texts at once.

    arrow_map bounds what crosses from the JVM in the same way for all operators; this cuts finer.
    """
    for batch in batches:
        step = max(1, min(rows, int(nbytes * batch.num_rows / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of at most 2000 rows and 16 MB.

    Spark takes both from the session when a plan runs, so they are lowered there, always to the same values (lower ones
    stay): what one operator needs no other changes.
    """
    conf = df.sparkSession.conf
    for key, most in _BATCH.items():
        m = re.fullmatch(r"(-?\d+)([kmg]?)b?", str(conf.get(key)).strip().lower())
        now = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]] if m else 0
        if not 0 < now <= most:
            conf.set(key, most)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 2000) -> DataFrame:
    """Applies f to slices of Arrow batches; f returns a column for each name of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = f(batch)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return arrow_map(df, run, schema)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool] | np.ndarray], rows: int = 2000) -> DataFrame:
    """The rows of df for which keep, given a slice of an Arrow batch, says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return arrow_map(df, run, df.schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of this machine;
    on a cluster that would be another disk for each executor, so there it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/tessella-checkpoints"
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting that holds within the block alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor costs nothing.

    Spark removes the shuffle files behind the write when it has ended, so that a chain of tables does not hold those of
    all its steps at once. options: of the writer.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}"
    schema = df.schema
    with setting(spark, _CLEANUP, "true"):
        df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Removes what materialise() wrote, by the file system that holds it; only once nothing will read it again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(folder: str) -> str:
    """The folder as workers open it; only file systems that are mounted can be memory-mapped."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{folder}: memory-mapped files need a mounted shared folder in spark.checkpoint.dir")
    return url.path


#: Files that a worker keeps mapped at a time; a process may have some 65 thousand maps on usual settings.
MAPPED = 2000


def mapped(path: str, dtype) -> np.ndarray:
    """A file as an array, mapped into memory. The map holds no file handle, of which a process may have few."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return np.empty(0, dtype)
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype)


_MASK = (1 << 64) - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the words of whole Arrow string columns, from their bytes, without a Python string for each word.

    A word's hash is the polynomial of its bytes' random values in an odd base, modulo 2 ** 64, finalised; it comes from
    running sums over a block of text. lower: A-Z hash as a-z. Blocks of about `block` bytes end between words, so
    temporaries stay small however long a text is.
    """

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 0, lower: bool = False, block: int = 1 << 20):
        rng = np.random.default_rng(seed + 1)
        self._values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self._values[65:91] = self._values[97:123]
        self._space = np.zeros(256, bool)
        self._space[[9, 10, 11, 12, 13, 32]] = True
        self._block, self._powers = block, np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        """Powers of the base and of its inverse, for n places."""
        if len(self._powers) < n:
            mask = (1 << 64) - 1
            make = lambda base: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))))
            with np.errstate(over="ignore"):
                self._powers, self._inverse = make(np.uint64(self._BASE)), make(np.uint64(pow(self._BASE, -1, mask + 1)))

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of a string column, text after text, and where each text's begin (one more at the end).

        Null texts have no words.
        """
        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        hashes, ends = [np.empty(0, np.uint64)], np.zeros(n + 1, np.int64)
        total, i = 0, 0
        while i < n:
            j = i + 1
            while j < n and offsets[j + 1] - offsets[i] <= self._block:
                j += 1
            at, stop = int(offsets[i]), int(offsets[j])
            if j == i + 1 and stop - at > self._block:  # one long text, in pieces that end at white space
                count = 0
                while at < stop:
                    cut = min(stop, at + self._block)
                    while cut < stop and not self._space[data[cut]]:
                        cut += 1
                    h, _ = self._words(data[at:cut], np.array([0, cut - at]))
                    hashes.append(h)
                    count += len(h)
                    at = cut
                total += count
                ends[j] = total
            else:
                h, start = self._words(data[at:stop], offsets[i : j + 1] - at)
                hashes.append(h)
                ends[i + 1 : j + 1] = total + np.searchsorted(start, offsets[i + 1 : j + 1] - at)
                total += len(h)
            i = j
        return np.concatenate(hashes), ends

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in data and where each begins; no word crosses a cut between texts."""
        solid = ~self._space[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[:-1] = solid
        begin[1:-1] &= ~solid[:-1]
        inner = cuts[:-1][cuts[:-1] < len(data)]
        begin[inner] = solid[inner]
        close = np.zeros(len(data) + 1, bool)
        close[1:] = solid
        close[1:-1] &= ~solid[1:]
        last = cuts[1:][cuts[1:] > 0]
        close[last] = solid[last - 1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(close)
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self._values[data] * self._powers[: len(data)], out=run[1:])
            h = (run[stop] - run[start]) * self._inverse[start] + (stop - start).astype(np.uint64)
            return mix64(h), start


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_BLOOM_BITS = 22


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(ids.view(np.uint64) + np.uint64(0x51ED270B))
    return np.stack([(h >> np.uint64(s)).astype(np.int64) & ((1 << _BLOOM_BITS) - 1) for s in (0, 21, 42)])


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the numbers of a one-column table: 2 ** 22 bits, so that at most 2 ** 16 words reach the driver
    and half a megabyte goes to each worker, whatever the number of ids. A full one lets every id through."""

    def run(batches):
        bits = np.zeros(1 << _BLOOM_BITS, bool)
        for batch in batches:
            bits[_bloom_places(batch.column(0).to_numpy())] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    rows = arrow_map(ids, run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (_BLOOM_BITS - 6), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def bloom_hits(filter_words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each id whether it may be one of the filter's; a wrong yes is possible, a wrong no is not."""
    at = _bloom_places(ids)
    return ((filter_words[at >> 6] >> (at & 63)) & 1).astype(bool).all(axis=0)
