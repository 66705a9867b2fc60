"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays, mapped by workers.

The vocabulary is counted first: words are 64-bit hashes, which get numbers by falling count. An n-gram's hash is made of
that of its first n - 1 words and of its last word's number, so the n-grams of one order are the contexts of the next.
Counting goes from the highest order down, a job for each: tasks count n-grams, an exchange brings equal ones together,
and there a shard of the hash space is written, a record for each n-gram: its count, and as a context the sum of the
counts that follow it and how many words follow it once, twice and more often. An n-gram gives two rows to the next lower
order: its suffix, whose continuation count it raises, and its first words, as a context.
A shard is decided by an n-gram's first words and three bits of its last word, so that a very frequent context spreads over
eight shards and a rare one stays together. The number of shards follows the corpus' bytes and a task holds one at a time,
so memory depends neither on the corpus nor on the number of partitions. The number of the words' own shards, and of order
1, follows the vocabulary, which is known by then.

What crosses an exchange is added up before and packed: the words' numbers in sorted order, a few bytes an n-gram. Each
level is written to the shared folder, and the exchanges below the first run in `rounds`, each over a part of the shards,
so that their files on disk are few. What is stored keeps 48 bits of a hash beyond its shard's number (a shard has about a million
n-grams, so a look-up of an n-gram that was never seen finds one by chance once in 3e8 times, whatever the size of the
corpus) and all 64 of a word's; two different words share their hash at a chance of 3e-8 among a million, of 0.03 among a
thousand million. Records are a byte each, a number into the shard's table of the commonest ones; others stand aside.

The arrays lie in the shared folder. Workers map them into memory and look up sorted batches of hashes, so a look-up sweeps
through a shard's pages and the model's size is not a matter of a worker's memory. The folder must be mounted by every
worker. Only the counts of counts, a few numbers an order, reach the driver.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WordHasher, arrow_map, delete_folder, local_path, mapped, materialise, mix64, shared_folder, slices, table

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 500_000  #: tokens that are scored together
_COUNTED = 600_000  #: tokens that are counted together
_BLOCK, _HELD = 2000, 4_000_000  #: n-grams that a block is to have, and that a task holds at most for that, a few bytes each
_WORDS = 500_000  #: words in a shard of the vocabulary, at most
#: Shards that a worker maps at once; a process may have some 65,000 maps. Each text batch visits all, so fewer than there are would be mapped anew each time.
MAPPED = 20_000
END = np.uint64(0x45BE7F0D1A3C9E21)  #: the hash of a text's end
START, NEVER = np.uint64(0), np.uint64(2**64 - 1)  #: numbers of what stands before a text, and of words not counted


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' tokens, text after text, each with its end; and where each text's begin, one more at the end."""
    h, at = hasher.column(texts)
    n = len(at) - 1
    at = at + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[at[1:] - 1] = True
    out[ends], out[~ends] = END, h
    return out, at


def chunks(at: np.ndarray, most: int):
    """(from, to) of texts that have about `most` tokens together, or less so that all have alike: each costs a visit to every shard."""
    i, n = 0, len(at) - 1
    size = int(at[-1] - at[0])
    most = -(-size // max(1, round(size / most)))
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def padded(h: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' words with order - 1 START signs before each text, and the places of the words in that.

    h: the words' numbers; at: where each text begins, one more at the end.
    """
    sizes = np.diff(at)
    place = np.arange(len(h)) + np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)
    out = np.full(len(h) + (order - 1) * len(sizes), START)
    out[place] = h
    return out, place


def gram_keys(c: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The hashes of n-grams by that of their first words and their last word; the top bits are the shard."""
    with np.errstate(over="ignore"):
        shard = mix64(c + (w & np.uint64(7)) * _MULT) >> np.uint64(64 - bits)
        return shard << np.uint64(64 - bits) | mix64(c * _MULT ^ w) >> np.uint64(bits)


def word_keys(w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(w * _MULT + np.uint64(1))


def keys_by_order(w: np.ndarray, order: int, bits: int):
    """For n = 1 to order the hash of the n-gram that ends at each place; the first n - 1 places count as after START signs."""
    out = word_keys(w)
    yield out
    for _ in range(1, order):
        out = gram_keys(np.concatenate((word_keys(np.array([START])), out[:-1])), w, bits)
        yield out


def keys_of(words: list[np.ndarray], bits: int) -> np.ndarray:
    """The hashes of n-grams given as columns of words."""
    out = word_keys(words[0])
    for w in words[1:]:
        out = gram_keys(out, w, bits)
    return out


def _sum_by(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys ascending, where one of each stood, and the values' sums."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], order[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def shards_of(keys: np.ndarray, bits: int):
    """(shard, from, to) of ascending keys."""
    if not len(keys):
        return
    s = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    for a, b in zip(cut, np.append(cut[1:], len(s)), strict=True):
        yield int(s[a]), int(a), int(b)


# blocks that cross an exchange


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max), copy=False)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers as one compressed block: the narrowest type for each, equal bytes side by side."""
    import zstandard

    head, parts = [], []
    for x in arrays:
        x = _narrow(x)
        head.append((x.dtype.str, len(x)))
        parts += [(x >> x.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(x.itemsize)]
    said = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(said).to_bytes(4, "little") + said + b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(data[:4], "little")
    out, at = [], 4 + n
    for kind, length in json.loads(data[4 : 4 + n]):
        t = np.dtype(kind)
        x = np.frombuffer(data, np.uint8, length * t.itemsize, at).reshape(t.itemsize, length).T
        at += length * t.itemsize
        out.append(np.ascontiguousarray(x).view(t).reshape(length).astype(np.uint64))
    return out


def pack_rows(words: list[np.ndarray], fields: list[np.ndarray]) -> bytes:
    """n-grams with their fields, given in the order of their words' numbers; the first word's as differences.

    Fields are an n-gram's count and, as a context, the sum of the counts that follow it and how many words follow it once,
    twice and more often.
    """
    return pack([np.diff(words[0], prepend=words[0].dtype.type(0)), *words[1:], *fields])


def unpack_rows(block: bytes, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    first, *rest = unpack(block)
    return [np.cumsum(first, dtype=np.uint64), *rest[: n - 1]], rest[n - 1 :]


_NUMBERS = ("f1", "f2", "f3", "f4", "total")
_ROWS = "shard int, block binary, " + ", ".join(f"{x} long" for x in _NUMBERS)


def _row_batch(rows: list[tuple[int, bytes]], numbers: list[int] | None = None) -> pa.RecordBatch:
    """Blocks for the next level, and a row of numbers of this one, whose shard is -1."""
    extra = [] if numbers is None else [(-1, None)]
    shard, block = zip(*rows, *extra, strict=True)
    cols = [pa.array(shard, pa.int32()), pa.array(block, pa.binary())]
    for i in range(len(_NUMBERS)):
        cols.append(pa.array([None] * len(rows) + ([] if numbers is None else [numbers[i]]), pa.int64()))
    return pa.RecordBatch.from_arrays(cols, names=["shard", "block", *_NUMBERS])


class Blocks:
    """Packs n-grams by shard. They are held, a few bytes each, until blocks of about _BLOCK come together: a block costs the
    same however few it has, and chunks times shards would be many more blocks than the corpus needs."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [], 0

    def add(self, words: list[np.ndarray], fields: list[np.ndarray]) -> None:
        """n-grams in the order of their words' numbers."""
        shard = (keys_of(words, self.bits) >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.uint32)
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        self.held.append((at, [_narrow(x)[order] for x in words], [_narrow(x)[order] for x in fields]))
        self.size += len(order)

    def full(self) -> bool:
        return self.size >= min(_HELD, _BLOCK << self.bits)

    def rows(self):
        """The packed rows (shard, block) of what is held, some hundreds at a time."""
        out, held = [], self.held
        self.held, self.size = [], 0
        for s in range(1 << self.bits if held else 0):
            parts = [(at[s], at[s + 1], words, fields) for at, words, fields in held if at[s] < at[s + 1]]
            if not parts:
                continue
            words, fields = ([np.concatenate(x) for x in zip(*([c[i:j] for c in p[which]] for i, j, *p in parts), strict=True)] for which in (0, 1))
            if len(parts) > 1:
                by = np.argsort(words[0], kind="stable")
                words, fields = [w[by] for w in words], [f[by] for f in fields]
            out.append((s, pack_rows(words, fields)))
            if len(out) == 500:
                yield out
                out = []
        if out:
            yield out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and for each of h the place of its own among them; by a hash table, without sorting."""
    d = pa.array(h.view(np.int64)).dictionary_encode()
    return d.dictionary.to_numpy().view(np.uint64), d.indices.to_numpy()


def _joined(words: list[np.ndarray], width: int) -> np.ndarray:
    """n-grams as one number each, whose order is that of their words; words are of `width` bits."""
    out = words[0]
    for w in words[1:]:
        out = out << np.uint64(width) | w
    return out


def _cut(joined: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    mask = np.uint64((1 << width) - 1)
    return [joined >> np.uint64(width * i) & mask for i in range(n - 1, -1, -1)]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def count_grams(number: np.ndarray, which: np.ndarray, at: np.ndarray, order: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """n-grams of texts in the order of their words' numbers, and how often each stands there.

    number: those of the distinct words; which: for each place its word among these; at: where texts begin. Words are
    numbered anew among these, so that an n-gram is one number, and sorting it needs no more than that.
    """
    by = np.argsort(number)
    rank = np.empty(len(by), np.uint64)
    rank[by] = np.arange(1, len(by) + 1, dtype=np.uint64)
    width = max(1, len(by).bit_length())
    if order * width <= 64:
        w, place = padded(rank[which], at, order)
        k = np.sort(_joined([w[place - i] for i in range(order - 1, -1, -1)], width))
        first = _runs(k)
        named = np.concatenate(([START], number[by]))
        return [named[x] for x in _cut(k[first], order, width)], np.diff(first, append=len(k)).astype(np.uint64)
    w, place = padded(number[which], at, order)
    for key in keys_by_order(w, order, bits):
        pass
    _, first, (n,) = _sum_by(key[place], [np.ones(len(place), np.uint64)])
    words = [w[place[first] - i] for i in range(order - 1, -1, -1)]
    by = np.lexsort(words[::-1])
    return [x[by] for x in words], n[by]


def lower_order(words: list[np.ndarray], count: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What distinct n-grams (columns of words, their counts) say of the next lower order, in the order of its words: how
    many of them end so, and of their first words the sum of their counts and how many stand once, twice and more often."""
    n = len(words) - 1
    width = max(1, max(int(w.max()) for w in words).bit_length())
    if n * width > 62:
        both = [np.concatenate(x) for x in zip(words[1:], words[:-1], strict=True)]
        one, none = np.ones(len(count), np.uint64), np.zeros(len(count), np.uint64)
        said = (one, none), (none, count), *((none, x.astype(np.uint64)) for x in (count == 1, count == 2, count > 2))
        _, first, fields = _sum_by(keys_of(both, bits), [np.concatenate(x) for x in said])
        both = [w[first] for w in both]
        by = np.lexsort(both[::-1])
        return [w[by] for w in both], [f[by] for f in fields]
    ends = np.sort(_joined(words[1:], width))
    first = _runs(ends)
    ends, n_ends = ends[first], np.diff(first, append=len(ends))
    before = _joined(words[:-1], width)
    k = np.sort(before << np.uint64(2) | np.minimum(count, np.uint64(3)))
    kind, k = (k & np.uint64(3)).astype(np.uint8), k >> np.uint64(2)
    first = _runs(k)
    begins = k[first]
    kinds = [np.add.reduceat(kind == c, first, dtype=np.int64) for c in (1, 2, 3)]
    more = count > 2
    total = kinds[0] + 2 * kinds[1]
    np.add.at(total, np.searchsorted(begins, before[more]), count[more].astype(np.int64))
    every = np.sort(np.concatenate((ends, begins)))
    every = every[_runs(every)]
    fields = [np.zeros(len(every), np.uint64) for _ in range(5)]
    fields[0][np.searchsorted(every, ends)] = n_ends
    at = np.searchsorted(every, begins)
    for f, x in zip(fields[1:], (total, *kinds), strict=True):
        f[at] = x
    return _cut(every, n, width), fields


def _training(batches, hasher: WordHasher, most: int):
    """(hashes, sizes of texts) of the training texts, about `most` tokens at a time."""
    held, sizes, size = [], [], 0
    for batch in slices(batches):
        batch = batch.filter(pa.array([not held_out(x) for x in batch.column(0).to_pylist()], pa.bool_()))
        h, at = tokens(batch.column(1), hasher)
        for i, j in chunks(at, most):
            held.append(h[at[i] : at[j]])
            sizes += np.diff(at[i : j + 1]).tolist()
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held), sizes
                held, sizes, size = [], [], 0
    if held:
        yield np.concatenate(held), sizes


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, n): hashes with their counts."""
    hasher = WordHasher(seed=4, lower=True)

    def run(batches):
        for h, _ in _training(batches, hasher, _COUNTED):
            words, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n.astype(np.int64)})

    return arrow_map(docs, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _number_words(words: DataFrame, parts: int, bits: int, folder: str, path: str) -> tuple[int, int, int]:
    """Numbers the words from 1 by falling count and writes what scoring looks up: a word's number and count.

    The number is a place within a range of the sorted words after those of the ranges before; a row for each range
    reaches the driver. Gives the numbers of words and of tokens, and the bits of the words' shards, `bits` at most.
    """
    spark = words.sparkSession
    sorted_ = words.repartitionByRange(parts, F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    placed = sorted_.select("word", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    placed = materialise(placed, folder, "words")
    ranges = placed.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy("part").collect()
    before, rows = 1, []
    for r in ranges:
        rows.append((r["part"], before))
        before += r["words"]
    bits = min(bits, max(3, math.ceil(math.log2(max(1, before - 1) / _WORDS))))
    numbered = placed.join(F.broadcast(spark.createDataFrame(rows, "part int, before long")), "part")
    shard = F.shiftrightunsigned("word", 64 - bits).cast("int")
    numbered = numbered.select(shard.alias("shard"), "word", (F.col("before") + F.col("place")).alias("number"), "n")

    def run(batches):
        held, shard = [], -1

        def write():
            word, number, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(word)
            write_shard(f"{path}/words-{shard}", word[order], bits, [number[order], n[order]], exact=True)

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cols = [batch.column(i).to_numpy().view(np.uint64) for i in (1, 2, 3)]
            cut = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else []
            for a, b in zip(cut, [*cut[1:], len(shards)], strict=True):
                if shards[a] != shard and held:
                    write()
                    held = []
                shard = int(shards[a])
                held.append([c[a:b] for c in cols])
        if held:
            write()
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    arrow_map(numbered.repartition(parts, "shard").sortWithinPartitions("shard"), run, "done boolean").agg(F.count("done")).collect()
    delete_folder(spark, f"{folder}/words")
    return before - 1, sum(r["tokens"] for r in ranges), bits


def _count_tokens(docs: DataFrame, order: int, model: Model) -> DataFrame:
    """The training texts' n-grams of the highest order, counted within chunks."""
    hasher = WordHasher(seed=4, lower=True)

    def run(batches):
        blocks = Blocks(model.bits_of(order))
        for h, sizes in _training(batches, hasher, _COUNTED):
            every, which = distinct(h)
            del h
            words, n = count_grams(model.numbers(every)[0], which, np.concatenate(([0], np.cumsum(sizes))), order, model.bits)
            del every, which
            blocks.add(words, [n])
            del words, n
            if blocks.full():
                yield from map(_row_batch, blocks.rows())
        yield from map(_row_batch, blocks.rows())

    return arrow_map(docs, run, _ROWS)


def _count_level(rows: DataFrame, n: int, model: Model) -> DataFrame:
    """Writes the shards of order n; gives the rows of the next order and the numbers of this one.

    rows: partitioned by shard and sorted by it, so that a task holds one shard at a time.
    """

    bits = model.bits

    def level(shard: int, blocks: list[bytes], lower: Blocks) -> pa.RecordBatch:
        parts = [unpack_rows(b, n) for b in blocks]
        words = [np.concatenate(x) for x in zip(*(w for w, _ in parts), strict=True)]
        fields = [np.concatenate(x) for x in zip(*(f for _, f in parts), strict=True)]
        del parts
        keys, first, fields = _sum_by(keys_of(words, bits), fields)
        words, count = [w[first] for w in words], fields[0]
        write_shard(f"{model.folder}/order-{n}-{shard}", keys, model.bits_of(n), fields)
        numbers = [*(int((count == c).sum()) for c in (1, 2, 3, 4)), int(count.sum())]
        real = count > 0  # not those that are contexts alone, which begin with START signs
        if n > 1 and real.any():
            words, count = [w[real] for w in words], count[real]
            del keys, first, fields
            lower.add(*lower_order(words, count, bits))
        return _row_batch([], numbers)

    def run(batches):
        held, shard, lower = [], -1, Blocks(model.bits_of(n - 1))
        for batch in batches:
            for s, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard:
                    if held:
                        yield level(shard, held, lower)
                        if lower.full():
                            yield from map(_row_batch, lower.rows())
                    held, shard = [], s
                held.append(block.as_buffer().to_pybytes())
        if held:
            yield level(shard, held, lower)
        yield from map(_row_batch, lower.rows())

    return arrow_map(rows.select("shard", "block"), run, _ROWS)


# shards on disk


def write_shard(path: str, keys: np.ndarray, bits: int, fields: list[np.ndarray], exact: bool = False) -> None:
    """A shard as one file, moved into place when it is complete, so a task that runs again does no harm.

    keys: ascending, of one shard. Stored are 32 bits after the shard's own and 16 more; a byte for each record, its number
    among the commonest 255 records; and the others' places and records. exact: all bits, and records as they are.
    """
    rest = keys << np.uint64(bits)
    high = (rest >> np.uint64(32)).astype("<u4")
    low = (rest & np.uint64(0xFFFFFFFF)).astype("<u4") if exact else (rest >> np.uint64(16) & np.uint64(0xFFFF)).astype("<u2")
    records = np.stack(fields, axis=1)
    width = "<u4" if not len(keys) or records.max() < 1 << 32 else "<u8"
    if exact:
        return _write(path, {"high": high, "low": low, "records": records.astype(width)})
    small = (records < 256).all(axis=1) & (len(fields) <= 8)
    packed = np.zeros(len(keys), np.uint64)
    for i in range(min(8, len(fields))):
        packed |= np.where(small, records[:, i], 0).astype(np.uint64) << np.uint64(8 * i)
    kinds, which, seen = np.unique(packed[small], return_inverse=True, return_counts=True)
    best = np.sort(np.argsort(-seen, kind="stable")[:255])
    number = np.full(len(kinds), 255, np.uint8)
    number[best] = np.arange(len(best))
    code = np.full(len(keys), 255, np.uint8)
    code[small] = number[which]
    rare = np.flatnonzero(code == 255)
    common = (kinds[best][:, None] >> (np.arange(len(fields), dtype=np.uint64) * np.uint64(8))) & np.uint64(255)
    _write(path, {"high": high, "low": low, "code": code, "common": common.astype("<u4"), "rare": rare.astype("<u4"), "records": records[rare].astype(width)})


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (at, x.dtype.str, x.shape)
        at += -(-x.nbytes // 8) * 8
    said = json.dumps(head).encode()
    said = said.ljust(-(-(len(said) + 8) // 8) * 8 - 8)
    temp = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        f.write(len(said).to_bytes(8, "little") + said)
        for x in arrays.values():
            f.write(x.tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0"))
    os.replace(temp, path)


class Shard:
    """A shard's file, mapped into memory."""

    code = derived = None

    def __init__(self, path: str):
        raw = mapped(path, np.uint8)
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        for name, (at, kind, shape) in head.items():
            t = np.dtype(kind)
            size = t.itemsize * math.prod(shape)
            setattr(self, name, raw[8 + n + at : 8 + n + at + size].view(t).reshape(shape))

    def fill(self, keys: np.ndarray, bits: int, derive, out: list[np.ndarray]) -> None:
        """Writes what derive makes of the records of ascending keys of this shard; the rest of out stays.

        derive: from records (a row each) to a column for each array of out; always the same one for a shard.
        """
        rest = keys << np.uint64(bits)
        high = (rest >> np.uint64(32)).astype("<u4")
        low = (rest & np.uint64(0xFFFFFFFF)).astype("<u4") if self.low.itemsize == 4 else (rest >> np.uint64(16) & np.uint64(0xFFFF)).astype("<u2")
        if not len(self.high):
            return
        p = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        same = self.high[p] == high
        hit = same & (self.low[p] == low)
        todo = np.flatnonzero(same ^ hit)
        while len(todo):  # keys with the same 32 bits stand side by side
            p[todo] += 1
            todo = todo[p[todo] < len(self.high)]
            todo = todo[self.high[p[todo]] == high[todo]]
            ours = self.low[p[todo]] == low[todo]
            hit[todo[ours]] = True
            todo = todo[~ours]
        known = np.flatnonzero(hit)
        p = p[known]
        if self.code is None:
            for o, x in zip(out, derive(self.records[p]), strict=True):
                o[known] = x
            return
        if self.derived is None:
            self.derived = [np.resize(np.append(x, 0.0), 256) for x in derive(self.common)]
        code = self.code[p]
        rare = np.flatnonzero(code == 255)
        others = derive(self.records[np.searchsorted(self.rare, p[rare])]) if len(rare) else self.derived
        for o, x, y in zip(out, self.derived, others, strict=True):
            o[known] = x[code]
            if len(rare):
                o[known[rare]] = y


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more. Where counts of counts are missing, 0.5, 1 and 1.5."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), i + 0.99) for i, x in enumerate(d))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie and the few numbers that scoring needs besides."""

    folder: str
    order: int
    bits: int
    words: int
    train_tokens: int
    continuations: int = 0
    discount: tuple[tuple[float, float, float], ...] = ()
    left: float = 1.0  #: share of the unigrams' discounts
    word_bits: int | None = None  #: of the shards of words and of order 1, where fewer than `bits`
    open_files: OrderedDict = field(default_factory=OrderedDict, compare=False, hash=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "open_files"} | {"open_files": OrderedDict()}

    def bits_of(self, n: int) -> int:
        """Bits of the shards of order n; 0 stands for the words."""
        return self.bits if n > 1 or self.word_bits is None else self.word_bits

    def _map(self, name: str) -> Shard | None:
        if name not in self.open_files:
            try:
                self.open_files[name] = Shard(f"{self.folder}/{name}")
            except FileNotFoundError:
                self.open_files[name] = None
            if len(self.open_files) > MAPPED:
                self.open_files.popitem(last=False)
        self.open_files.move_to_end(name)
        return self.open_files[name]

    def look_up(self, name: str, keys: np.ndarray, derive, width: int) -> list[np.ndarray]:
        """Columns of what derive makes of the records of hashes, zeros for those that are not stored; each distinct hash is
        looked up once."""
        order = np.argsort(keys)
        q = keys[order]
        first = _runs(q)
        back = np.empty(len(q), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(q)))
        q = q[first]
        out = [np.zeros(len(q)) for _ in range(width)]
        bits = self.bits_of(0 if name == "words" else int(name.removeprefix("order-")))
        for s, a, b in shards_of(q, bits):
            held = self._map(f"{name}-{s}")
            if held is not None:
                held.fill(q[a:b], bits, derive, [o[a:b] for o in out])
        return [o[back] for o in out]

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words by their hashes, and their counts in training."""
        number, count = self.look_up("words", h, lambda r: r.astype(np.float64).T, 2)
        number = number.astype(np.uint64)
        number[number == 0] = NEVER
        return number, count

    def _derive(self, n: int):
        """What scoring needs of a record of order n: its count less the discount; below the highest order the sum of the
        counts that follow it, and the share of that which the discounts leave for lower orders."""
        d = np.array((0.0, *self.discount[n - 1]))
        after = np.array(self.discount[n]) if n < self.order else None

        def derive(r: np.ndarray) -> list[np.ndarray]:
            r = r.astype(np.float64)
            top = np.maximum(r[:, 0] - d[np.minimum(r[:, 0], 3).astype(np.int64)], 0.0)
            if after is None:
                return [top]
            return [top, r[:, 1], np.divide(r[:, 2:5] @ after, r[:, 1], out=np.zeros(len(r)), where=r[:, 1] > 0)]

        return derive

    def log10(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its log10 probability and its count in training. at: where texts begin, one more at the end."""
        words, which = distinct(h)
        number, raw = self.numbers(words)
        w, place = padded(number[which], at, self.order)
        own = np.full(len(w), len(words))  # START stands after the words
        own[place] = which
        p = before = None
        for n, keys in enumerate(keys_by_order(w, self.order, self.bits), start=1):
            last = n == self.order
            if n == 1:  # by distinct words
                top, *more = (x[own] for x in self.look_up("order-1", word_keys(np.append(number, START)), self._derive(1), 1 if last else 3))
                top = top[place]
            else:
                top, *more = self.look_up(f"order-{n}", keys[place] if last else keys, self._derive(n), 1 if last else 3)
                top = top if last else top[place]
            if n == 1:
                p = top / max(1, self.continuations) + self.left / (self.words + 1)
            else:
                total, rest = before
                seen = total > 0
                p = np.where(seen, np.divide(top, total, out=np.zeros(len(place)), where=seen) + rest * p, p)
            if more:
                before = [x[place - 1] for x in more]  # what the n words before a token say of what follows them
        return np.log10(p), raw[which]


def train(docs: DataFrame, order: int = 3, folder: str | None = None, shard_bytes: int = 8 << 20, rounds: int = 4) -> Model:
    """Counts the texts of docs (doc_id, text) whose crc32(doc_id as text) mod 7 is not 2, and stores the model.

    shard_bytes: of text for each shard, about; it bounds what a task holds. rounds: parts in which the levels below the
    highest are exchanged. A null text is empty and counts as its end alone; a null doc_id counts as the empty text.
    Repeated rows count again. Without any training row every token has the same probability, 1.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, size / shard_bytes))))
    parts = max(1, min(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    words, total, word_bits = _number_words(_count_words(docs), parts, bits, folder, path)
    model = Model(path, order, bits, words, total, word_bits=word_bits)
    rows, facts, held = _count_tokens(docs, order, model), {}, []
    for n in range(order, 0, -1):
        times = 1 if n == order else min(rounds, 1 << model.bits_of(n))
        done = []
        for i in range(times):
            part = rows.where("shard >= 0") if times == 1 else rows.where(f"shard >= 0 AND shard % {times} = {i}")
            part = part.repartition(parts, "shard").sortWithinPartitions("shard")
            done.append(materialise(_count_level(part, n, model), folder, f"level-{n}-{i}"))
        for x in held:
            delete_folder(spark, x)
        held = [f"{folder}/level-{n}-{i}" for i in range(times)]
        rows = done[0]
        for x in done[1:]:
            rows = rows.unionByName(x)
        facts[n] = rows.where("shard < 0").agg(*[F.sum(c).alias(c) for c in _NUMBERS]).first().asDict()
        facts[n] = {k: v or 0 for k, v in facts[n].items()}
    for x in held:
        delete_folder(spark, x)
    d = [discounts(*(facts[n][c] for c in ("f1", "f2", "f3", "f4"))) for n in range(1, order + 1)]
    one = facts[1]
    over = words - one["f1"] - one["f2"]
    left = (d[0][0] * one["f1"] + d[0][1] * one["f2"] + d[0][2] * over) / one["total"] if one["total"] else 1.0
    return replace(model, continuations=one["total"], discount=tuple(d), left=left)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs (doc_id, text) the columns of its score; perplexity is 10 ** (-score / n_tokens).

    Null and empty texts are their end alone. Null and repeated doc_ids are rows like others; other columns are ignored.
    """
    hasher = WordHasher(seed=4, lower=True)
    norm = float(np.log10(model.train_tokens + model.words + 1))

    def run(batches):
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            every, at = tokens(batch.column(1), hasher)
            for a, b in chunks(at, _CHUNK):
                starts = at[a:b] - at[a]
                p, raw = model.log10(every[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "held_out": pa.array([held_out(x) for x in ids[a:b]], pa.bool_()),
                        "n_tokens": np.diff(at[a : b + 1]),
                        "n_known": np.add.reduceat((raw > 0).astype(np.int64), starts),
                        "train_tokens": np.full(b - a, model.train_tokens, np.int64),
                        "base_score": np.add.reduceat(np.log10(raw + 1.0) - norm, starts),
                        "score": np.add.reduceat(p, starts),
                    }
                )

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))
