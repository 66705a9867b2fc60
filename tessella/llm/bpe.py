"""Byte-pair encoding with content-defined chunk reuse.

A rolling hash of the text cuts it into chunks at places that only the nearby content decides, so copies and shared
passages are cut alike wherever they stand. A worker encodes each distinct chunk once and keeps its ids in a memo of
bounded size. Chunks cut through words, so every join is repaired: from the last sure word boundary of the left chunk
the text is encoded again into the right chunk, until the new ids and the right chunk's own ids agree from one sure
boundary to the next; where they never do, the piece grows over the whole chunk. The result is exactly that of encoding
the whole text.

A boundary is sure where the kind of sign changes (letter, number, white space, other) so that no word of the byte-level
pattern reaches over it: every scan, wherever it began, splits there, and what follows depends on what follows alone.
Only white space is joined with what follows it, and an apostrophe with letters. Signs that Unicode has named lately are
of no sure kind.

A word of very many signs (Chinese or Japanese without punctuation) has no boundary within. Its chunks are encoded alone
and joined by what decides on byte-pair encodings: a row of tokens is that of its bytes if each two neighbours are that of
theirs. So the tokens around a join are encoded again, a few more at a time, until they fit both neighbours.

Chunks that the corpus has more than once are encoded once for all: only the chunks' 128-bit hashes are exchanged to find
them (16 bytes for about 1300); those that repeat are encoded where one exchange brings one copy of each, and their ids
lie in the shared folder as sorted hash arrays, which workers map into memory. Other chunks are encoded where they are
met. Texts themselves are never exchanged. Without that folder (`reuse` is None) chunks are shared within a worker.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import os
import re
import unicodedata
import uuid
from array import array
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import MAPPED, arrow_map, delete_folder, local_path, map_batches, mapped, materialise, shared_folder, slices, table
from tessella.llm.language_model import Shard, shards_of, write_shard

MASK_BITS = 10  #: a chunk is about 2 ** MASK_BITS bytes beyond the least length
LEAST, MOST = 256, 8192
_WINDOW = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def cut_points(text: str) -> list[int]:
    """Code point offsets at which chunks end, the text's length last.

    The hash at a place sums shifted values of the 32 code points before it; cuts lie where its top bits are zero.
    """
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = (codes + np.uint64(1)) * _MULT
    h ^= h >> np.uint64(29)
    h *= _MULT
    step = 1
    while step < _WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    found = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    cuts, last = [], 0
    for c in found.tolist():
        while c - last > MOST:
            last += MOST
            cuts.append(last)
        if c - last >= LEAST and c < n:
            cuts.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        cuts.append(last)
    cuts.append(n)
    return cuts


_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@functools.lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """S, L, N, O of a sign, or nothing if a library of another age might see it in another way."""
    if c in _SPACE:
        return "S"
    now, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if old == "Cn" or (now[0] in "LN" or old[0] in "LN") and now[0] != old[0]:
        return ""
    return now[0] if now[0] in "LN" else "O"


def sure(a: str, b: str) -> bool:
    """Whether every scan splits between two signs that follow one another."""
    x, y = kind(a), kind(b)
    return bool(x and y) and x != "S" and x != y and not (a == "'" and y == "L")


#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A run of one kind in which a chunk may find no boundary.
RUN = 2048
_LONG = regex.compile(rf"\p{{L}}{{{RUN},}}|\p{{N}}{{{RUN},}}|[^\s\p{{L}}\p{{N}}]{{{RUN},}}|\s{{{RUN},}}")
_GAP = re.compile(rf"\s{{{RUN}}}")
_WORDS = regex.compile(PATTERN)


def has_long_word(text: str) -> bool:
    """Whether a run of RUN signs of one kind is in the text; most texts are told by their longest stretch without a blank."""
    if len(text) < RUN or max(map(len, text.split(" "))) < RUN and not _GAP.search(text):
        return False
    return bool(_LONG.search(text))


class Vocabulary:
    """A byte-level BPE tokenizer file: ranks of byte strings, added tokens.

    Raises ValueError for files whose encoding depends on more than PATTERN, merges and plain added tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or spec["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that look at their surroundings")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: ids do not follow the merges")
        self.ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


class ChunkEncoder:
    """Encodes texts as the given tokenizer file does; equal chunks are encoded once while the memo holds them.

    memo_chars bounds the code points of the memo; the chunks used least recently leave it.
    """

    def __init__(self, path: str, memo_chars: int = 4_000_000):
        import tiktoken

        vocabulary = Vocabulary(path)
        self.core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.added = vocabulary.added
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.bytes = {i: token for token, i in vocabulary.ranks.items()}
        self.length = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)]
        # most boundaries are where a token of white space begins after one that ends with a visible ASCII sign
        self.first, self.last = bytearray(len(self.length)), bytearray(len(self.length))
        for i, token in self.bytes.items():
            self.first[i] = token[0] in b" \t\n\x0b\x0c\r"
            self.last[i] = 33 <= token[-1] <= 126
        self.memo: OrderedDict[str, list[int]] = OrderedDict()
        self.room = memo_chars
        self.given: dict[str, np.ndarray] = {}  #: ids of chunks that were encoded elsewhere
        self.chunks = self.reused = 0

    def alone(self, piece: str) -> list[int]:
        """A chunk's ids, as if nothing stood beside it."""
        return self.core.encode_ordinary(piece)

    def _chunk(self, piece: str) -> list[int]:
        self.chunks += 1
        ids = self.given.get(piece)
        if ids is not None:
            self.reused += 1
            return ids.tolist()
        ids = self.memo.get(piece)
        if ids is not None:
            self.reused += 1
            self.memo.move_to_end(piece)
            return ids
        ids = array("I", self.alone(piece))
        self._keep(piece, ids)
        return ids

    def _keep(self, key: str, ids: array) -> None:
        self.memo[key] = ids
        self.room -= len(key)
        while self.room < 0:
            old, _ = self.memo.popitem(last=False)
            self.room += len(old)

    def encode(self, text: str) -> list[int]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _boundary(self, ids, data: bytes, a: int, b: int, step: int) -> int:
        """The first token from a to b (exclusive) that begins at a sure boundary; -1 if none does. data: of all ids' bytes."""
        if step * (b - a) <= 0:
            return -1
        first, last, length = self.first, self.last, self.length
        at = sum([length[i] for i in ids[:a]]) if step > 0 else len(data) - sum([length[i] for i in ids[a:]])
        for k in range(a, b, step):
            if first[ids[k]] and last[ids[k - 1]]:
                return k
            if data[at] & 0xC0 != 0x80:  # a sign begins here
                before = at - 1
                while data[before] & 0xC0 == 0x80:
                    before -= 1
                c = data[at]
                if sure(data[before:at].decode(), data[at : at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)].decode()):
                    return k
            at += length[ids[k]] if step > 0 else -length[ids[k - 1]]
        return -1

    def _bytes(self, ids) -> int:
        length = self.length
        return sum([length[i] for i in ids])

    def _plain(self, text: str) -> list[int]:
        if has_long_word(text):
            return self._with_long_words(text)
        return self._chunked(text)

    def _chunked(self, text: str) -> list[int]:
        """Chunks encoded alone, and their joins."""
        cuts = cut_points(text)
        if not cuts:
            return []
        pieces = [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        cur, first, data = self._chunk(pieces[0]), 0, pieces[0].encode("utf-8")  # its ids from `first` are to come
        out: list[int] = []
        for piece in pieces[1:]:
            nxt, more = self._chunk(piece), piece.encode("utf-8")
            k = self._boundary(cur, data, len(cur) - 1, max(first, 0), -1)
            k = first if k < 0 else k
            out += cur[first:k]
            tail = data[len(data) - self._bytes(cur[k:]) :]
            j = self._boundary(nxt, more, 1, len(nxt), 1)
            while j > 0:
                j2 = self._boundary(nxt, more, j + 1, len(nxt), 1)
                if j2 < 0:
                    j = -1
                    break
                own = list(nxt[j:j2])
                bridge = self.core.encode_ordinary((tail + more[: self._bytes(nxt[:j2])]).decode("utf-8"))
                if bridge[-len(own) :] == own:
                    out += bridge[: -len(own)]
                    break
                j = j2
            if j > 0:
                cur, first, data = nxt, j, more
            else:
                data = tail + more
                cur, first = self.core.encode_ordinary(data.decode("utf-8")), 0
        return out + list(cur[first:])

    def _with_long_words(self, text: str) -> list[int]:
        """A text with words of RUN signs or more: these alone, what stands between them in chunks.

        White space before a long word is taken word by word, since how it splits depends on what follows.
        """
        out: list[int] = []
        at, blanks = 0, []
        for m in _WORDS.finditer(text):
            word = m[0]
            if len(word) < RUN:
                if word.isspace():
                    blanks.append(m.start())
                else:
                    blanks.clear()
                continue
            cut = [*blanks, m.start()] if blanks else [m.start()]
            out += self._chunked(text[at : cut[0]])
            for a, b in zip(cut, cut[1:], strict=False):
                out += self.core._encode_single_piece(text[a:b])
            out += self._word(word)
            at = m.end()
            blanks.clear()
        return out + self._chunked(text[at:])

    def _fits(self, a: int, b: int) -> bool:
        return self.core._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def _word(self, word: str) -> list[int]:
        """One long word: its chunks, joined where neighbouring tokens fit."""
        cuts = cut_points(word)
        out: list[int] = []
        for a, b in zip([0, *cuts], cuts, strict=False):
            ids = self._chunk_word(word[a:b])
            if not out or self._fits(out[-1], ids[0]):
                out += ids
                continue
            n = 2
            while True:
                left, right = min(n, len(out)), min(n, len(ids))
                middle = self.core._encode_single_piece(b"".join(self.bytes[i] for i in (*out[-left:], *ids[:right])))
                before = left == len(out) or self._fits(out[-left - 1], middle[0])
                after = right == len(ids) or self._fits(middle[-1], ids[right])
                if before and after:
                    out[-left:] = [*middle, *ids[right:]]
                    break
                n *= 2
        return out

    def _chunk_word(self, piece: str) -> list[int]:
        """A chunk of a long word, without a look for words in it."""
        self.chunks += 1
        key = "\0" + piece
        ids = self.memo.get(key)
        if ids is not None:
            self.reused += 1
            self.memo.move_to_end(key)
            return ids
        ids = array("I", self.core._encode_single_piece(piece))
        self._keep(key, ids)
        return ids


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> tuple[ChunkEncoder, object]:
    """One encoder and decoder for each worker process, so that the memo outlives a batch."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path), load_tokenizer(path)


def sha256_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def chunk_hashes(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The chunks of texts that may be shared, and their hashes, two columns of 64 bits."""
    pieces = [t[a:b] for t in texts if t for c in [cut_points(t)] for a, b in zip([0, *c], c, strict=False) if b - a >= LEAST]
    raw = b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for p in pieces)
    return pieces, np.frombuffer(raw, "<u8").reshape(-1, 2)


class Reuse:
    """Arrays of the shared folder that a chunk's hash leads to; name: repeated (no values), or chunks (their ids)."""

    def __init__(self, folder: str, bits: int, name: str):
        self.folder, self.bits, self.name = folder, bits, name
        self.open: OrderedDict[int, tuple | None] = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"open": OrderedDict()}

    def _map(self, shard: int) -> tuple | None:
        if shard not in self.open:
            path = f"{self.folder}/{self.name}-{shard}"
            ids = mapped(f"{path}.ids", "<u4") if os.path.exists(f"{path}.ids") else np.empty(0, "<u4")
            self.open[shard] = (Shard(path), ids) if os.path.exists(path) else None
            if len(self.open) > MAPPED:
                self.open.popitem(last=False)
        self.open.move_to_end(shard)
        return self.open[shard]

    def find(self, hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(place, ids) of the hashes that are stored."""
        order = np.argsort(hashes[:, 0])
        q, out = hashes[order, 0], []
        for s, a, b in shards_of(q, self.bits):
            held = self._map(s)
            if held is None:
                continue
            columns = [np.zeros(b - a, np.uint64) for _ in range(3)]
            held[0].fill(q[a:b], self.bits, lambda r: list(r.T), columns)
            for k in np.flatnonzero((columns[0] == hashes[order[a:b], 1]) & (columns[0] != 0)).tolist():
                at, n = int(columns[1][k]), int(columns[2][k])
                out.append((int(order[a + k]), held[1][at : at + n]))
        return out


def _write_chunks(rows: DataFrame, folder: str, name: str, bits: int, path: str | None) -> None:
    """Writes a file for each shard of rows (h1, h2, and text where path names a tokenizer); a task holds one at a time."""
    columns = ["h1", "h2"] + (["text"] if path else [])

    def write(shard: int, h: np.ndarray, texts: list[str]) -> None:
        ids = [worker_encoder(path)[0].alone(t) for t in texts] if path else [()] * len(h)
        order = np.argsort(h[:, 0], kind="stable")
        order = order[np.concatenate(([True], h[order[1:], 0] != h[order[:-1], 0]))]  # of two with one key the first is kept
        sizes = np.array([len(ids[k]) for k in order], np.uint64)
        file = f"{folder}/{name}-{shard}"
        if path:
            temp = f"{folder}/.{name}-{shard}.{uuid.uuid4().hex}"
            with open(temp, "wb") as f:
                for k in order:
                    f.write(np.asarray(ids[k], "<u4").tobytes())
            os.replace(temp, f"{file}.ids")
        write_shard(file, h[order, 0], bits, [h[order, 1], np.cumsum(sizes, dtype=np.uint64) - sizes, sizes], exact=True)

    def run(batches):
        held, texts, shard = [], [], -1
        for batch in batches:
            for s, a, b, *t in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if s != shard:
                    if held:
                        write(shard, np.array(held, np.int64).view(np.uint64), texts)
                    held, texts, shard = [], [], s
                held.append((a, b))
                texts += t
        if held:
            write(shard, np.array(held, np.int64).view(np.uint64), texts)
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int").alias("shard")
    dealt = rows.select(shard, *columns).repartition(1 << bits, "shard").sortWithinPartitions("shard")
    arrow_map(dealt, run, "done boolean").agg(F.count("done")).collect()


def repeated_chunks(docs: DataFrame, path: str, folder: str, per_shard: int = 4000) -> Reuse | None:
    """Encodes each chunk that docs (text) hold more than once, and stores the ids; None if there is none.

    per_shard: about how many chunks a task holds.
    """
    spark, place = docs.sparkSession, local_path(folder)
    os.makedirs(place, exist_ok=True)

    def hashes(batches):
        for batch in slices(batches, 500):
            h = chunk_hashes(batch.column(0).to_pylist())[1].view(np.int64)
            yield pa.RecordBatch.from_pydict({"h1": h[:, 0].copy(), "h2": h[:, 1].copy()})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    many = arrow_map(texts, hashes, "h1 long, h2 long").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND h2 <> 0")
    many = materialise(many.select("h1", "h2"), folder, "many")
    n = many.count()
    if not n:
        return None
    bits = max(3, math.ceil(math.log2(n / per_shard)))
    _write_chunks(many, place, "repeated", bits, None)
    known = Reuse(place, bits, "repeated")

    def copies(batches):
        for batch in slices(batches, 500):
            pieces, h = chunk_hashes(batch.column(0).to_pylist())
            hit = sorted({(int(h[k, 0]), int(h[k, 1])): k for k, _ in known.find(h)}.values())
            at = h[hit].view(np.int64)
            yield pa.RecordBatch.from_pydict({"h1": at[:, 0].copy(), "h2": at[:, 1].copy(), "text": pa.array([pieces[k] for k in hit], pa.string())})

    one = arrow_map(texts, copies, "h1 long, h2 long, text string").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    _write_chunks(one, place, "chunks", bits, path)
    delete_folder(spark, f"{folder}/many")
    return Reuse(place, bits, "chunks")


def encode(docs: DataFrame, path: str, key: str = "doc_id", digests: bool = False, reuse: Reuse | None = None) -> DataFrame:
    """For each row of docs its key, `ids` and `decoded`, or with digests their SHA-256 and the number of tokens.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null keys are encoded like others;
    other columns are ignored. path: the tokenizer file, which every worker must be able to open. reuse: the corpus'
    repeated chunks (repeated_chunks).
    """
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> dict:
        encoder, decoder = worker_encoder(path)
        out: dict[str, list] = {"n": [], "ids": [], "decoded": []}
        texts = batch.column(1).to_pylist()
        if reuse is not None:
            pieces, h = chunk_hashes(texts)
            encoder.given = {pieces[k]: ids for k, ids in reuse.find(h)}
        for text in texts:
            ids = encoder.encode(text) if text else []
            decoded = decoder.decode(ids, skip_special_tokens=False)
            out["n"].append(len(ids))
            out["ids"].append(sha256_ids(ids) if digests else array("I", ids))
            out["decoded"].append(sha256_text(decoded) if digests else decoded)
        encoder.given = {}
        keys, decoded = batch.column(0), pa.array(out["decoded"], pa.string())
        if digests:
            return {key: keys, "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["ids"], pa.string()), "decoded_sha256": decoded}
        return {key: keys, "ids": pa.array(out["ids"], pa.list_(pa.int32())), "decoded": decoded}

    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_batches(docs.selectExpr(f"`{key}`", "CAST(text AS STRING) AS text"), run, f"`{key}` {kind}, {more}", rows=500)


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return encode(docs, path, digests=True, reuse=repeated_chunks(docs, path, shared_folder(spark)))
