"""The language model's counting and look-ups on plain arrays."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from tessella.llm import language_model as lm


def test_look_up_asks_once(tmp_path, monkeypatch):
    """A hash that stands many times among those asked for is looked up once, and so is a word's own record."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)) << np.uint64(1)
    for s, a, b in lm.shards_of(keys, 3):
        lm.write_shard(f"{tmp_path}/words-{s}", keys[a:b], 3, [np.arange(a + 1, b + 1, dtype=np.uint64), np.full(b - a, 2, np.uint64)], exact=True)
    asked, fill = [], lm.Shard.fill
    monkeypatch.setattr(lm.Shard, "fill", lambda self, keys, *more: (asked.append(len(keys)), fill(self, keys, *more))[1])
    which = np.random.default_rng(2).integers(0, 520, 20_000)
    h = np.append(keys, keys[:20] + np.uint64(1))[which]  # the last twenty are not stored
    number, count = lm.Model(str(tmp_path), 1, 3, 500, 1000).numbers(h)
    assert sum(asked) == len(np.unique(h))
    assert number.tolist() == [int(lm.NEVER) if i >= 500 else i + 1 for i in which]
    assert count.tolist() == [0 if i >= 500 else 2 for i in which]
    assert len(lm.Model(str(tmp_path), 1, 3, 500, 1000).numbers(h[:0])[0]) == 0


@pytest.mark.parametrize("order", [1, 3, 9])  # nine words of eight bits do not go into one number
def test_counts_of_grams(order):
    rng = np.random.default_rng(order)
    texts = [rng.integers(0, 200, n).tolist() for n in (1, 2, 400, 0, 300)]
    number = np.arange(7, 207, dtype=np.uint64)[::-1]
    at = np.cumsum([0, *map(len, texts)])
    words, n = lm.count_grams(number, np.array(sum(texts, []), np.int32), at, order, 4)
    got = list(zip(*(w.tolist() for w in words), strict=True))
    want = collections.Counter(tuple(([0] * (order - 1) + [int(number[x]) for x in t])[i : i + order]) for t in texts for i in range(len(t)))
    assert got == sorted(want) and dict(zip(got, n.tolist(), strict=True)) == want


@pytest.mark.parametrize("top", [40, 2**40])  # small numbers are joined to one, large ones are met by their hashes
def test_lower_order(top):
    rng = np.random.default_rng(5)
    grams = sorted({tuple(int(x) * (top // 40) for x in g) for g in rng.integers(0, 40, (3000, 3))})
    count = rng.choice([1, 1, 2, 3, 9], len(grams))
    words, fields = lm.lower_order([np.array(c, np.uint64) for c in zip(*grams, strict=True)], count.astype(np.uint64), 4)
    want: dict = collections.defaultdict(lambda: [0] * 5)
    for g, c in zip(grams, count.tolist(), strict=True):
        want[g[1:]][0] += 1
        want[g[:2]][1] += c
        want[g[:2]][1 + min(c, 3)] += 1
    got = list(zip(*(w.tolist() for w in words), strict=True))
    assert got == sorted(want)
    assert [list(f) for f in zip(*(x.tolist() for x in fields), strict=True)] == [want[g] for g in got]


def test_blocks_do_not_multiply(monkeypatch):
    """Chunks of few n-grams give one block a shard together, and what is packed is what was added."""
    monkeypatch.setattr(lm, "_BLOCK", 50)
    rng, blocks, want, got = np.random.default_rng(5), lm.Blocks(4), [], []
    for i in range(12):
        words = sorted((int(a), int(b)) for a, b in rng.integers(0, 1 << (8 + 3 * i), (40, 2)))
        blocks.add([np.array(c, np.uint64) for c in zip(*words, strict=True)], [np.full(40, i + 1, np.uint64)])
        want += [(*w, i + 1) for w in words]
        assert not blocks.full()
    rows = [r for some in blocks.rows() for r in some]
    assert len(rows) == len({s for s, _ in rows}) <= 16
    for s, block in rows:
        words, fields = lm.unpack_rows(block, 2)
        assert (lm.keys_of(words, 4) >> np.uint64(60) == s).all()
        got += [tuple(map(int, x)) for x in zip(*words, *fields, strict=True)]
    assert sorted(got) == sorted(want) and not list(blocks.rows())


def test_few_shards_of_words(spark, tmp_path):
    """Many shards of n-grams, few of words and of order 1, and all are found."""
    texts = ["a b c a b d", "b c a b", "", "d d d a b c"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many, few = (lm.train(docs, 3, f"file://{tmp_path}/{name}", shard_bytes=size) for name, size in (("many", 1), ("few", 1 << 20)))
    assert many.bits > many.word_bits == 3
    a, b = ({r["doc_id"]: (r["n_known"], round(r["score"], 9)) for r in lm.score(docs, m).collect()} for m in (many, few))
    assert a == b and all(n == len(texts[i].split()) + 1 for i, (n, _) in a.items())
