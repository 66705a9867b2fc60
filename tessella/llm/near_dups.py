"""Near-duplicates by bottom-k sketches from one hash function.

A text's set holds the hashes of its word shingles; its sketch is the set's k least values.

* Equal sets become one node (the least id with that set), so copies cost one row each and no pair. Sets are told apart by
  128 bits of the 64-bit hashes of their shingles, so two that differ in one word could be taken for equal only where
  two of the corpus' words share their hash: at a chance of 3e-8 for a million different words, 0.03 for a thousand million.
* Of two sets with a Jaccard similarity of t or more the sketches share r values at least, but for a chance of about
  2e-8 (with k = 48, r = 22: 48 draws at 0.8 with under 22 hits); small sets are whole in their sketches, where r is
  exact. So, in any fixed order of values, the first k - r + 1 values of both share one, and the first k - r + m share m.
  The order is by how often values are retained (counted in a table of fixed size, so that it can go to every worker):
  inverted lists of rare values are short however common most words are.
* In each inverted list a few nodes, the leaders, meet the others: a group of near copies costs as many pairs as it has
  members. Of these pairs the sketches leave the plausible ones, full sets verify them, components join what is linked,
  and rounds with other leaders (those most like the rest) join more.
* In the end the nodes that by sizes and sketches (shortened to 16 bits a value, which can only add pairs) may have a
  partner that is still apart are joined exactly: a prefix join over their full sets, rare shingles first, with the bound
  on the overlap that the places of the first common shingle give. A text that differs too much from a group has so many
  shingles of its own in front that the bound leaves it without pairs, however large the group is. What is left is
  verified. No link that could join two components is missed, and no pairs are made within one.
* Texts are looked at again only for the nodes of plausible pairs. A Bloom filter of fixed size, which goes to every
  worker, holds the other texts back before the exchange; when it is too full to, all of them travel, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WORD, WordHasher, arrow_map, bloom, bloom_hits, delete_folder, filter_batches, lower_ascii, map_batches, materialise, mix64, shared_folder, signed, slices, table
from tessella.llm.graph import components

_SLOTS = 1 << 18  #: of the count table


@dataclass(frozen=True)
class Params:
    """shingle: words; percent: the similarity; k: of the sketch; shared: least values shared by sketches of large sets;
    rounds: with leaders; worth: values that the sketches of large sets share before a leader's pair is verified;
    brief: values of the shortened sketches, of which large sets share brief_shared at least."""

    shingle: int = 2
    percent: int = 80
    k: int = 48
    shared: int = 22
    rounds: int = 1
    worth: int = 34
    brief: int = 32
    brief_shared: int = 11

    def least_shared(self, n: int) -> int:
        """Values that the sketches of a set of n and of any partner share at least."""
        if n * 100 <= self.k * self.percent:  # no partner has more than k values either
            return max(1, -(-n * self.percent // 100))
        return self.shared


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of the shingles, ascending; fewer words than a shingle's are one as a whole."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        h = hashes[:n] + np.uint64(size)
        for i in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        h = np.sort(mix64(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_set(text: str, size: int) -> set:
    ws = WORD.findall(lower_ascii(text))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()


def _sketches(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, row, n, f1, f2, sketch): row tells texts of one id apart, f1 and f2 tell sets apart."""
    hasher = WordHasher(seed=9, lower=True)

    def run(batch: pa.RecordBatch) -> dict:
        n, f1, f2, sketch = [], [], [], []
        hashes, at = hasher.column(batch.column(2))
        for i in range(len(at) - 1):
            s = shingle_hashes(hashes[at[i] : at[i + 1]], p.shingle)
            n.append(len(s))
            if len(s):
                with np.errstate(over="ignore"):
                    f1.append(int(signed(mix64(s).sum(keepdims=True))[0]))
                    f2.append(int(signed(mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True))[0]))
                sketch.append(signed(s[: p.k]))
            else:
                f1.append(0)
                f2.append(0)
                sketch.append(np.empty(0, np.int64))
        return {
            "doc_id": batch.column(0), "row": batch.column(1), "n": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()),
            "f2": pa.array(f2, pa.int64()), "sketch": pa.array(sketch, pa.list_(pa.int64())),
        }

    return map_batches(docs.select("doc_id", "row", "text"), run, "doc_id long, row long, n long, f1 long, f2 long, sketch array<long>")


def _slots(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(3)).astype(np.int64) & (_SLOTS - 1)


def _counts(nodes: DataFrame) -> np.ndarray:
    """How many retained values fall into each slot: at most _SLOTS rows reach the driver, whatever the input."""

    def run(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(_slots(batch.column(0).flatten().to_numpy()), minlength=_SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return _table(arrow_map(nodes.select("sketch"), run, "slot long, n long"))


def _table(counted: DataFrame) -> np.ndarray:
    rows = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SLOTS, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _entries(nodes: DataFrame, counts: np.ndarray, p: Params) -> DataFrame:
    """(value, id, n): a row for each of a node's rarest values, so many that any partner shares one of them."""
    sent = nodes.sparkSession.sparkContext.broadcast(counts)

    def run(batch: pa.RecordBatch) -> dict:
        ids, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        node = np.repeat(np.arange(len(ids)), np.diff(offsets))
        values = values[offsets[0] : offsets[-1]]
        order = np.lexsort((values, sent.value[_slots(values)], node))
        rank = np.arange(len(values)) - (offsets[:-1] - offsets[0])[node]
        most = np.array([max(1, m - p.least_shared(int(n)) + 1) for m, n in zip(np.diff(offsets), ns, strict=True)], np.int64)
        order, node = order[rank < most[node]], node[rank < most[node]]
        return {"value": pa.array(values[order]), "id": pa.array(ids[node]), "n": pa.array(ns[node])}

    return map_batches(nodes.select("id", "n", "sketch"), run, "value long, id long, n long")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, n, sketch, text) of the nodes with the wanted ids."""
    wanted = materialise(wanted.distinct(), folder, f"{name}-ids")
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted))
    likely = filter_batches(docs.select(F.col("doc_id").alias("id"), "row", "text"), lambda batch: bloom_hits(sent.value, batch.column(0).to_numpy()))
    found = nodes.join(wanted, "id").select("id", "row", "n", "sketch")
    out = likely.join(found, ["id", "row"]).dropDuplicates(["id", "row"])
    return materialise(out.select("id", "n", "sketch", "text"), folder, name)


def _plausible(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that sizes and sketches make worth a look; what this leaves out meets again in the end."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    worth = (F.least("na", "nb") <= p.k) | (F.size(F.array_intersect("sa", "sb")) >= p.worth)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near(*map(F.col, ("na", "nb", "sa", "sb")), p) & worth).select("a", "b")


def _near(na, nb, sa, sb, p: Params):
    small = F.least(na, nb) * 100 <= F.lit(p.k * p.percent)
    both = F.size(F.array_intersect(sa, sb))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * p.percent) & (both >= F.when(small, F.ceil(F.least(F.greatest(na, nb), F.lit(p.k)) * (p.percent / 100) - 0.001)).otherwise(p.shared))


def _verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(a, b, similarity, linked) for the pairs that sizes and sketches allow; verified on the full sets."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"), F.col("text").alias(f"t{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent)
    def run(batches):
        held: dict[int, set] = {}

        def whole(key: int, text: str) -> set:
            if key not in held:
                if len(held) > 64:
                    held.clear()
                held[key] = shingle_set(text, p.shingle)
            return held[key]

        for batch in slices(batches, rows=500):
            rows = []
            for a, b, na, nb, sa, sb, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                in_a, in_b = set(sa), set(sb)
                union = sorted((in_a | in_b), key=lambda v: v & 0xFFFFFFFFFFFFFFFF)
                if na > p.k or nb > p.k:
                    union = union[: p.k]
                both = sum(v in in_a and v in in_b for v in union)
                if both < (p.shared if len(union) >= p.k else p.percent * len(union) // 100):
                    continue
                x, y = whole(a, ta), whole(b, tb)
                common = len(x & y)
                joint = len(x) + len(y) - common
                rows.append((a, b, common / joint, 100 * common >= p.percent * joint))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["a", "b", "similarity", "linked"])

    return arrow_map(joined.select("a", "b", "na", "nb", "sa", "sb", "ta", "tb"), run, "a long, b long, similarity double, linked boolean")


def _merge(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """labels (id, label) after links (a, b) between ids."""
    of = lambda s: labels.select(F.col("id").alias(s), F.col("label").alias(f"l{s}"))
    ends = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    comp = components(ends, folder, f"{name}-links").select(F.col("id").alias("label"), "component")
    return labels.join(comp, "label", "left").select("id", F.coalesce("component", "label").alias("label"))


def components_of_nodes(nodes: DataFrame, docs: DataFrame, folder: str, p: Params) -> DataFrame:
    """(id, label): the component of each node that has a link; nodes without one are left out.

    nodes: (id, row, n, sketch); docs: (doc_id, row, text).
    """
    entries = materialise(_entries(nodes, _counts(nodes), p), folder, "entries")
    # two nodes alone in a list whose sizes are too far apart have nothing to look for there
    leads = entries.groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most"))
    leads = leads.where(f"a < z AND (m > 2 OR least * 100 >= most * {p.percent})").select("value", F.array("a", "z").alias("leads"))
    leads = materialise(leads, folder, "leads")
    lists = materialise(entries.join(leads, "value").select("value", "id", "n", "leads"), folder, "lists")
    for name in ("entries", "leads"):
        delete_folder(nodes.sparkSession, f"{folder}/{name}")

    # leaders first; a pair of large sets that shares few lists with its leader waits for another leader or the end
    met = lists.select(F.explode("leads").alias("a"), F.col("id").alias("b"), "n").where("a <> b")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where(f"c >= 3 OR n * 100 <= {p.k * p.percent}")
    pairs = materialise(_plausible(met.select("a", "b"), nodes, p), folder, "pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), nodes, docs, folder, "texts")
    tried = materialise(_verify(pairs, texts, p), folder, "tried-0")
    labels = texts.select("id", F.col("id").alias("label"))
    labels = materialise(_scored(_merge(labels, tried.where("linked").select("a", "b"), folder, "round-0"), tried), folder, "labels-0")

    known = materialise(lists.join(texts.select("id"), "id").select("value", "id"), folder, "known")
    for turn in range(1, p.rounds + 1):
        held = known.join(labels, "id")
        best = held.groupBy("value").agg(
            F.max_by(F.struct("id", "label"), F.struct("score", -F.col("id"))).alias("lead"), F.min("label").alias("_lo"), F.max("label").alias("_hi")
        ).where("_lo < _hi").select("value", F.col("lead.id").alias("a"), F.col("lead.label").alias("la"))
        best = materialise(best, folder, f"best-{turn}")
        met = held.join(best, "value").where("label <> la").groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
        tried = materialise(_verify(met.select("a", "b"), texts, p), folder, f"tried-{turn}")
        merged = _merge(labels.select("id", "label"), tried.where("linked").select("a", "b"), folder, f"round-{turn}")
        labels = materialise(_scored(merged, tried, labels), folder, f"labels-{turn}")

    for name in ("texts", "texts-ids", "pairs", "known", *(f"{x}-{i}" for i in range(p.rounds + 1) for x in ("tried", "best"))):
        delete_folder(nodes.sparkSession, f"{folder}/{name}")

    # nodes that share a list with one that is still apart
    named = lists.join(labels.select("id", "label"), "id", "left").select("value", "id", "n", F.coalesce("label", "id").alias("label"))
    apart = named.groupBy("value").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("value")
    left = materialise(named.join(materialise(apart, folder, "values"), "value"), folder, "apart")
    short = F.transform(F.slice("sketch", 1, p.brief), lambda v: (v.bitwiseAND(0xFFFF) - 0x8000).cast("smallint"))
    rich = materialise(left.join(nodes.select("id", short.alias("short")), "id").select("value", "id", "label", "n", "short"), folder, "rich")
    for name in ("lists", "apart", "values"):
        delete_folder(nodes.sparkSession, f"{folder}/{name}")
    x, y = (rich.select(*[F.col(c).alias(f"{c}_{s}") for c in ("value", "id", "label", "n", "short")]) for s in "ab")
    # two values of a sketch may be one when shortened: more than three of 32 are, but for a chance of 1e-7
    both = F.size(F.array_intersect("short_a", "short_b")) + 3
    most = F.greatest("n_a", "n_b")
    near = (F.least("n_a", "n_b") * 100 >= most * p.percent) & (both * 100 >= F.when(most <= p.brief, most * p.percent).otherwise(100 * p.brief_shared))
    may = x.join(y, (F.col("value_a") == F.col("value_b")) & (F.col("label_a") != F.col("label_b")) & near, "left_semi").select(F.col("id_a").alias("id"))
    texts = _texts(may, nodes, docs, folder, "last-texts")
    sets = texts.join(labels.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "text")
    pairs = materialise(_apart_pairs(sets, p), folder, "last-pairs")
    links = materialise(_verify(pairs, texts, p).where("linked").select("a", "b"), folder, "last-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    every = materialise(labels.select("id", "label").unionByName(ends), folder, "labels")
    return _merge(every, links, folder, "last")


def _apart_pairs(sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of sets (id, label, text) with different labels that the prefix join over full sets leaves.

    Shingles are ordered by how often their slot of the count table is met, then by hash; any order would be right. A
    pair of sets of na and nb shares at least t * (na + nb) / (1 + t) shingles; at the first that both have, each has only
    what stands behind it left to share.
    """
    hasher = WordHasher(seed=9, lower=True)

    def each(batch: pa.RecordBatch):
        hashes, at = hasher.column(batch.column(batch.schema.names.index("text")))
        return [signed(shingle_hashes(hashes[at[i] : at[i + 1]], p.shingle)) for i in range(len(at) - 1)]

    def count(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in slices(batches):
            if batch.num_rows:
                total += np.bincount(_slots(np.concatenate(each(batch))), minlength=_SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    sent = sets.sparkSession.sparkContext.broadcast(_table(arrow_map(sets.select("text"), count, "slot long, n long")))

    def run(batch: pa.RecordBatch) -> dict:
        values, ranks, sizes, most = [], [], [], []
        for s in each(batch):
            keep = len(s) - -(-len(s) * p.percent // 100) + 1 if len(s) else 0
            values.append(s[np.lexsort((s, sent.value[_slots(s)]))[:keep]])
            ranks.append(np.arange(keep, dtype=np.int32))
            sizes.append(np.full(keep, len(s), np.int32))
            most.append(keep)
        row = np.repeat(np.arange(batch.num_rows), most)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return {
            "value": pa.array(join(values, np.int64)), "id": batch.column(0).take(pa.array(row)), "label": batch.column(1).take(pa.array(row)),
            "n": pa.array(join(sizes, np.int32)), "rank": pa.array(join(ranks, np.int32)),
        }

    entries = map_batches(sets.select("id", "label", "text"), run, "value long, id long, label long, n int, rank int")
    x, y = (entries.select(*[F.col(c).alias(f"{c}_{s}") for c in ("value", "id", "label", "n", "rank")]) for s in "ab")
    left = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))
    enough = left * (100 + p.percent) >= (F.col("n_a") + F.col("n_b")) * p.percent
    near = (F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent) & enough
    return x.join(y, (F.col("value_a") == F.col("value_b")) & near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _scored(labels: DataFrame, tried: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """labels with score: how like a node is to the leaders that it has met; the highest so far."""
    seen = tried.groupBy(F.col("b").alias("id")).agg(F.avg("similarity").alias("new"))
    out = labels.join(seen, "id", "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
    if before is None:
        return out.withColumnRenamed("new", "score")
    return out.join(before.select("id", "score"), "id").select("id", "label", F.greatest("new", "score").alias("score"))


def near_duplicates(docs: DataFrame, p: Params = Params(), folder: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts and texts without words have no shingles and stand alone, as do rows with a null doc_id (their
    component_id is null and they are kept). Rows of one doc_id are rows of one document: each is linked by its own text,
    and all that bear the component's id are kept. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    sketches = materialise(_sketches(rows, p), folder, "sketches")
    usable = sketches.where("doc_id IS NOT NULL AND n > 0")
    nodes = usable.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "row")).alias("_least"), F.first("sketch").alias("sketch"))
    narrow = materialise(sketches.select("doc_id", "n", "f1", "f2"), folder, "narrow")
    nodes = materialise(nodes.select("f1", "f2", "n", F.col("_least.doc_id").alias("id"), F.col("_least.row").alias("row"), "sketch"), folder, "nodes")
    delete_folder(spark, f"{folder}/sketches")
    labels = components_of_nodes(nodes, rows.where("doc_id IS NOT NULL"), folder, p)
    named = nodes.select("f1", "f2", "n", "id").join(labels, "id", "left").select("f1", "f2", "n", F.coalesce("label", "id").alias("component_id"))
    joined = narrow.where("doc_id IS NOT NULL AND n > 0").join(named, ["f1", "f2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = narrow.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, p: Params = Params(shingle=5), folder: str | None = None) -> DataFrame:
    """The rows of docs that stay when one document of each component does, with all their columns."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    gone = materialise(near_duplicates(docs, p, folder).where("NOT kept").select("doc_id").distinct(), folder, "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_bottomk_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
