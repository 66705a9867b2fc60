"""Jaccard join of word n-gram sets: subsets of small sets, inverted lists of large ones.

Sets meet only where they share something rare, so shingles are put in an order first: rare ones in front (by a count
table of fixed size), ties by hash. A set of n shares at least c = ceil(t n) with any partner, hence

* a *light* set lists every pair of its first n - c + 2 shingles: partners that are both light share one such subset;
* a *heavy* set lists each of its first n - c + 1 shingles alone, and so do the light sets that are large enough to be
  a heavy one's partner: a pair with a heavy set is found by scanning an inverted list.

Sets up to the boundary are light. It is where the two costs, summed by size over all sets, are least in total: the
subsets that light sets list, against the list entries of heavy ones and what each scan is expected to meet.

* Equal sets become one node first (the least id with that set, told apart by 128 bits of the hashes of their shingles).
* What two nodes list together makes them a candidate if sizes, the places of what they share, and parity signatures
  allow a link. A signature has a bit for each residue of the hashes modulo 1024, set if the set holds an odd number of
  such shingles; every bit that differs is a shingle that only one of both has, so a signature never costs a link.
* In each list a leader meets the rest, so a group of near copies costs as many pairs as it has members. Candidates are
  looked at with longer signatures, then verified on the full sets of 64-bit hashes of their shingles, and linked ones joined
  into components; rounds with other leaders join more.
* Then the lists that still hold several components are joined in blocks: a long list is cut into parts of at most a few
  hundred nodes, every two parts meet under a key of their own, and only candidates from different components leave the
  join. No link between components is missed, no task holds a whole list, and within a component nothing is paired.

Sets are compared by 64-bit hashes throughout, so a result could be wrong only where two words of the corpus share their
hash: at a chance of 3e-8 for a million different words, 0.03 for a thousand million.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WordHasher, arrow_map, bloom, bloom_hits, delete_folder, map_batches, materialise, mix64, shared_folder, signed, slices, table
from tessella.llm.graph import components
from tessella.llm.near_dups import shingle_hashes

_SLOTS = 1 << 20  #: of the count table
_BITS = 1024  #: of a signature
_WIDE_BITS = 8192  #: of the longer one
_SIGNATURE = [f"g{i}" for i in range(_BITS // 64)]
_SEED = 12


@dataclass(frozen=True)
class Params:
    """shingle: words; percent: the similarity; part: nodes of a list that meet others in one task; boundary: the largest
    light set (None: by cost); rounds: with leaders."""

    shingle: int = 4
    percent: int = 85
    part: int = 400
    boundary: int | None = None
    rounds: int = 2

    def own_least(self, n: int) -> int:
        """Shingles that a set of n shares at least with any partner."""
        return -(-n * self.percent // 100)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("text"))


_MARK = -1  #: in n: a row of the count table, slot and count in f1 and f2


def _sets(rows: DataFrame, p: Params) -> DataFrame:
    """(doc_id, row, n, f1, f2): f1 and f2 tell sets apart. Each task adds, as rows of the count table, what stands out
    among its shingles: the slots with over 4, and over four times what a slot of the task has on average."""
    hasher = WordHasher(seed=_SEED, lower=True)

    def run(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in slices(batches):
            hashes, at = hasher.column(batch.column(2))
            n, f1, f2, every = *(np.zeros(batch.num_rows, np.int64) for _ in range(3)), [np.empty(0, np.uint64)]
            for i in range(batch.num_rows):
                s = shingle_hashes(hashes[at[i] : at[i + 1]], p.shingle)
                every.append(s)
                n[i] = len(s)
                with np.errstate(over="ignore"):
                    f1[i] = signed(mix64(s).sum(keepdims=True, dtype=np.uint64))[0]
                    f2[i] = signed(mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True, dtype=np.uint64))[0]
            total += np.bincount(_slots(np.concatenate(every)), minlength=_SLOTS)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row": batch.column(1), "n": n, "f1": f1, "f2": f2})
        slot = np.flatnonzero(total > max(4, 4 * total.mean()))
        none = pa.nulls(len(slot), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": none, "row": none, "n": np.full(len(slot), _MARK), "f1": slot, "f2": total[slot]})

    return arrow_map(rows.select("doc_id", "row", "text"), run, "doc_id long, row long, n long, f1 long, f2 long")


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(7)).astype(np.int64) & (_SLOTS - 1)


def _counts(sets: DataFrame) -> np.ndarray:
    """The count table: at most _SLOTS rows reach the driver, whatever the input. It only puts shingles in order and
    prices the boundary; any other table would give the same result."""
    found = sets.where(F.col("n") == _MARK).groupBy("f1").agg(F.sum("f2").alias("count")).toPandas()
    out = np.zeros(_SLOTS, np.int64)
    out[found["f1"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    return out


def _fronts(rows: DataFrame, counts: np.ndarray, p: Params) -> DataFrame:
    """(id, row, n, front, scan, signature): the set's first n - c + 2 shingles in order, and what scans of their lists
    may meet. Sets too small for a partner other than their copies have no row."""
    hasher = WordHasher(seed=_SEED, lower=True)
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batch: pa.RecordBatch) -> dict | None:
        hashes, at = hasher.column(batch.column(2))
        keep, n, front, scan = [], [], [], []
        bits = np.zeros((batch.num_rows, _BITS), np.uint8)
        for i in range(batch.num_rows):
            s = shingle_hashes(hashes[at[i] : at[i + 1]], p.shingle)
            if 100 * len(s) < p.percent * (len(s) + 1):
                continue
            held = sent.value[_slots(s)]
            order = np.lexsort((s, held))[: len(s) - p.own_least(len(s)) + 2]
            bits[len(keep)] = np.bincount((s & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1
            keep.append(i)
            n.append(len(s))
            front.append(signed(s[order]))
            scan.append(float(len(order) + held[order].sum()))
        if not keep:
            return None
        at = pa.array(keep)
        words = np.packbits(bits[: len(keep)], axis=1).view(np.int64)
        return {
            "id": batch.column(0).take(at), "row": batch.column(1).take(at), "n": pa.array(n, pa.int64()), "front": pa.array(front, pa.list_(pa.int64())), "scan": scan,
        } | {g: words[:, i].copy() for i, g in enumerate(_SIGNATURE)}

    kinds = ", ".join(f"{g} long" for g in _SIGNATURE)
    return map_batches(rows.select("doc_id", "row", "text"), run, f"id long, row long, n long, front array<long>, scan double, {kinds}", rows=1000)


def boundary(costs: list[tuple[int, float, float]]) -> int:
    """The largest light size, given (size, cost if light, cost if heavy) of the sizes: the least total, the smallest on ties."""
    light, heavy = 0.0, sum(h for _, _, h in costs)
    best, at = heavy, 0
    for size, as_light, as_heavy in sorted(costs):
        light, heavy = light + as_light, heavy - as_heavy
        if light + heavy < best:
            best, at = light + heavy, size
    return at


def _boundary(fronts: DataFrame, p: Params) -> int:
    """Costs by size class (sizes are exact up to 64 and an eighth apart beyond), so a few hundred rows reach the driver."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) - 3)
    size = F.when(F.col("n") <= 64, F.col("n").cast("double")).otherwise((F.floor(F.col("n") / step) + 1) * step - 1).cast("long")
    most = F.size("front")
    costs = fronts.groupBy(size.alias("size")).agg(F.sum((most * (most - 1) / 2).cast("double")).alias("light"), F.sum("scan").alias("heavy"))
    return boundary([tuple(r) for r in costs.select("size", "light", "heavy").collect()])


def _entries(fronts: DataFrame, light: int, p: Params, held: np.ndarray | None = None) -> DataFrame:
    """(key, id, n, left): what nodes list; left is what a set has from the first shared shingle on. held: a Bloom filter of
    the keys that are asked for."""
    sent = fronts.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch) -> dict | None:
        ids, ns, keys, left, row = batch.column(0), batch.column(1).to_numpy(), [], [], []
        offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy().view(np.uint64)
        for i, n in enumerate(ns.tolist()):
            s = values[offsets[i] : offsets[i + 1]]
            least = p.own_least(n)
            if n <= light and least > 1:
                a, b = np.triu_indices(len(s), 1)
                x, y = np.minimum(s[a], s[b]), np.maximum(s[a], s[b])
                with np.errstate(over="ignore"):
                    keys.append(mix64(x * np.uint64(0x9E3779B97F4A7C15) + y))
                left.append(np.minimum(n - a, n - b + 1))
                row.append(np.full(len(a), i))
            if n * 100 > light * p.percent or n * p.percent**2 < 2 * 100**2:  # the latter: a partner may share a single shingle
                keys.append(s[: n - least + 1])
                left.append(n - np.arange(n - least + 1))
                row.append(np.full(n - least + 1, i))
        if not keys:
            return None
        at, key, rest = np.concatenate(row), signed(np.concatenate(keys)), np.concatenate(left)
        if sent.value is not None:
            asked = bloom_hits(sent.value, key)
            at, key, rest = at[asked], key[asked], rest[asked]
        return {"key": key, "id": ids.take(pa.array(at)), "n": ns[at], "left": rest}

    return map_batches(fronts.select("id", "n", "front"), run, "key long, id long, n long, left long", rows=500)


def _whole_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, folder: str, name: str, p: Params) -> DataFrame:
    """(id, n, wide, hashes) of the nodes with the wanted ids: the longer signature, and the whole set in ascending order. A
    Bloom filter of fixed size holds other texts back before the exchange."""
    hasher = WordHasher(seed=_SEED, lower=True)
    wanted = materialise(wanted.distinct(), folder, f"{name}-ids")
    sent = rows.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batch: pa.RecordBatch) -> dict:
        likely = batch.filter(pa.array(bloom_hits(sent.value, batch.column(0).to_numpy())))
        hashes, at = hasher.column(likely.column(2))
        sets = [shingle_hashes(hashes[at[i] : at[i + 1]], p.shingle) for i in range(likely.num_rows)]
        wide = [np.packbits(np.bincount((s & np.uint64(_WIDE_BITS - 1)).astype(np.int64), minlength=_WIDE_BITS).astype(np.uint8) & 1).tobytes() for s in sets]
        return {"id": likely.column(0), "row": likely.column(1), "n": pa.array(map(len, sets), pa.int64()), "wide": pa.array(wide, pa.binary()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())}

    made = map_batches(rows.select(F.col("doc_id").alias("id"), "row", "text"), run, "id long, row long, n long, wide binary, hashes binary")
    out = made.join(nodes.join(wanted, "id").select("id", "row"), ["id", "row"]).dropDuplicates(["id", "row"])
    return materialise(out.select("id", "n", "wide", "hashes"), folder, name)


def _side(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in columns])


def _sizes_fit(p: Params):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent


def _places_fit(p: Params):
    """From the first shingle that both have on, each has as many as a link needs."""
    return F.least("left_a", "left_b") * (100 + p.percent) >= (F.col("n_a") + F.col("n_b")) * p.percent


def _signatures_fit(p: Params):
    """Bits that differ are shingles of one set alone; a link leaves room for (1 - t) / (1 + t) of both sizes."""
    apart = sum((F.bit_count(F.col(f"{g}_a").bitwiseXOR(F.col(f"{g}_b"))) for g in _SIGNATURE), F.lit(0))
    return apart * (100 + p.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - p.percent)


def _verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, folder: str, name: str, p: Params) -> DataFrame:
    """The pairs (a, b) that are linked: the longer signatures first, then the full sets of what these leave."""
    sets = _whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), nodes, rows, folder, f"{name}-sets", p)

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        out = pairs.select("a", "b").join(_side(sets, "a", "id", "n", column), F.col("a") == F.col("id_a")).join(_side(sets, "b", "id", "n", column), F.col("b") == F.col("id_b"))
        return out.select("a", "b", "n_a", "n_b", f"{column}_a", f"{column}_b")

    def near(batches):
        for batch in slices(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart * (100 + p.percent) <= both * (100 - p.percent)))

    def linked(batches):
        for batch in slices(batches, nbytes=8 << 20):
            hits = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                hits.append(100 * common >= p.percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    likely = materialise(arrow_map(beside(pairs, "wide"), near, "a long, b long"), folder, f"{name}-likely")
    links = materialise(arrow_map(beside(likely, "hashes"), linked, "a long, b long"), folder, name)
    for step in ("sets", "sets-ids", "likely"):
        delete_folder(rows.sparkSession, f"{folder}/{name}-{step}")
    return links


def _merge(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """labels (id, label) after links (a, b); ids without a label are their own."""
    if links.isEmpty():
        return labels
    of = lambda s: labels.select(F.col("id").alias(s), F.col("label").alias(f"l{s}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    comp = components(ends, folder, name)
    moved = labels.join(comp.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("component", "label").alias("label"))
    fresh = comp.join(labels, "id", "left_anti").select("id", F.col("component").alias("label"))
    return materialise(moved.unionByName(fresh).distinct(), folder, f"{name}-labels")


def _blocked_pairs(lists: DataFrame, fronts: DataFrame, folder: str, p: Params) -> DataFrame:
    """The candidates (a, b) from different components that lists (key, id, n, left, label) hold, long lists in parts."""
    rich = lists.join(fronts.select("id", *_SIGNATURE), "id")
    parts = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / p.part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cut = rich.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    cut = materialise(cut.select("key", "lo", "hi", "own", "id", "n", "left", "label", *_SIGNATURE), folder, "parts")
    columns = ("key", "lo", "hi", "own", "id", "n", "left", "label", *_SIGNATURE)
    a, b = _side(cut, "a", *columns), _side(cut, "b", *columns)
    meet = (F.col("key_a") == F.col("key_b")) & (F.col("lo_a") == F.col("lo_b")) & (F.col("hi_a") == F.col("hi_b"))
    once = (F.col("own_a") == F.col("lo_a")) & (F.col("own_b") == F.col("hi_b")) & ((F.col("lo_a") < F.col("hi_a")) | (F.col("id_a") < F.col("id_b")))
    fit = (F.col("label_a") != F.col("label_b")) & _sizes_fit(p) & _places_fit(p) & _signatures_fit(p)
    return a.join(b, meet & once & fit).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def components_of_nodes(nodes: DataFrame, rows: DataFrame, counts: np.ndarray, folder: str, p: Params) -> DataFrame:
    """(id, label): the component of each node (id, row, n) that has a link; nodes without one may be left out."""
    spark = rows.sparkSession
    fronts = _fronts(rows, counts, p).join(nodes.select("id", "row"), ["id", "row"]).dropDuplicates(["id", "row"])
    fronts = materialise(fronts.drop("row"), folder, "fronts")
    light = p.boundary if p.boundary is not None else _boundary(fronts, p)
    entries = _entries(fronts, light, p)

    # lists of two nodes or more; keys alone are counted, and only what may be in such a list is exchanged as a whole
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    shared = materialise(shared, folder, "shared")
    entries = _entries(fronts, light, p, bloom(shared))
    lists = materialise(entries.join(shared, "key").select("key", "id", "n", "left"), folder, "lists")
    delete_folder(spark, f"{folder}/shared")

    labels = spark.createDataFrame([], "id long, label long")
    for turn in range(p.rounds):
        # the leader of a list is of its least or its greatest component; a pair that leaders miss is found in the end
        named = _named(lists, labels)
        lead = (F.min if turn % 2 == 0 else F.max)(F.struct("label", "id")).alias("lead")
        leads = named.groupBy("key").agg(lead, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        leads = materialise(leads.select("key", F.col("lead.id").alias("a"), F.col("lead.label").alias("la")), folder, f"leads-{turn}")
        met = named.join(leads, "key").where("label <> la").groupBy("a", F.col("id").alias("b")).agg(F.max("left").alias("left_b"))
        pairs = met.join(_side(fronts, "a", "id", "n", *_SIGNATURE), F.col("a") == F.col("id_a")).join(_side(fronts, "b", "id", "n", *_SIGNATURE), F.col("b") == F.col("id_b"))
        enough = F.col("left_b") * (100 + p.percent) >= (F.col("n_a") + F.col("n_b")) * p.percent
        pairs = materialise(pairs.where(_sizes_fit(p) & enough & _signatures_fit(p)).select("a", "b"), folder, f"pairs-{turn}")
        labels = _merge(labels, _verify(pairs, nodes, rows, folder, f"links-{turn}", p), folder, f"round-{turn}")

    # lists that still hold several components
    named = _named(lists, labels)
    apart = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = materialise(named.join(apart, "key"), folder, "apart")
    delete_folder(spark, f"{folder}/lists")
    pairs = materialise(_blocked_pairs(left, fronts, folder, p), folder, "last-pairs")
    for name in ("apart", "parts"):
        delete_folder(spark, f"{folder}/{name}")
    return _merge(labels, _verify(pairs, nodes, rows, folder, "last-links", p), folder, "last")


def _named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with the component that each node belongs to so far."""
    return lists.join(labels, "id", "left").select("key", "id", "n", "left", F.coalesce("label", "id").alias("label"))


def set_join(docs: DataFrame, p: Params = Params(), folder: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Null and empty texts and texts without words have no shingles and stand alone, as do rows with a null doc_id (their
    component_id is null). Rows of one doc_id are linked by each of their texts and share the id's component. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = _rows(docs)
    sets = materialise(_sets(rows, p), folder, "sets")
    usable = sets.where("doc_id IS NOT NULL AND n > 0")
    nodes = usable.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "row")).alias("_least"))
    nodes = materialise(nodes.select("f1", "f2", "n", F.col("_least.doc_id").alias("id"), F.col("_least.row").alias("row")), folder, "nodes")
    labels = components_of_nodes(nodes, rows.where("doc_id IS NOT NULL"), _counts(sets), folder, p)
    named = nodes.join(labels, "id", "left").select("f1", "f2", "n", F.coalesce("label", "id").alias("component_id"))
    joined = usable.join(named, ["f1", "f2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 OR (doc_id IS NULL AND n > 0)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def op12_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join(table(spark, sf_dir, "documents"))
