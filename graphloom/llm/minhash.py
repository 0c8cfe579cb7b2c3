"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketches (Dahlgaard, Knudsen and Thorup, 2017): in each of the first t rounds every shingle falls into a random bin of t
with a value of that round, and a bin keeps its least value; in t more rounds round t + i throws all shingles into bin i.
So every coordinate is filled, whatever the set's size, and the rounds end when all are. Coordinates are cut into bands;
documents that share a band are candidates, and each candidate pair is confirmed on the full shingle sets.

No group of candidates is expanded into all its pairs. Equal sets become one class. In each band's group every member is
compared with the most central one (whose bands are shared most); then components are joined. In groups that still have
members of several components, those outside the largest one are searched for links by an exact prefix filter: sets are
ordered by a rough frequency of their shingles, rare ones first, two sets at the threshold share one of their first
20 % + 1, and the places of the first shared ones bound the intersection. So copies that differ from the rest of their
group by their own edits meet nobody. The rough frequencies are counters of a fixed number of cells; they set the order
only, any order is exact. With t = 128 and bands of 4, a pair at the threshold of 0.8 shares no band with a probability
of 5e-8.

Results at the edges: a text that is null or without words has an empty set and links with nothing; rows with equal
doc_id are one document, linked by any of its texts, and each row is returned; a row without doc_id has no component
(null) and is kept; copies and ties are resolved to the smallest doc_id; an empty table gives no rows; further columns
are ignored; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, mix, text_slices
from graphloom.llm.words import hashed, shingles

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of a value that hold the round.
ROUND_BITS = 9
#: Cells of the rough frequencies of shingles.
CELLS = 1 << 20


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A sketch of t values for each set (none empty); t is a power of two, at most 256."""
    n, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), n)
    out = np.full((len(sets), t), EMPTY)
    cells = out.reshape(-1)
    for i in range(2 * t):
        x = mix(flat ^ mix(np.array([i + 1], np.uint64)))
        bins = (x & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = (np.uint64(i) << np.uint64(64 - ROUND_BITS)) | (x >> np.uint64(ROUND_BITS))
        at = of * t + bins
        open_ = cells[at] == EMPTY  # values of earlier rounds are smaller
        np.minimum.at(cells, at[open_], value[open_])
        still = (out == EMPTY).any(1)
        if not still.any():
            break
        left = still[of]
        flat, of = flat[left], of[left]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    n, t = sketch.shape
    parts = sketch.reshape(n, bands, t // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64)), (n, bands)).copy()
    for j in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, j]) + np.uint64(j)
    return key


SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def sketch(docs: DataFrame, words: int = 2, t: int = 128, bands: int = 32) -> DataFrame:
    """docs(doc_id, text) to the size and a 128-bit digest of each set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in text_slices(batches):
            flat, counts = hashed(texts, lower=True)
            ends = np.cumsum(counts)
            sets = [shingles(flat[e - c : e], words) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, digests = [None] * len(sets), [None] * len(sets)
            if full:
                made = sketches([sets[k] for k in full], t)
                for k, key in zip(full, band_keys(made, bands).view(np.int64), strict=True):
                    keys[k], digests[k] = key, xxhash.xxh3_128_digest(sets[k].tobytes())
            yield pa.record_batch([doc_ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs(a, b) of ids those whose sets have 100 * intersection >= percent * union. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[str, np.ndarray]] = {}
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                other, text = b.column(1)[k].as_py(), b.column(3)[k].as_py()
                if known.get(other, ("",))[0] != text:
                    if len(known) >= 64:
                        known.clear()
                    known[other] = (text, shingles(hashed([text], True)[0], words))
                x, y = shingles(hashed([b.column(2)[k].as_py()], True)[0], words), known[other][1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def splittable(one: DataFrame, key: str) -> DataFrame:
    """An aggregate by a whole number, made ready to be joined by it to many rows: the key is computed anew, so the join
    has an exchange of its own on both sides, and adaptive execution can split the part of a hot key. Without it, the
    join would take over the aggregate's partitions as they are."""
    return one.withColumn(key, F.expr(f"{key} ^ 0L"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (a, b) every node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while (root[x] != root[y]).any():
        one, other = root[x], root[y]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


def starred(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """edges(a, b) to edges (u, v) from the larger to the smaller node that join the same nodes: each task makes stars of
    its own edges, `most` at a time, so that a hub comes once from each task and long paths get short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
            if n >= most:
                yield made(held)
                held, n = [], 0
        if n:
            yield made(held)

    def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.record_batch(list(forest(*[np.concatenate(c) for c in zip(*held, strict=True)])), ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to node, component (the smallest node reachable), by alternating large and small stars.

    Each round is cut off in the checkpoint folder, and the rounds end when no node with a smaller neighbour has a second
    one. A hub's edges meet its minimum by an aggregate and a join that can be split.
    """
    edges = durable(starred(edges.select("a", "b")))
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("high")))
        if least.where("m < u AND m < high").isEmpty():
            return least.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        least = splittable(least.select("u", F.least("u", "m").alias("m")), "u")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = splittable(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        edges = durable(starred(small))


def prefix_pairs(placed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """placed(id, c, out) to the pairs (a, b) that may be links, by the prefix filter: of different components c, one of
    them marked out."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h = shingles(hashed([b.column(0)[k].as_py()], True)[0], words)
                yield pa.record_batch([pa.array((h % np.uint64(CELLS)).astype(np.int32))], ["cell"])

    own = texts.join(placed, "id")
    # At most CELLS rows, whatever the input.
    counted = own.select("text").mapInArrow(cells, "cell int").groupBy("cell").count().toArrow()
    rough = np.zeros(CELLS, np.uint32)
    rough[counted["cell"].to_numpy()] = np.minimum(counted["count"].to_numpy(), 0xFFFFFFFF)
    shared = placed.sparkSession.sparkContext.broadcast(rough)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h = shingles(hashed([b.column(3)[k].as_py()], True)[0], words)
                n = len(h)
                first = np.lexsort((h, shared.value[(h % np.uint64(CELLS)).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]
                at = pa.array(np.zeros(len(first), np.int64))
                yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(np.arange(len(first), dtype=np.int32)), pa.array(np.full(len(first), n, np.int32)), *[b.column(i).slice(k, 1).take(at) for i in range(3)]], ["h", "at", "n", "id", "c", "out"])

    first = durable(own.select("id", "c", "out", "text").mapInArrow(prefixes, "h long, at int, n int, id long, c long, out boolean"))
    left = first.where("out").select("h", *[F.col(x).alias(f"{x}_1") for x in ("at", "n", "id", "c")])
    most = F.least(F.col("n") - F.col("at"), F.col("n_1") - F.col("at_1"))
    right = first.withColumnRenamed("h", "h_2")
    found = left.join(right, (F.col("h") == F.col("h_2")) & (F.col("c") != F.col("c_1")) & (~F.col("out") | (F.col("id") < F.col("id_1"))) & (100 * most >= percent * (F.col("n") + F.col("n_1") - most)))
    return found.select(F.greatest("id", "id_1").alias("a"), F.least("id", "id_1").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, t: int = 128, bands: int = 32) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept, one row for each row of docs."""
    sketched = durable(sketch(docs, words, t, bands))
    named = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = durable(named.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep")))
    # One row of each class has its bands: those that hold its smallest doc_id.
    reps = named.join(classes.select("digest", "rep"), [named.digest == classes.digest, named.doc_id == classes.rep], "left_semi").dropDuplicates(["doc_id", "digest"])

    exploded = durable(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "n")
    members = durable(exploded.join(splittable(shared, "key"), "key"))
    central = members.groupBy("rep").agg(F.sum("n").alias("central"))
    ranked = members.join(central, "rep")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("central", -F.col("rep"), "rep")).alias("top")).select("key", F.col("top.rep").alias("leader"))
    stars = durable(members.join(splittable(leaders, "key"), "key").where("rep <> leader").select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct())
    # The texts of all candidates, once; every comparison reads them from here.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = durable(texts.join(central.select(F.col("rep").alias("id")), "id", "left_semi"))
    links = durable(verify(stars, texts, words, percent))
    joined = components(links)

    # Groups with members of several components.
    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    sizes = placed.groupBy("key", "c").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "c")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", F.col("top.c").alias("main"))
    placed = durable(placed.join(splittable(main, "key"), "key").groupBy(F.col("rep").alias("id"), "c").agg(F.max(F.col("c") != F.col("main")).alias("out")))
    across = durable(prefix_pairs(placed, texts, words, percent).join(stars, ["a", "b"], "left_anti"))
    further = durable(verify(across, texts, words, percent))
    of_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component_id"))
    if not further.isEmpty():
        # Further links join whole components.
        for side in ("a", "b"):
            of = splittable(joined.select(F.col("node").alias(side), F.col("component").alias("c")), side)
            further = further.join(of, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
        moved = splittable(components(further).select(F.col("node").alias("component_id"), F.col("component").alias("last")), "component_id")
        of_class = of_class.join(moved, "component_id", "left").select("d", F.coalesce("last", "component_id").alias("component_id"))

    out = sketched.join(of_class, (sketched.digest == of_class.d) & sketched.doc_id.isNotNull(), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
