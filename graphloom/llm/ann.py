"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a sample (about `sample` vectors, chosen by a hash of their id; all, where there are no more) by
hyperplanes between two of its vectors until a leaf has at most `leaf` of them. So the forest grows with the table up to
a bound that depends on the parameters alone (20 trees of some 2000 leaves and 64 dimensions take 10 MB), and is
broadcast. Every vector is dealt to its leaf in each tree. A query walks all trees through one shared priority queue,
nearest margins first, until the leaves that it has taken hold effort * N ** growth vectors, and one leaf of each tree at
least; these are ranked again by the exact cosine. The exponent is below 1, so the share of the table that a query is
compared with falls with its size N; how much is needed for a recall of 0.9 was measured on vectors without structure.

Equal vectors are searched once and stand for their smallest ids, as many as can appear in a result; a leaf with more
than `block` distinct vectors is dealt out in blocks, so no task gets an unbounded group; small neighbouring leaves share
a group of about that many, so a query is sent less often than it has leaves.

Results at the edges: vectors that are null, zero, or hold null or non-finite components, and vectors of another length
than most of the sample, take no part; a null id takes no part; rows with equal id and vector count once; equal scores
go to the smaller vec_id; a query with fewer than k candidates gets all of them; an empty table gives no rows; further
columns are ignored. Components are compared as they come, float or double (other numbers as double), of any size.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from graphloom.llm.common import durable, mix


class Tree:
    """Inner nodes have a normal, an offset and two children; a child below zero is leaf -1 - child."""

    def __init__(self, rows: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.offsets, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(rows, leaf, rng)
        dims = rows.shape[1] if rows.ndim == 2 else 0
        self.normals = np.array(self.normals, np.float32).reshape(-1, dims)
        self.offsets, self.children = np.array(self.offsets, np.float32), np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(8):
                a, b = rows[rng.choice(len(rows), 2, replace=False)]
                normal = a - b
                if not (size := np.linalg.norm(normal)):
                    continue
                normal = normal / size
                side = rows @ normal
                offset = float(np.median(side)) if rng.random() < 0.5 else float(normal @ (a + b) / 2)
                right = side > offset
                if 0.1 * len(rows) <= right.sum() <= 0.9 * len(rows):
                    at = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.children.append([0, 0])
                    self.children[at] = [self._grow(rows[~right], leaf, rng), self._grow(rows[right], leaf, rng)]
                    return at
        self.leaves += 1
        return -self.leaves

    def assign(self, rows: np.ndarray) -> np.ndarray:
        at = np.full(len(rows), self.root, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", rows[inner], self.normals[node]) > self.offsets[node]
            at[inner] = self.children[node, right.astype(np.int64)]
        return -1 - at


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, each row times a power of two, which no cosine depends on, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]) if vectors.size else vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def probe(forest: list[Tree], margins: list[np.ndarray | None], sizes: list[np.ndarray], rows: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that the shared queue gives first, until they hold so many rows, one of each tree at least:
    each tree's own leaf, then by the largest margin on the wrong side."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and (held < rows or len(found) < len(forest)):
        worst, t, node = heapq.heappop(queue)
        own, children = margins[t], forest[t].children
        while node >= 0:
            m = own[node]
            near, far = (children[node, 1], children[node, 0]) if m > 0 else children[node]
            heapq.heappush(queue, (max(worst, abs(m)), t, int(far)))
            node = int(near)
        found.append((t, -1 - node))
        held += int(sizes[t][-1 - node])
    return found


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row in double precision, so the same pair has the same score wherever it is computed."""
    q, rows = scaled(q), scaled(rows)
    return (q * rows).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((rows * rows).sum(1)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def forest_of(distinct: DataFrame, n: int, trees: int, leaf: int, sample: int, seed: int) -> tuple[list[Tree], int]:
    """The forest, and the length of most vectors of the sample."""
    cut = int(min(1.0, sample / n) * (1 << 30))
    drawn = distinct.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < cut).select("rep", "embedding").toArrow().sort_by("rep")
    lengths = Counter(pa.compute.list_value_length(drawn["embedding"]).to_pylist())
    dims = min(lengths, key=lambda d: (-lengths[d], d)) if lengths else distinct.select(F.size("embedding")).first()[0]
    kept = drawn.filter(pa.compute.equal(pa.compute.list_value_length(drawn["embedding"]), dims))
    rows = unit(matrix(kept["embedding"])) if kept.num_rows else np.zeros((0, dims), np.float32)
    rng = np.random.default_rng(seed)
    return [Tree(rows, leaf, rng) for _ in range(trees)], dims


def search(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = 20, leaf: int = 48, effort: float = 9.3, growth: float = 0.72, sample: int = 65_536, block: int = 4096, seed: int = 11) -> DataFrame:
    """vectors(vec_id, embedding) to query_id, rank, vec_id, score for the queries with vec_id % every = 0, and compared,
    the number of distinct vectors (counted in each tree) that the query was compared with."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, compared long"
    kind = "float" if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType) else "double"
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long"), e.cast(f"array<{kind}>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda x: x != 0))

    # One row for each distinct vector, with the k + 1 smallest ids; the limit of a group is applied before the exchange.
    same = Window.partitionBy(F.xxhash64("embedding").alias("h"), "embedding").orderBy("vec_id")
    first = valid.dropDuplicates(["vec_id", "embedding"]).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    distinct = durable(first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    if not (n := distinct.count()):
        return spark.createDataFrame([], schema)
    made, dims = forest_of(distinct, n, trees, leaf, sample, seed)
    forest = spark.sparkContext.broadcast(made)
    distinct, valid = distinct.where(F.size("embedding") == dims), valid.where(F.size("embedding") == dims)
    asked = durable(valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates().join(distinct.select("embedding", "rep"), "embedding").select("query_id", "rep", "embedding"))

    def count(batches):
        for b in batches:
            for t, tree in enumerate(forest.value if b.num_rows else []):
                leaves, counts = np.unique(tree.assign(unit(matrix(b.column(0)))), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(leaves), t, np.int32)), pa.array(leaves.astype(np.int32)), pa.array(counts)], ["tree", "leaf", "n"])

    # As many rows as the forest has leaves, whatever the input.
    counted = distinct.select("embedding").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    sizes = [np.zeros(tree.leaves, np.int64) for tree in made]
    for r in counted:
        sizes[r.tree][r.leaf] = r.n
    held = spark.sparkContext.broadcast(sizes)
    rows_wanted = effort * n**growth
    # So many neighbouring leaves share a group that it has about `block` rows.
    together = max(1, block * sum(tree.leaves for tree in made) // (trees * n))

    def deal(batches):
        for b in batches:
            if b.num_rows:
                unit_rows, reps = unit(matrix(b.column(1))), mix(b.column(0).to_numpy().view(np.uint64))
                for t, tree in enumerate(forest.value):
                    leaves = tree.assign(unit_rows)
                    blocks = -(-held.value[t][leaves] // block)
                    part = np.where(blocks > 1, (reps % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64), 0)
                    group = np.where(blocks > 1, 2 * leaves, leaves // together * 2 + 1)
                    columns = [np.full(b.num_rows, t, np.int32), group.astype(np.int64), part.astype(np.int32), leaves.astype(np.int32)]
                    yield pa.record_batch([*map(pa.array, columns), b.column(0), b.column(1)], ["tree", "grp", "part", "leaf", "rep", "embedding"])

    def ask(batches):
        for whole in batches:
            for b in (whole.slice(s, 64) for s in range(0, whole.num_rows, 64)):
                qs = unit(matrix(b.column(1)))
                margins = [(qs @ tree.normals.T - tree.offsets).tolist() if len(tree.normals) else [None] * len(qs) for tree in forest.value]
                for i in range(len(qs)):
                    pairs = probe(forest.value, [m[i] for m in margins], held.value, rows_wanted)
                    groups: dict[tuple[int, int, int], list[int]] = {}
                    for t, x in pairs:
                        blocks = -(-int(held.value[t][x]) // block)
                        for part in range(max(1, blocks)):
                            groups.setdefault((t, 2 * x if blocks > 1 else x // together * 2 + 1, part), []).append(x)
                    t, group, part = zip(*groups, strict=True)
                    n_rows = sum(int(held.value[a][x]) for a, x in pairs)
                    at = pa.array([i] * len(groups))
                    yield pa.record_batch([pa.array(t, pa.int32()), pa.array(group, pa.int64()), pa.array(part, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(list(groups.values()), pa.list_(pa.int32())), pa.array([n_rows] * len(groups), pa.int64())], ["tree", "grp", "part", "asked", "q", "leaves", "compared"])

    dealt = distinct.select("rep", "embedding").mapInArrow(deal, f"tree int, grp long, part int, leaf int, rep long, embedding array<{kind}>")
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    questions = asked.select("rep", "embedding").dropDuplicates(["rep"]).repartition(spread, F.xxhash64("rep")).mapInArrow(ask, f"tree int, grp long, part int, asked long, q array<{kind}>, leaves array<int>, compared long")

    def rank(questions: pa.Table, leaf_rows: pa.Table) -> pa.Table:
        result = pa.schema([("asked", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("compared", pa.int64())])
        if not questions.num_rows or not leaf_rows.num_rows:
            return result.empty_table()
        leaves, out = leaf_rows["leaf"].to_numpy(), []
        order = np.argsort(leaves, kind="stable")
        rows, reps, leaves = matrix(leaf_rows["embedding"])[order], leaf_rows["rep"].to_numpy()[order], leaves[order]
        unit_rows, qs, asked_, n_rows = unit(rows), matrix(questions["q"]), questions["asked"].to_numpy(), questions["compared"].to_numpy()
        unit_qs, wanted = unit(qs), questions["leaves"].to_pylist()
        for s in range(0, len(qs), 256):
            near = np.full((len(qs[s : s + 256]), len(rows)), -2, np.float32)
            wants: dict[int, list[int]] = {}
            for i, own in enumerate(wanted[s : s + 256]):
                for x in own:
                    wants.setdefault(x, []).append(i)
            for x, who in wants.items():
                start, end = np.searchsorted(leaves, [x, x + 1])
                near[who, start:end] = unit_qs[s : s + 256][who] @ unit_rows[start:end].T
            n_top = min(len(rows), 4 * (k + 1))
            edge = np.partition(near, len(rows) - n_top, axis=1)[:, len(rows) - n_top]
            # Ties at the edge of the rough choice stay in.
            i, j = np.nonzero((near >= edge[:, None] - 1e-6) & (near > -2))
            score = cosines(qs[s + i], rows[j])
            order = np.lexsort((reps[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, score = i[place <= k], j[place <= k], score[place <= k]
            out.append((asked_[s + i], reps[j], score, n_rows[s + i]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=result)

    keys = ["tree", "grp", "part"]
    found = questions.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(rank, "asked long, rep long, score double, compared long")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
    found = found.dropDuplicates(["asked", "rep"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    # Back to the ids that each distinct vector stands for, without the query's own.
    found = found.join(distinct.select("rep", "ids"), "rep").select("asked", "score", "compared", F.explode("ids").alias("vec_id"))
    # A result over at most (k + 1) * (k + 1) candidates for each query.
    listed = found.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"), F.max("compared").alias("compared"))
    each = asked.select("query_id", F.col("rep").alias("asked")).join(listed, "asked")
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", "compared", F.posexplode(kept).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"), "compared")
