"""Arcs of a graph, packed once in pieces: a round over all arcs sends values of nodes to the pieces, not rows of arcs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import durable, shared_folder

#: Nodes of a block, whose values meet the pieces that want them in one task.
BLOCK = 1 << 16
#: About so many arcs make a piece, which one task holds.
PIECE = 1 << 21
#: The arcs of a node with more than these are dealt over all pieces.
HUB = 1 << 17
#: How an arc lies: from a node to itself (one in each piece that has arcs of the node), up or down.
SELF, UP, DOWN = 0, 1, 2
_CELL = "kind int, piece int, block int, a binary, b binary, c binary, e binary"
_WANTED, _ARCS, _NODES, _VALUES = 0, 1, 2, 3


@dataclass(frozen=True)
class Arcs:
    """What a task has of its piece: ids, degrees (NaN: dealt over all pieces) and turns of its nodes; of each arc the place
    of its node, the two values x and y of its other end, its weight and how it lies."""

    ids: np.ndarray
    degrees: np.ndarray
    turns: np.ndarray
    node: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    way: np.ndarray


@dataclass(frozen=True)
class Packed:
    """cells(kind, piece, block, a, b, c, e): the nodes of a block that a piece wants, its arcs to them, its own nodes."""

    cells: DataFrame
    pieces: int
    blocks: int
    hubs: bool


def numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """(q, id) of distinct names q, ids from 0 in the order of the names, and how many there are."""
    placed = durable(names.orderBy("q").withColumn("at", F.monotonically_increasing_id()))
    # One row for each shuffle partition.
    counts = {r.p: r.n for r in placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = [0]
    for p in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(p, 0))
    first = F.element_at(F.lit(starts).cast("array<long>"), (F.shiftright("at", 33) + 1).cast("int"))
    return placed.select("q", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")), sum(counts.values())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["kind", "piece", "block", "a", "b", "c", "e"]
    types = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def packed(pairs: DataFrame, degree: DataFrame, n: int) -> Packed:
    """pairs(u, v, w), each once, and degree(q, d, n, turns) with the number n of a node's arcs; ids are below n."""
    size = degree.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("arcs"), F.max("n").alias("most")).first()
    pieces, blocks, hubs = max(1, -(-size.arcs // PIECE)), max(1, -(-n // BLOCK)), (size.most or 0) > HUB
    whole = F.pmod(F.xxhash64("q"), F.lit(pieces)).cast("int")
    both = pairs.where("u <> v").select(F.inline(F.array(F.struct(F.col("u").alias("q"), F.col("v").alias("v"), "w"), F.struct(F.col("v").alias("q"), F.col("u").alias("v"), "w"))))
    if hubs:
        # At most one row for each HUB arcs.
        both = both.join(F.broadcast(degree.where(F.col("n") > HUB).select("q", F.lit(True).alias("hub"))), "q", "left")
        at = F.when(F.col("hub"), F.pmod(F.xxhash64("q", "v"), F.lit(pieces)).cast("int")).otherwise(whole)
    else:
        at = whole
    rows = both.select(at.alias("piece"), "q", "v", "w", F.lit(0).alias("turns"))
    rows = rows.union(degree.where(F.col("n") <= HUB).select(whole.alias("piece"), "q", F.col("q").alias("v"), F.col("d").alias("w"), "turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        piece, q, v, w, turns = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        own = q == v
        ids, node = np.unique(q, return_inverse=True)
        degrees, turn = np.full(len(ids), np.nan), np.zeros(len(ids), np.int32)
        degrees[node[own]], turn[node[own]] = w[own], turns[own]
        keep = np.flatnonzero(~own)
        node, v, w = np.concatenate([node[keep], np.arange(len(ids))]), np.concatenate([v[keep], ids]), np.concatenate([w[keep], np.zeros(len(ids))])
        order = np.lexsort((v, node, v // BLOCK))
        node, v, w = node[order], v[order], w[order]
        way = np.where(v == ids[node], SELF, np.where(ids[node] < v, UP, DOWN)).astype(np.uint8)
        p = int(piece[0])
        yield _batch([(_NODES, p, -1, ids.tobytes(), degrees.tobytes(), turn.tobytes(), None)])
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(v // BLOCK) != 0, [True]]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            wanted, which = np.unique(v[s:e] % BLOCK, return_inverse=True)
            block = int(v[s] // BLOCK)
            yield _batch([
                (_WANTED, p, block, wanted.astype(np.uint16).tobytes(), None, None, None),
                (_ARCS, p, block, which.astype(np.int32).tobytes(), node[s:e].astype(np.int32).tobytes(), w[s:e].tobytes(), way[s:e].tobytes()),
            ])

    cells = rows.repartitionById(pieces, F.col("piece")).mapInArrow(run, _CELL)
    cells.write.partitionBy("kind").parquet(path := shared_folder(pairs.sparkSession))
    return Packed(pairs.sparkSession.read.schema(cells.schema).parquet(path), pieces, blocks, hubs)


def each_piece(p: Packed, values: DataFrame, f: Callable[[Arcs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f of each piece, with the values (q, x, y) of all ends of its arcs: x a long, y a long or a double."""
    kind = np.float64 if dict(values.dtypes)["y"] == "double" else np.int64
    empty = [F.lit(None).cast("binary").alias(x) for x in "abce"]

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, kind)
        for b in batches:
            piece, block, at = (b.column(i).to_numpy() for i in range(3))
            here = np.flatnonzero(piece < 0)
            x[at[here]], y[at[here]] = b.column(3).take(pa.array(here)).to_numpy(), b.column(4).take(pa.array(here)).to_numpy()
            for k in np.flatnonzero(piece >= 0):
                of = np.frombuffer(b.column(5)[int(k)].as_buffer(), np.uint16)
                yield _batch([(_VALUES, int(piece[k]), int(block[k]), x[of].tobytes(), y[of].tobytes(), None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, cells, own = {}, {}, None
        for b in batches:
            for k in range(b.num_rows):
                of = lambda i, t, b=b, k=k: np.frombuffer(b.column(i)[k].as_buffer(), t)
                match b.column(0)[k].as_py():
                    case 1:
                        cells[b.column(2)[k].as_py()] = of(3, np.int32), of(4, np.int32), of(5, np.float64), of(6, np.uint8)
                    case 2:
                        own = of(3, np.int64), of(4, np.float64), of(5, np.int32)
                    case 3:
                        found[b.column(2)[k].as_py()] = of(3, np.int64), of(4, kind)
        if own is not None:
            x, y = (np.concatenate([found[j][i][cells[j][0]] for j in sorted(cells)]) for i in range(2))
            node, w, way = (np.concatenate([cells[j][i] for j in sorted(cells)]) for i in range(1, 4))
            del found, cells
            yield from f(Arcs(*own, node.astype(np.int64), x, y, w, way))

    nodes = values.select(F.lit(-1).alias("piece"), F.expr(f"q div {BLOCK}").cast("int").alias("block"), (F.col("q") % BLOCK).cast("int").alias("at"), "x", "y", empty[0])
    asked = p.cells.where(F.col("kind") == _WANTED).select("piece", "block", F.lit(0).alias("at"), F.lit(0).cast("long").alias("x"), F.lit(0).cast(dict(values.dtypes)["y"]).alias("y"), "a")
    sent = nodes.union(asked).repartitionById(p.blocks, F.col("block")).sortWithinPartitions("piece").mapInArrow(wanted, _CELL)
    fixed = p.cells.where(F.col("kind").isin(_ARCS, _NODES)).select(*sent.columns)
    return sent.union(fixed).repartitionById(p.pieces, F.col("piece")).mapInArrow(run, schema)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys, equal ones as they came, and where in it each key begins."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))


def least_of_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (a, b) the nodes, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        one, other = root[x], root[y]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]
