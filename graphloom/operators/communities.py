"""Communities: grouping by directory, by modularity, label propagation, naming and reassignment of tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.text import split_name, to_slug
from graphloom.graph import Graph, durable, large, lookup
from graphloom.operators import blocks
from graphloom.operators.analytics import cohesion

#: Words that name nothing (fixed values).
STOP_WORDS = frozenset("get set is has test init main run do make new create update delete self this the and for with from to of in on by".split())
#: Different halves of the nodes that rounds take turns with, as bits of a number.
HALVES = 31
OFFERED = ["q", "d", "turns", "label", "new", "inside", "held", "stays"]


def path_at_depth(path, depth: int):
    """The first `depth` directories of a path (of those it has)."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.array_join(F.slice(dirs, 1, depth), "/")


def common_prefix_depth(graph: Graph) -> int:
    """How many leading directories all files share: those of the smallest and the largest path."""
    ends = graph.nodes.agg(F.min("file_path").alias("a"), F.max("file_path").alias("b")).first()
    a, b = ((x or "").split("/")[:-1] for x in (ends.a, ends.b))
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def directory_groups(graph: Graph, depth: int, min_size: int = 2) -> DataFrame:
    """grouping, n of the directories at a depth that have min_size nodes."""
    return graph.nodes.where("kind <> 'File'").groupBy(path_at_depth(F.col("file_path"), depth).alias("grouping")).agg(F.count("*").alias("n")).where(F.col("n") >= min_size)


def detect_by_directory(graph: Graph, min_size: int = 2, wanted: int = 10, deepest: int = 8) -> DataFrame:
    """Nodes with the directory that is their community: one level below the shared prefix, deeper until ten qualify."""
    start = common_prefix_depth(graph) + 1
    best = start
    for depth in range(start, start + deepest):
        n = directory_groups(graph, depth, min_size).count()
        if depth > start and n <= directory_groups(graph, best, min_size).count():
            break
        best = depth
        if n >= wanted:
            break
    groups = directory_groups(graph, best, min_size)
    return graph.nodes.where("kind <> 'File'").withColumn("grouping", path_at_depth(F.col("file_path"), best)).join(groups, "grouping", "left_semi").withColumn("community", F.xxhash64("grouping"))


def weight() -> Column:
    """The weight of an edge by its kind."""
    return lookup(S.COMMUNITY_WEIGHT, F.col("kind"), S.COMMUNITY_DEFAULT_WEIGHT)


def undirected_weights(graph: Graph) -> DataFrame:
    """u, v (u < v), w: one edge for each pair, with its largest weight."""
    return graph.edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), weight().alias("w")).where("u <> v").groupBy("u", "v").agg(F.max("w").alias("w"))


def label_propagation(graph: Graph, rounds: int = 5) -> DataFrame:
    """qualified_name, label: each round a node takes the label with the largest weight around it; ties to the smallest.
    Odd and even rounds move different halves of the nodes, so pairs don't swap labels forever."""
    known = graph.nodes.where("kind <> 'File'").select("qualified_name")
    pairs = undirected_weights(graph)
    arcs = pairs.union(pairs.select("v", "u", "w"))
    arcs = durable(arcs.join(known.toDF("u"), "u", "left_semi").join(known.toDF("v"), "v", "left_semi").select("u", "v", "w"))
    labels = durable(known.withColumn("label", F.col("qualified_name")))
    for r in range(rounds):
        votes = arcs.join(labels.toDF("v", "label"), "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("u").agg(F.max(F.struct(F.round("w", 6).alias("w"), F.xxhash64("label").alias("h"), "label")).alias("top")).select(F.col("u").alias("qualified_name"), F.col("top.label").alias("best"))
        moves = F.pmod(F.xxhash64("qualified_name"), F.lit(2)) == r % 2
        labels = durable(labels.join(best, "qualified_name", "left").select("qualified_name", F.when(moves, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label")))
    return labels


def resolution_for(n: int) -> float:
    """Coarser communities in larger graphs (fixed rule)."""
    return max(0.05, 1 / math.log10(max(n, 10)))


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float) -> float:
    """pairs(u, v, w), each once, and labels(q, label)."""
    own = pairs.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v")
    ends = own.select(F.col("a").alias("c"), "w").union(own.select(F.col("b").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("d"))
    inside = own.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("m")).first()
    if not inside.m:
        return 0.0
    return inside.i / inside.m - resolution * ends.agg(F.sum((F.col("d") / (2 * inside.m)) ** 2)).first()[0]


def weighed(of: blocks.Arcs, scale: int, total: float, resolution: float) -> tuple[np.ndarray, ...]:
    """For each node and label around it (x, below scale, with the degree y): the node's place, the label, the weight of the
    arcs, the label's degree and whether it is the node's own; then where each node's own label and its best one are."""
    order, starts = blocks.grouped(of.node * scale + of.x)
    w, stays = np.add.reduceat(of.w[order], starts), np.logical_or.reduceat(of.way[order] == blocks.SELF, starts)
    first = order[starts]
    who, label, size, d = of.node[first], of.x[first], of.y[first], of.degrees[of.node[first]]
    gain = np.round(w - resolution * d * (size - np.where(stays, d, 0.0)) / (2 * total), 9)
    heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    worse = gain < np.maximum.reduceat(gain, heads)[who]
    top = np.minimum.reduceat((2 * worse + ~stays) * len(who) + np.arange(len(who)), heads) % len(who)
    return who, label, w, size, stays, np.flatnonzero(stays), top


def offers(arcs: blocks.Packed, degree: DataFrame, own: DataFrame, total: float, resolution: float) -> DataFrame:
    """own(q, d, label, turns) with the neighbouring label that raises the modularity most (new; ties to the own, then to the
    smallest label), the weight of the arcs into the own label (inside) and its degree (held)."""
    sizes = own.groupBy("label").agg(F.sum("d").alias("y"))
    values = own.select("q", F.col("label").alias("x")).join(large(sizes.withColumnRenamed("label", "x")), "x").select("q", "x", "y")
    scale = 1 + arcs.blocks * blocks.BLOCK

    def best(of: blocks.Arcs) -> Iterator[pa.RecordBatch]:
        who, label, w, size, stays, mine, top = weighed(of, scale, total, resolution)
        whole = ~np.isnan(of.degrees)
        columns = [of.ids, of.degrees, of.turns, label[mine], label[top], w[mine], size[mine], np.ones(len(mine), bool)]
        yield pa.record_batch([pa.array(c[whole]) for c in columns], OFFERED)
        part = np.isnan(of.degrees)[who]
        columns = [of.ids[who], of.degrees[who], np.zeros(len(who), np.int32), label, label, w, size, stays]
        yield pa.record_batch([pa.array(c[part]) for c in columns], OFFERED)

    found = blocks.each_piece(arcs, values, best, "q long, d double, turns int, label long, new long, inside double, held double, stays boolean")
    if not arcs.hubs:
        return found.drop("stays")
    # Of a node that is dealt over all pieces, the pieces give the weights of its labels.
    found = durable(found)
    tried = found.where(F.isnan("d")).groupBy("q", "label").agg(F.sum("inside").alias("w"), F.max("stays").alias("stays"), F.first("held").alias("s"))
    tried = tried.join(F.broadcast(degree.where(F.col("n") > blocks.HUB).select("q", "d", "turns")), "q")
    gain = F.round(F.col("w") - resolution * F.col("d") * (F.col("s") - F.when(F.col("stays"), F.col("d")).otherwise(0.0)) / (2 * total), 9)
    mine = lambda c: F.max(F.when(F.col("stays"), F.col(c))).alias(c)
    top = F.min(F.struct((-gain).alias("g"), (~F.col("stays")).alias("o"), "label")).alias("top")
    dealt = tried.groupBy("q", "d", "turns").agg(mine("label"), mine("w"), mine("s"), top).select("q", "d", "turns", "label", F.col("top.label").alias("new"), "w", "s")
    return found.where(~F.isnan("d")).drop("stays").union(dealt)


def moved(arcs: blocks.Packed, degree: DataFrame, loops: float, total: float, resolution: float, rounds: int) -> DataFrame:
    """(q, label): nodes go, a random half of them a round (bit r of turns), to the neighbouring community that raises the
    modularity most, as seen before the round; ties to the smallest label. A round that doesn't raise it is taken back.
    Labels are nodes."""

    def judged(own: DataFrame) -> tuple[DataFrame, float]:
        """The offers to these labels, and their modularity, which the same sums give."""
        seen = durable(offers(arcs, degree, own, total, resolution))
        inside, held = seen.agg(F.coalesce(F.sum("inside"), F.lit(0.0)), F.coalesce(F.sum(F.col("d") * F.col("held")), F.lit(0.0))).first()
        return seen, (inside / 2 + loops) / total - resolution * held / (2 * total) ** 2

    kept, best = judged(degree.select("q", "d", "turns", F.col("q").alias("label")))
    idle = 0
    for r in range(rounds):
        turn = F.col("turns").bitwiseAND(F.lit(1 << r % HALVES)) == 0
        tries, worth = judged(kept.select("q", "d", "turns", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label")))
        if worth > best + 1e-9:
            kept, best, idle = tries, worth, 0
        elif (idle := idle + 1) == 3:
            break
    return kept.select("q", "label")


def settled(pairs: DataFrame, degree: DataFrame, total: float, resolution: float, levels: int, rounds: int) -> DataFrame:
    """(q, label) after levels of moving, cutting into connected parts and contracting, in one task; pairs(u, v, w), each
    once, and degree(q, d, turns) fit a piece together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        u, v, w, turns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((v, u))
        u, v, w, turns = u[order], v[order], w[order], turns[order]
        ids, turns, edge = u[v < 0], turns[v < 0], v >= 0
        u, v, w = np.searchsorted(ids, u[edge]), np.searchsorted(ids, v[edge]), w[edge]
        last, n = np.arange(len(ids)), len(ids)
        for _ in range(levels):
            found = cut(u, v, moves(u, v, w, n, turns))
            if (found == np.arange(n)).all():
                break
            last = found[last]
            a, b = np.minimum(found[u], found[v]), np.maximum(found[u], found[v])
            order, starts = blocks.grouped(a * n + b)
            u, v, w = a[order[starts]], b[order[starts]], np.add.reduceat(w[order], starts)
        yield pa.record_batch([pa.array(ids), pa.array(ids[last])], ["q", "label"])

    def moves(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, turns: np.ndarray) -> np.ndarray:
        far = u != v
        d = np.bincount(u, w, n) + np.bincount(v, w, n)
        alone, loops = np.arange(n), w[~far].sum()
        node, end = np.concatenate([u[far], v[far], alone]), np.concatenate([v[far], u[far], alone])
        weights, way = np.concatenate([w[far], w[far], np.zeros(n)]), np.where(node == end, blocks.SELF, blocks.UP)

        def judged(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            y = np.bincount(label, d, n)[label]
            _, labels, inside, size, _, mine, top = weighed(blocks.Arcs(alone, d, turns, node, label[end], y[end], weights, way), n, total, resolution)
            return label, labels[top], (inside[mine].sum() / 2 + loops) / total - resolution * (d * size[mine]).sum() / (2 * total) ** 2

        label, new, best = judged(alone)
        idle = 0
        for r in range(rounds):
            tried, then, worth = judged(np.where(turns & (1 << r % HALVES), label, new))
            if worth > best + 1e-9:
                label, new, best, idle = tried, then, worth, 0
            elif (idle := idle + 1) == 3:
                break
        return label

    def cut(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        part, same = np.arange(len(label)), label[u] == label[v]
        nodes, least = blocks.least_of_joined(u[same], v[same])
        part[nodes] = least
        return part

    rows = pairs.select("u", "v", "w", F.lit(0).alias("turns")).union(degree.select(F.col("q").alias("u"), F.lit(-1).cast("long").alias("v"), "d", "turns"))
    return durable(rows.repartition(1).mapInArrow(run, "q long, label long"))


def degrees(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """q, d, n (arcs to others), turns of the nodes(id, turns) with edges; pairs(u, v, w), each once."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("q"), "w", (F.col("u") != F.col("v")).cast("int").alias("n")), F.struct(F.col("v").alias("q"), "w", (F.col("u") != F.col("v")).cast("int").alias("n")))))
    return durable(ends.groupBy("q").agg(F.sum("w").alias("d"), F.sum("n").alias("n")).join(large(nodes.select(F.col("id").alias("q"), "turns")), "q"))


def modularity_communities(graph: Graph, resolution: float | None = None, levels: int = 4, rounds: int = 8) -> DataFrame:
    """qualified_name, label of all nodes but files: local moves of nodes, then of the communities as nodes, until the
    modularity no longer rises. Before communities become nodes, each is cut into its connected parts, so none is
    disconnected. A node without edges is its own community; labels are the smallest members."""
    nodes, n = blocks.numbered(graph.nodes.where("kind <> 'File'").select(F.col("qualified_name").alias("q")).distinct())
    half = lambda r: F.pmod(F.xxhash64("q", F.lit(r)), F.lit(2)) * (1 << r)
    nodes = durable(nodes.select("q", "id", sum((half(r) for r in range(min(rounds, HALVES))), F.lit(0)).cast("int").alias("turns")))
    at = durable(numbered_weights(graph.edges, nodes))
    total = at.agg(F.sum("w")).first()[0]
    if not total:
        return nodes.select(F.col("q").alias("qualified_name"), F.col("q").alias("label"))
    resolution = resolution_for(n) if resolution is None else resolution
    labels = nodes.select("id", F.col("id").alias("label"))
    for level in range(levels):
        degree = degrees(at, nodes)
        if degree.agg(F.count("*") + F.sum("n")).first()[0] <= blocks.PIECE:
            # What fits a piece needs no other: one task takes all the levels that are left.
            found = settled(at, degree, total, resolution, levels - level, rounds)
            labels = labels.join(large(found.toDF("label", "up")), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
            break
        arcs = blocks.packed(at, degree, n)
        loops = at.where("u = v").select(F.col("u").alias("q"), "w")
        found = parts(arcs, moved(arcs, degree, loops.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0], total, resolution, rounds))
        if found.where("q <> label").isEmpty():
            break
        labels = durable(labels.join(large(found.toDF("label", "up")), "label", "left").select("id", F.coalesce("up", "label").alias("label")))
        at = durable(contracted(arcs, found, loops))
    labels = durable(labels)
    named = labels.groupBy("label").agg(F.min("id").alias("least")).join(large(nodes.select(F.col("id").alias("least"), F.col("q").alias("name"))), "least")
    named = labels.join(large(named.select("label", "name")), "label").select("id", F.col("name").alias("label"))
    return nodes.join(large(named), "id").select(F.col("q").alias("qualified_name"), "label")


def numbered_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v (u < v), w: the pairs of nodes(q, id), each once with its largest weight."""
    # Merged by hash: the nodes of one partition fit a task, and the edges needn't be sorted by names.
    of = lambda end: nodes.select(F.col("q").alias(end), F.col("id").alias(f"{end}_id")).hint("shuffle_hash")
    ends = edges.where("source <> target").select("source", "target", weight().alias("w")).join(of("source"), "source").join(of("target"), "target")
    return ends.select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"), "w").groupBy("u", "v").agg(F.max("w").alias("w"))


def contracted(arcs: blocks.Packed, found: DataFrame, loops: DataFrame) -> DataFrame:
    """u, v, w: the edges of labels found(q, label), each pair once, with the weights inside a label as its loop."""

    def summed(of: blocks.Arcs) -> Iterator[pa.RecordBatch]:
        up = of.way == blocks.UP
        own = np.zeros(len(of.ids), np.int64)
        own[of.node[of.way == blocks.SELF]] = of.x[of.way == blocks.SELF]
        a, b, w = own[of.node[up]], of.x[up], of.w[up]
        if len(a):
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield pa.record_batch([pa.array(a[starts]), pa.array(b[starts]), pa.array(np.add.reduceat(w[order], starts))], ["u", "v", "w"])

    between = blocks.each_piece(arcs, found.select("q", F.col("label").alias("x"), F.lit(0).cast("long").alias("y")), summed, "u long, v long, w double")
    inside = loops.join(large(found), "q").select(F.col("label").alias("u"), F.col("label").alias("v"), "w")
    return between.union(inside).groupBy("u", "v").agg(F.sum("w").alias("w"))


def parts(arcs: blocks.Packed, labels: DataFrame) -> DataFrame:
    """(q, label): labels of nodes cut into the parts that are connected inside, each named by its smallest node. Each
    round a piece joins the parts that its arcs connect; each part goes to the smallest that it met."""

    def hooks(of: blocks.Arcs) -> Iterator[pa.RecordBatch]:
        mine = of.way == blocks.SELF
        label, part = np.zeros(len(of.ids), np.int64), np.zeros(len(of.ids), np.int64)
        label[of.node[mine]], part[of.node[mine]] = of.x[mine], of.y[mine]
        near = (label[of.node] == of.x) & (part[of.node] != of.y)
        a, least = blocks.least_of_joined(part[of.node[near]], of.y[near])
        low = least < a
        yield pa.record_batch([pa.array(a[low]), pa.array(least[low])], ["part", "least"])

    own = durable(labels.select("q", F.col("label").alias("x"), F.col("q").alias("y")))
    while True:
        up = durable(blocks.each_piece(arcs, own, hooks, "part long, least long").groupBy("part").agg(F.min("least").alias("least")))
        if up.isEmpty():
            return own.select("q", F.col("y").alias("label"))
        # What a part goes to may go on itself, always to a smaller one.
        for _ in range(2):
            up = durable(up.join(large(up.select(F.col("part").alias("least"), F.col("least").alias("next"))), "least", "left").select("part", F.coalesce("next", "least").alias("least")))
        own = durable(own.join(large(up.withColumnRenamed("part", "y")), "y", "left").select("q", "x", F.coalesce("least", "y").alias("y")))


def connected_parts(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, label): labels cut into the parts that are connected inside, each named by its smallest node; pairs(u, v, w)."""
    nodes, n = blocks.numbered(labels.select("q"))
    nodes = durable(nodes.join(large(labels), "q").withColumn("turns", F.lit(0)))
    of = lambda end: large(nodes.select(F.col("q").alias(end), F.col("id").alias(f"{end}_id")))
    at = durable(pairs.join(of("u"), "u").join(of("v"), "v").select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"), "w"))
    least = nodes.groupBy("label").agg(F.min("id").alias("least"))
    found = parts(blocks.packed(at, degrees(at, nodes), n), nodes.join(large(least), "label").select(F.col("id").alias("q"), F.col("least").alias("label")))
    names = found.join(large(nodes.select(F.col("id").alias("label"), F.col("q").alias("name"))), "label").select(F.col("q").alias("id"), F.col("name").alias("label"))
    return nodes.select("id", "q").join(large(names), "id").select("q", "label")


def reassign_tests(graph: Graph) -> DataFrame:
    """qualified_name, community_id of each test with tested subjects: the community of most distinct ones; ties keep
    the test's own community, else go to the smallest."""
    own = graph.nodes.select("qualified_name", "community_id", "is_test")
    votes = graph.of_kind("TESTED_BY").join(own.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("c")), "source").groupBy(F.col("target").alias("qualified_name"), "c").agg(F.countDistinct("source").alias("n")).where("c IS NOT NULL")
    ranked = votes.join(own.where("is_test"), "qualified_name").withColumn("r", F.row_number().over(Window.partitionBy("qualified_name").orderBy(F.desc("n"), (F.col("c") != F.coalesce("community_id", F.lit(-1))).cast("int"), "c")))
    return ranked.where("r = 1").select("qualified_name", F.col("c").alias("community_id"))


def oversized(graph: Graph, share: float = 0.25, least: int = 10) -> DataFrame:
    """Communities with more than max(share of all, least) members."""
    sized = graph.nodes.where("community_id IS NOT NULL").groupBy("community_id").agg(F.count("*").alias("n"))
    total = sized.agg(F.sum("n")).scalar()
    return sized.where(F.col("n") > F.greatest(total * share, F.lit(least)))


def split_oversized(graph: Graph, share: float = 0.25, least: int = 10) -> DataFrame:
    """qualified_name, community_id, part: members of oversized communities by modularity inside each. No edge leads from
    one community to another here, so all are split at once."""
    big = graph.nodes.join(oversized(graph, share, least).select("community_id"), "community_id", "left_semi")
    own = big.select("qualified_name", "community_id")
    inner = graph.edges.join(own.toDF("source", "sc"), "source").join(own.toDF("target", "tc"), "target").where("sc = tc").select(*graph.edges.columns)
    return modularity_communities(Graph(big, inner)).join(own, "qualified_name").select("qualified_name", "community_id", F.xxhash64("label").alias("part"))


def keywords(members: DataFrame, top: int = 5) -> DataFrame:
    """community_id, keyword, n: the most frequent words of members' names, without stop words."""
    words = members.select("community_id", F.explode(split_name(F.col("name"))).alias("keyword")).where((F.length("keyword") > 1) & ~F.col("keyword").isin(*STOP_WORDS))
    counts = words.groupBy("community_id", "keyword").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("n"), "keyword"))).where(F.col("r") <= top)


def names(graph: Graph) -> DataFrame:
    """community_id, name: the directory most members are in, and the class with over 40 % of them or the top keyword;
    equal names of smaller communities get a number."""
    members = graph.nodes.where("community_id IS NOT NULL AND kind <> 'File'")
    one = lambda counts, by, name: counts.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("n"), by))).where("r = 1").select("community_id", F.col(by).alias(name), F.col("n").alias(f"{name}_n"))
    prefix = one(members.groupBy("community_id", F.element_at(F.split("file_path", "/"), -1).alias("d")).agg(F.count("*").alias("n")), "d", "prefix")
    classes = one(members.where("parent_name IS NOT NULL").groupBy("community_id", "parent_name").agg(F.count("*").alias("n")), "parent_name", "cls")
    words = keywords(members, 1).select("community_id", F.col("keyword"))
    sized = members.groupBy("community_id").agg(F.count("*").alias("size")).join(prefix, "community_id", "left").join(classes, "community_id", "left").join(words, "community_id", "left")
    second = F.when(F.col("cls_n") > 0.4 * F.col("size"), F.col("cls")).otherwise(F.col("keyword"))
    named = sized.withColumn("name", to_slug(F.concat_ws("-", "prefix", second)))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("size"), "community_id"))
    return named.select("community_id", "size", F.when(place == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), place)).alias("name"))


def communities(graph: Graph, sort_by: str = "size", min_size: int = 0) -> DataFrame:
    """community_id, name, size, cohesion."""
    found = names(graph).join(cohesion(graph).select("community_id", "cohesion"), "community_id").where(F.col("size") >= min_size)
    return found.orderBy(*{"size": [F.desc("size")], "cohesion": [F.desc("cohesion")], "name": ["name"]}[sort_by], "community_id")


def store_communities(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """nodes with community_id from members(qualified_name, community_id) alone."""
    return nodes.drop("community_id").join(members, "qualified_name", "left")


def needs_detection(graph: Graph, files: list[str]) -> bool:
    """Whether changed files hold a member of a community."""
    return not graph.nodes.where(F.col("file_path").isin(files) & F.col("community_id").isNotNull()).isEmpty()
