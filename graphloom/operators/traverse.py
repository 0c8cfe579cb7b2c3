"""Multi-hop operators. Each hop is a join with the edges and an aggregate; long loops are cut off by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.graph import Graph, durable, large, lookup, rounded
from graphloom.functions.text import file_of

#: Hops that are left in one plan.
LAZY_HOPS = 3


def impact_seeds(graph: Graph, files: list[str]) -> DataFrame:
    """All nodes of the changed files, and the namespaces that they declare."""
    own = graph.nodes.where(F.col("file_path").isin(files))
    names = own.select("qualified_name")
    if "extra" in graph.nodes.columns:
        names = names.union(own.select(F.explode(F.from_json(F.get_json_object("extra", "$.csharp_namespaces"), "array<string>"))))
    return names.distinct()


def impact_arcs(graph: Graph) -> DataFrame:
    """(source, target, w) in the direction in which impact spreads, one arc for each pair."""
    kind = F.col("kind")
    outgoing = kind.isin(*S.IMPACT_OUTGOING)
    spread = graph.edges.where(~kind.isin(*S.IMPACT_NONE)).select(
        F.when(outgoing, F.col("source")).otherwise(F.col("target")).alias("source"),
        F.when(outgoing, F.col("target")).otherwise(F.col("source")).alias("target"),
        lookup(S.IMPACT_WEIGHT, kind, S.IMPACT_DEFAULT_WEIGHT).alias("w"),
    )
    return spread.groupBy("source", "target").agg(F.max("w").alias("w"))


def impact_scores(graph: Graph, files: list[str], depth: int = S.IMPACT_DEPTH, decay: float = S.IMPACT_DECAY, floor: float = S.IMPACT_FLOOR) -> DataFrame:
    """qualified_name, score: for each vertex the best product of weights and decays on a walk of at most depth arcs."""
    arcs = impact_arcs(graph)
    best = frontier = impact_seeds(graph, files).withColumn("score", F.lit(1.0))
    for hop in range(depth):
        reached = frontier.join(arcs, frontier.qualified_name == arcs.source).select(F.col("target").alias("qualified_name"), (F.col("score") * F.col("w") * decay).alias("score"))
        reached = reached.where(F.col("score") > floor).groupBy("qualified_name").agg(F.max("score").alias("score"))
        known = best.withColumnRenamed("score", "known")
        frontier = reached.join(known, "qualified_name", "left").where(F.col("known").isNull() | (F.col("score") > F.col("known"))).drop("known")
        best = best.union(frontier).groupBy("qualified_name").agg(F.max("score").alias("score"))
        if depth > LAZY_HOPS:
            frontier, best = durable(frontier), durable(best)
            if frontier.isEmpty():
                break
    return best


def impact_radius(graph: Graph, files: list[str], depth: int = S.IMPACT_DEPTH, limit: int | None = S.IMPACT_NODES, **policy) -> DataFrame:
    """Nodes that a change of these files may affect, best first: no seeds, no vertices without a node."""
    scores = impact_scores(graph, files, depth, **policy)
    found = graph.nodes.join(scores, "qualified_name").join(impact_seeds(graph, files), "qualified_name", "left_anti")
    if "extra" in graph.nodes.columns:
        found = found.where(F.get_json_object("extra", "$.verilog_kind").isNull())
    found = found.withColumn("impact_score", rounded(F.col("score")))
    return found.drop("score") if limit is None else found.orderBy(F.desc("score"), "qualified_name").drop("score").limit(limit)


def impact_summary(impacted: DataFrame) -> DataFrame:
    """How many, in how many files, and the bucket: over 20 high, over 5 medium."""
    n = F.count("*")
    return impacted.agg(n.alias("total_impacted"), F.countDistinct("file_path").alias("impacted_files"), F.when(n > 20, "high").when(n > 5, "medium").otherwise("low").alias("risk"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def reach(arcs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seeds(qualified_name) and what lies within depth arcs of them: qualified_name, hops (the least)."""
    found = frontier = seeds.select("qualified_name").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        nexts = frontier.join(arcs, frontier.qualified_name == arcs.source).select(F.col("target").alias("qualified_name")).distinct()
        frontier = nexts.join(found, "qualified_name", "left_anti").withColumn("hops", F.lit(hop))
        found = found.union(frontier)
        if depth > LAZY_HOPS:
            frontier, found = durable(frontier), durable(found)
            if frontier.isEmpty():
                break
    return found


def impact_bfs(graph: Graph, files: list[str], depth: int = 2) -> DataFrame:
    """The unweighted, undirected variant over all kinds of edges."""
    seeds = graph.nodes.where(F.col("file_path").isin(files)).select("qualified_name")
    return graph.nodes.join(reach(both_ways(graph.edges), seeds, depth).where("hops > 0"), "qualified_name")


def transitive_tests(graph: Graph, names: list[str], max_depth: int = 1, max_frontier: int | None = 50) -> DataFrame:
    """Tests of these nodes: qualified_name, hops. Classes stand for what they contain, files for their nodes; then
    along CALLS, of each hop the first max_frontier callees by name. Edges with unresolved ends don't count."""
    named = graph.nodes.where(F.col("qualified_name").isin(names))
    inside = graph.of_kind("CONTAINS").join(named.where("kind = 'Class'").select(F.col("qualified_name").alias("source")), "source", "left_semi").select(F.col("target").alias("qualified_name"))
    of_files = graph.nodes.join(named.where("kind = 'File'").select("file_path"), "file_path", "left_semi").select("qualified_name")
    start = named.select("qualified_name").union(inside).union(of_files).distinct()
    calls = graph.of_kind("CALLS")
    tested = graph.of_kind("TESTED_BY")
    if "extra" in graph.edges.columns:
        clear = ~F.coalesce(F.col("extra"), F.lit("")).rlike("ambiguous_targets|unresolved_targets")
        calls, tested = calls.where(clear), tested.where(clear)
    calls = calls.join(graph.nodes.select(F.col("qualified_name").alias("target")), "target", "left_semi").select("source", "target").distinct()
    reached = start.withColumn("hops", F.lit(0))
    frontier = start
    for hop in range(1, max_depth + 1):
        nexts = frontier.join(calls, frontier.qualified_name == calls.source).select(F.col("target").alias("qualified_name")).distinct().join(reached, "qualified_name", "left_anti")
        frontier = nexts if max_frontier is None else nexts.orderBy("qualified_name").limit(max_frontier)
        reached = reached.union(frontier.withColumn("hops", F.lit(hop)))
    found = reached.join(tested, reached.qualified_name == tested.source).groupBy(F.col("target").alias("test")).agg(F.min("hops").alias("hops"))
    return found.join(graph.nodes, found.test == graph.nodes.qualified_name).select("test", "hops", "file_path")


def test_counts(graph: Graph, nodes: DataFrame, max_frontier: int = 50, many: bool = False) -> DataFrame:
    """nodes(qualified_name, kind, file_path) to (qualified_name, tests): how many known tests each has by itself, by what
    it contains (a class its members, a file its classes and functions), or by what those call, of which the first
    max_frontier by name count. Edges with unresolved ends don't count; every node is answered on its own. many:
    nodes grow with the graph, so no join may send them through the driver."""
    sized = large if many else lambda df: df
    own = sized(nodes.select(F.col("qualified_name").alias("of"), "kind", "file_path").distinct())
    inside = graph.of_kind("CONTAINS").join(own.where("kind = 'Class'").select(F.col("of").alias("source")), "source").select(F.col("source").alias("of"), F.col("target").alias("q"))
    symbols = graph.nodes.where(F.col("kind").isin("Class", "Function", "Method")).select("file_path", F.col("qualified_name").alias("q"))
    of_files = own.where("kind = 'File'").join(symbols, "file_path").select("of", "q")
    start = sized(own.select("of", F.col("of").alias("q")).union(inside).union(of_files).distinct())
    calls, tested = graph.of_kind("CALLS"), graph.of_kind("TESTED_BY")
    if "extra" in graph.edges.columns:
        tested = tested.where(~F.coalesce(F.col("extra"), F.lit("")).rlike("ambiguous_targets|unresolved_targets"))
    known = large(graph.nodes.select(F.col("qualified_name").alias("target")))
    callees = start.join(calls.select(F.col("source").alias("q"), "target").distinct(), "q").join(known, "target", "left_semi").select("of", F.col("target").alias("q")).distinct().join(start, ["of", "q"], "left_anti")
    first = callees.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("q"))).where(F.col("n") <= max_frontier).drop("n")
    tests = start.union(first).join(large(tested.select(F.col("source").alias("q"), "target").distinct()), "q").join(known, "target", "left_semi")
    return tests.groupBy(F.col("of").alias("qualified_name")).agg(F.countDistinct("target").alias("tests"))


def single_hop_dependents(graph: Graph, files: DataFrame) -> DataFrame:
    """files(file_path) to (file_path, dependent): files that import them or use their nodes, without themselves."""
    imports = graph.of_kind("IMPORTS_FROM").select(file_of(F.col("target")).alias("f"), F.col("file_path").alias("dependent"))
    own = graph.nodes.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("f"))
    uses = graph.of_kind("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS").join(own, "target").select("f", F.col("file_path").alias("dependent"))
    both = imports.union(uses).where("f <> dependent").distinct()
    return files.join(both, files.file_path == both.f).select("file_path", "dependent")


def find_dependents(graph: Graph, path: str, max_hops: int = 2, most: int = 500) -> DataFrame:
    """Files that depend on this one within max_hops; the first `most` by name, and whether there are more."""
    spark = graph.nodes.sparkSession
    found = frontier = spark.createDataFrame([(path, 0)], "file_path string, hops int")
    for hop in range(1, max_hops + 1):
        nexts = single_hop_dependents(graph, frontier.select("file_path")).select(F.col("dependent").alias("file_path")).distinct()
        frontier = nexts.join(found, "file_path", "left_anti").withColumn("hops", F.lit(hop))
        found = found.union(frontier)
    # One row more than is shown tells whether there are more; the window has no more rows than that.
    listed = found.where("hops > 0").orderBy("file_path").limit(most + 1)
    return listed.withColumn("truncated", F.count("*").over(Window.partitionBy()) > most).orderBy("file_path").limit(most)


def referrer_files(graph: Graph, gone: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Files outside forgotten(file_path) with an edge that touches gone(qualified_name)."""
    touch = [graph.edges.join(gone.select(F.col("qualified_name").alias(end)), end, "left_semi").select("file_path") for end in ("source", "target")]
    return touch[0].union(touch[1]).distinct().join(forgotten, "file_path", "left_anti")


def traverse(graph: Graph, start: str, depth: int = 3, token_budget: int = 2000) -> DataFrame:
    """Undirected search from a node, breadth first; vertices without a node are met but not passed. Rows in order
    (hops, name) as long as their estimated tokens fit the budget."""
    nodes = graph.nodes.select("qualified_name")
    arcs = both_ways(graph.edges).join(nodes.select(F.col("qualified_name").alias("source")), "source", "left_semi")
    seeds = nodes.where(F.col("qualified_name") == start)
    met = reach(arcs, seeds, depth).join(graph.nodes.select("qualified_name", "kind", "name", "file_path"), "qualified_name")
    cost = F.ceil((F.length("qualified_name") + F.length("name") + F.length("kind")) / 4).cast("long")
    # A bounded search: at most six hops and a token budget.
    spent = F.sum(cost).over(Window.orderBy("hops", "qualified_name"))
    return met.orderBy("hops", "qualified_name").limit(token_budget).withColumn("tokens", spent).where(F.col("tokens") <= token_budget)


def degrees(graph: Graph) -> DataFrame:
    """qualified_name, in_degree, out_degree of every vertex."""
    out = graph.edges.groupBy(F.col("source").alias("qualified_name")).agg(F.count("*").alias("out_degree"))
    in_ = graph.edges.groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("in_degree"))
    return out.join(in_, "qualified_name", "full").fillna(0, ["in_degree", "out_degree"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def hub_nodes(graph: Graph, top: int | None = 10) -> DataFrame:
    found = degrees(graph).join(graph.nodes.where("kind <> 'File'"), "qualified_name")
    return found if top is None else found.orderBy(F.desc("degree"), "qualified_name").limit(top)


def betweenness(graph: Graph, exact_up_to: int = 5000, pivots: int = 500, seed: int = 42) -> DataFrame:
    """qualified_name, betweenness: normalised shortest-path dependency over the directed graph of all edges, from
    every vertex, or from a seeded sample of pivots in larger graphs. Level by level for all sources at once."""
    arcs = durable(graph.edges.select("source", "target").where("source <> target").distinct())
    vertices = durable(graph.nodes.select("qualified_name").union(arcs.select("source")).union(arcs.select("target")).distinct())
    n = vertices.count()
    sources = vertices if n <= exact_up_to else vertices.orderBy(F.xxhash64(F.lit(seed), "qualified_name")).limit(pivots)
    k = n if n <= exact_up_to else pivots
    level = sources.select(F.col("qualified_name").alias("s"), F.col("qualified_name").alias("v"), F.lit(1.0).alias("paths"))
    seen, levels = level.select("s", "v"), [level]
    while True:
        nexts = level.join(arcs, level.v == arcs.source).groupBy("s", F.col("target").alias("v")).agg(F.sum("paths").alias("paths"))
        level = durable(nexts.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = durable(seen.union(level.select("s", "v")))
    total, below = None, None
    for level in reversed(levels):
        if below is None:
            own = level.withColumn("d", F.lit(0.0))
        else:
            down = level.join(arcs, level.v == arcs.source).select("s", "v", "paths", "target").join(below.select("s", F.col("v").alias("target"), F.col("paths").alias("p"), "d"), ["s", "target"])
            share = down.groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("d"))).alias("d"))
            own = durable(level.join(share, ["s", "v"], "left").fillna(0.0, ["d"]))
        below = own
        part = own.where("s <> v").select("v", "d")
        total = part if total is None else total.union(part)
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return vertices.join(total.groupBy(F.col("v").alias("qualified_name")).agg((F.sum("d") * scale).alias("betweenness")), "qualified_name", "left").fillna(0.0, ["betweenness"])


def bridge_nodes(graph: Graph, top: int = 10, **how) -> DataFrame:
    found = betweenness(graph, **how).where("betweenness > 0").join(graph.nodes.where("kind <> 'File'"), "qualified_name")
    return found.orderBy(F.desc("betweenness"), "qualified_name").limit(top)
