"""Counts and scores over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_test_community
from graphloom.graph import Graph, rounded
from graphloom.operators.traverse import degrees, hub_nodes


def stats_by_kind(graph: Graph) -> DataFrame:
    kind = F.col("kind")
    if "extra" in graph.nodes.columns:
        kind = F.when(F.get_json_object("extra", "$.verilog_kind").isNotNull(), "Signal").otherwise(kind)
    return graph.nodes.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def stats_by_edge_kind(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("kind").agg(F.count("*").alias("n"))


def stats(graph: Graph) -> DataFrame:
    nodes = graph.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"), F.array_sort(F.collect_set(F.when(F.col("kind") == "File", F.col("language")))).alias("languages"))
    return nodes.withColumn("edges", graph.edges.agg(F.count("*")).scalar())


def isolated(graph: Graph, most: int | None = 50) -> DataFrame:
    """Non-file nodes with at most one edge end (a self-loop has two)."""
    found = graph.nodes.where("kind <> 'File'").join(degrees(graph).select("qualified_name", "degree"), "qualified_name", "left").fillna(0, ["degree"]).where("degree <= 1")
    return found if most is None else found.orderBy("qualified_name").limit(most)


def thin_communities(graph: Graph, below: int = 3) -> DataFrame:
    return graph.nodes.where("community_id IS NOT NULL").groupBy("community_id").agg(F.count("*").alias("n")).where(F.col("n") < below)


def untested_hotspots(graph: Graph, least: int = 5, most: int | None = 20) -> DataFrame:
    tested = graph.of_kind("TESTED_BY").select(F.col("source").alias("qualified_name"))
    found = degrees(graph).where(F.col("degree") >= least).join(graph.nodes.where("kind <> 'File' AND NOT is_test"), "qualified_name").join(tested, "qualified_name", "left_anti")
    return found if most is None else found.orderBy(F.desc("degree"), "qualified_name").limit(most)


def single_file_communities(graph: Graph, least: int = 3) -> DataFrame:
    sized = graph.nodes.where("community_id IS NOT NULL").groupBy("community_id").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    return sized.where((F.col("files") == 1) & (F.col("n") >= least))


def surprising_connections(graph: Graph, top: int | None = 15) -> DataFrame:
    """Edges by an additive score: other community .3, other file extension .2, edge node to hub .2, across the test
    border .15, call of a Type .15. A hub has three times the upper median degree, ten at least."""
    degree = degrees(graph).select("qualified_name", "degree")
    positive = degree.where("degree > 0")
    # The upper median over the counts of each degree: as many rows as there are degrees.
    counts = positive.groupBy("degree").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree")))
    median = upto.where(F.col("upto") >= counts.agg(F.floor(F.sum("n") / 2) + 1).scalar()).agg(F.min("degree")).scalar()
    own = graph.nodes.join(degree, "qualified_name", "left").fillna(0, ["degree"])
    side = lambda p: own.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("qualified_name", "qn"), ("community_id", "community"), ("file_path", "file"), ("is_test", "test"), ("kind", "kind"), ("degree", "degree"))])
    joined = graph.edges.where("kind <> 'CONTAINS'").select("kind", "source", "target").distinct().join(side("s"), F.col("source") == F.col("s_qn")).join(side("t"), F.col("target") == F.col("t_qn"))
    hub = F.greatest(3 * median, F.lit(10))
    extension = lambda p: F.regexp_extract(p, r"\.([^./]+)$", 1)
    peripheral = ((F.col("s_degree") <= 2) & (F.col("t_degree") >= hub)) | ((F.col("t_degree") <= 2) & (F.col("s_degree") >= hub))
    parts = {
        "cross-community": (F.col("s_community") != F.col("t_community"), 0.3), "cross-language": (extension(F.col("s_file")) != extension(F.col("t_file")), 0.2), "peripheral-hub": (peripheral, 0.2),
        "test-boundary": (F.col("s_test") != F.col("t_test"), 0.15), "type-call": ((F.col("kind") == "CALLS") & ((F.col("s_kind") == "Type") | (F.col("t_kind") == "Type")), 0.15),
    }
    score = sum((F.when(c, w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, (c, _) in parts.items()]))
    found = joined.select("kind", "source", "target", rounded(score, 2).alias("score"), reasons.alias("reasons")).where("score > 0")
    return found if top is None else found.orderBy(F.desc("score"), "source", "target", "kind").limit(top)


def suggested_questions(graph: Graph) -> DataFrame:
    """Questions of three hubs, three surprising edges, two thin communities and two hotspots."""
    hubs = hub_nodes(graph, 3).select(F.lit("hub").alias("topic"), F.format_string("What depends on %s, which has %d connections?", "name", "degree").alias("question"))
    odd = surprising_connections(graph, 3).select(F.lit("surprise"), F.format_string("Why is %s connected to %s?", "source", "target"))
    thin = thin_communities(graph).orderBy("community_id").limit(2).select(F.lit("thin"), F.format_string("Should community %d with %d members be merged?", "community_id", "n"))
    hot = untested_hotspots(graph, most=2).select(F.lit("hotspot"), F.format_string("Which tests cover %s?", "name"))
    return hubs.union(odd).union(thin).union(hot)


def cohesion(graph: Graph) -> DataFrame:
    """Of each community the edges inside it, those that leave it (to other ones or to no node), and their share."""
    own = graph.nodes.where("community_id IS NOT NULL").select("qualified_name", "community_id")
    ends = graph.edges.select("source", "target").join(own.toDF("source", "sc"), "source", "left").join(own.toDF("target", "tc"), "target", "left")
    touched = ends.select(F.explode(F.array_distinct(F.array_compact(F.array("sc", "tc")))).alias("community_id"), F.coalesce(F.col("sc") == F.col("tc"), F.lit(False)).alias("inside"))
    sums = touched.groupBy("community_id").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    sized = own.groupBy("community_id").agg(F.count("*").alias("n"))
    share = F.col("internal") / (F.col("internal") + F.col("external"))
    return sized.join(sums, "community_id", "left").fillna(0, ["internal", "external"]).withColumn("cohesion", rounded(F.when(F.col("internal") + F.col("external") > 0, share).otherwise(0.0)))


def cross_community(graph: Graph) -> DataFrame:
    """Edges between two communities without TESTED_BY: a, b (a < b), kind."""
    own = graph.nodes.where("community_id IS NOT NULL").select("qualified_name", "community_id")
    joined = graph.edges.where("kind <> 'TESTED_BY'").join(own.toDF("source", "sc"), "source").join(own.toDF("target", "tc"), "target").where("sc <> tc")
    return joined.select(F.least("sc", "tc").alias("a"), F.greatest("sc", "tc").alias("b"), "kind", "source", "target")


def architecture_overview(graph: Graph, warn_above: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Pairs of communities with their number of edges and a warning; names(community_id, name) tells test communities."""
    pairs = cross_community(graph).groupBy("a", "b").agg(F.count("*").alias("n"))
    if names is None:
        return pairs.withColumn("warning", F.col("n") > warn_above)
    test = names.select(F.col("community_id"), is_test_community(F.col("name")).alias("t"))
    both = pairs.join(test.toDF("a", "ta"), "a", "left").join(test.toDF("b", "tb"), "b", "left")
    return both.select("a", "b", "n", ((F.col("n") > warn_above) & ~F.coalesce("ta", F.lit(False)) & ~F.coalesce("tb", F.lit(False))).alias("warning"))


def top_kinds_of_pairs(graph: Graph, top: int = 3) -> DataFrame:
    counts = cross_community(graph).groupBy("a", "b", "kind").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("n"), "kind"))).where(F.col("r") <= top)
    return ranked.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("r", "kind", "n"))).alias("kinds"))


def community_supergraph(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Communities as nodes (-1: none) and their edges with weights."""
    own = graph.nodes.select("qualified_name", F.coalesce("community_id", F.lit(-1)).alias("c"))
    nodes = own.groupBy(F.col("c").alias("community_id")).agg(F.count("*").alias("n"))
    joined = graph.edges.join(own.toDF("source", "sc"), "source").join(own.toDF("target", "tc"), "target").where("sc <> tc")
    return nodes, joined.groupBy("sc", "tc").agg(F.count("*").alias("weight"))


def file_supergraph(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Files with their symbols and the community of the first one (by line, then name), and weighted edges."""
    first = F.min_by("community_id", F.struct("line_start", "qualified_name"))
    nodes = graph.nodes.groupBy("file_path").agg(F.count_if(F.col("kind") != "File").alias("symbols"), first.alias("community_id"))
    own = graph.nodes.select("qualified_name", "file_path")
    joined = graph.edges.select("source", "target").join(own.toDF("source", "sf"), "source").join(own.toDF("target", "tf"), "target").where("sf <> tf")
    return nodes, joined.groupBy("sf", "tf").agg(F.count("*").alias("weight"))


def auto_mode(node_count: int, edge_count: int, max_nodes: int = 3000, max_edges: int = 9000, has_communities: bool = True) -> str:
    return "full" if node_count <= max_nodes and edge_count <= max_edges else "community" if has_communities else "file"


def referenced_type_names(graph: Graph) -> DataFrame:
    """Capitalised identifiers in parameters and return types."""
    text = F.concat_ws(" ", "params", "return_type")
    return graph.nodes.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b[A-Z]\w*"), F.lit(0))).alias("name")).distinct()
