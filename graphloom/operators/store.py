"""Upserts, deletes and reads of node and edge tables. Every write is a new DataFrame; publish() swaps versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import language_family
from graphloom.graph import Graph
from graphloom.schema import EDGE, EDGE_KEY, NODE, NODE_KEY


def conform(df: DataFrame, schema) -> DataFrame:
    """Additive schema evolution: missing columns come as null, further columns go."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of both, of each key the newest: new ones before old ones, then by order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(order or []))
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "_new")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return latest(nodes, new, NODE_KEY)


def lift_confidence(edges: DataFrame) -> DataFrame:
    """confidence and its tier out of extra, with their defaults."""
    own = edges.withColumn("confidence", F.coalesce(F.get_json_object("extra", "$.confidence").cast("double"), F.lit(1.0)))
    return own.withColumn("confidence_tier", F.coalesce(F.get_json_object("extra", "$.confidence_tier"), F.lit("EXTRACTED")))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return latest(edges, lift_confidence(new), EDGE_KEY)


def with_ids(nodes: DataFrame) -> DataFrame:
    """A stable id: the same for the same qualified name, on any day."""
    return nodes.withColumn("id", F.xxhash64("qualified_name"))


def remove_files(graph: Graph, files: DataFrame) -> Graph:
    """Without what these files own; edges of other files into them stay and dangle. files: one column, file_path."""
    return Graph(graph.nodes.join(files, "file_path", "left_anti"), graph.edges.join(files, "file_path", "left_anti"))


def remove_files_permanently(graph: Graph, files: DataFrame, embeddings: DataFrame | None = None) -> tuple[Graph, DataFrame | None]:
    """Also without edges that touch a removed node on either side, and without its vectors."""
    gone = graph.nodes.join(files, "file_path", "left_semi").select("qualified_name")
    left = remove_files(graph, files)
    edges = left.edges.join(gone.withColumnRenamed("qualified_name", "source"), "source", "left_anti").join(gone.withColumnRenamed("qualified_name", "target"), "target", "left_anti")
    return Graph(left.nodes, edges.select(*graph.edges.columns)), None if embeddings is None else embeddings.join(gone, "qualified_name", "left_anti")


def store_files(graph: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """All that these files own is replaced by nodes and edges."""
    left = remove_files(graph, files)
    return Graph(left.nodes.unionByName(nodes, allowMissingColumns=True), left.edges.unionByName(edges, allowMissingColumns=True))


def reconcile(graph: Graph, current: DataFrame) -> Graph:
    """Without the files that the current inventory hasn't."""
    stale = graph.nodes.select("file_path").union(graph.edges.select("file_path")).distinct().join(current, "file_path", "left_anti")
    return remove_files_permanently(graph, stale)[0]


def purge_orphans(embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    return embeddings.join(nodes, "qualified_name", "left_semi")


def set_metadata(metadata: DataFrame, key: str, value: str) -> DataFrame:
    return latest(metadata, metadata.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def publish(graph: Graph, root: str) -> str:
    """Both tables as a new version below root; CURRENT.json names it last, so readers see one version or the other."""
    version = uuid.uuid4().hex
    conform(graph.nodes, NODE).write.partitionBy("language").parquet(f"{root}/{version}/nodes")
    conform(graph.edges, EDGE).write.partitionBy("kind").parquet(f"{root}/{version}/edges")
    graph.nodes.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/CURRENT.json")
    return version


def load(spark, root: str) -> Graph:
    version = spark.read.schema("version string").json(f"{root}/CURRENT.json").first().version
    return Graph(conform(spark.read.parquet(f"{root}/{version}/nodes"), NODE), conform(spark.read.parquet(f"{root}/{version}/edges"), EDGE))


# Reads


def get_node(graph: Graph, qualified_name: str) -> DataFrame:
    return graph.nodes.where(F.col("qualified_name").isin(qualified_name, qualified_name.replace("\\", "/")))


def nodes_by_file(graph: Graph, path: str) -> DataFrame:
    return graph.nodes.where(F.col("file_path") == path)


def all_nodes(graph: Graph, exclude_files: bool = True) -> DataFrame:
    return graph.nodes.where(F.col("kind") != "File") if exclude_files else graph.nodes


def edges_by_source(graph: Graph, qualified_name: str) -> DataFrame:
    return graph.edges.where(F.col("source") == qualified_name)


def edges_by_target(graph: Graph, qualified_name: str) -> DataFrame:
    return graph.edges.where(F.col("target") == qualified_name)


def config_consumers(graph: Graph, key: str) -> DataFrame:
    """Edges to the key itself, to `key.*`, or to the wildcard of any prefix of it."""
    parts = key.split(".")
    wanted = [f"config:{key}", f"config:{key}.*", *[f"config:{'.'.join(parts[:i])}.*" for i in range(1, len(parts))]]
    return graph.of_kind("DEPENDS_ON_CONFIG").where(F.col("target").isin(wanted))


def edges_by_target_name(graph: Graph, name: str, kind: str = "CALLS", language: str | None = None) -> DataFrame:
    """Edges to a bare name, whose source is of a language of the same family if one is given."""
    found = graph.edges.where((F.col("kind") == kind) & (F.col("target") == name))
    if language is None:
        return found
    family = graph.nodes.where(F.col("language").isin(language_family(language))).select(F.col("qualified_name").alias("source"))
    return found.join(family, "source", "left_semi").select(*graph.edges.columns)


def search_nodes(graph: Graph, query: str, limit: int | None = 20) -> DataFrame:
    """Nodes whose name or qualified name contains every word of the query."""
    words = query.lower().split()
    found = graph.nodes
    for w in words:
        found = found.where(F.lower("name").contains(w) | F.lower("qualified_name").contains(w))
    found = found if words else found.limit(0)
    return found if limit is None else found.orderBy("qualified_name").limit(limit)


def count_nodes_by_name(graph: Graph, name: str, language: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    found = graph.nodes.where(F.col("name") == name)
    found = found.where(F.col("language") == language) if language else found
    found = found.where(F.col("kind").isin(*kinds)) if kinds else found
    return found.agg(F.count("*").alias("n"))


def nodes_by_size(graph: Graph, min_lines: int = 50, max_lines: int | None = None, kind: str | None = None, path_pattern: str | None = None, limit: int = 50) -> DataFrame:
    span = F.col("line_end") - F.col("line_start") + 1
    found = graph.nodes.where(span >= min_lines)
    found = found.where(span <= max_lines) if max_lines is not None else found
    found = found.where(F.col("kind") == kind) if kind else found
    found = found.where(F.col("file_path").ilike(f"%{path_pattern}%")) if path_pattern else found
    if "extra" in graph.nodes.columns:
        found = found.where(F.get_json_object("extra", "$.verilog_kind").isNull())
    return found.withColumn("line_count", span).orderBy(F.desc("line_count"), "qualified_name").limit(limit)


def nodes_by_kind(graph: Graph, kinds: tuple[str, ...], file_pattern: str | None = None) -> DataFrame:
    found = graph.nodes.where(F.col("kind").isin(*kinds))
    return found.where(F.col("file_path").ilike(f"%{file_pattern}%")) if file_pattern else found


def files_matching(graph: Graph, suffix: str) -> DataFrame:
    return graph.nodes.where(F.col("file_path").ilike(f"%{suffix}")).select("file_path").distinct()


def all_files(graph: Graph) -> DataFrame:
    """Files of nodes (without virtual ones) and of edges."""
    real = graph.nodes.where(F.get_json_object("extra", "$.virtual").isNull()) if "extra" in graph.nodes.columns else graph.nodes
    return real.select("file_path").union(graph.edges.select("file_path")).distinct().orderBy("file_path")


def file_marker_paths(graph: Graph) -> DataFrame:
    return graph.nodes.where("kind = 'File'").select("file_path")


def edges_among(graph: Graph, names: DataFrame) -> DataFrame:
    """Edges with both ends in names(qualified_name)."""
    found = graph.edges.join(names.select(F.col("qualified_name").alias("source")), "source", "left_semi")
    return found.join(names.select(F.col("qualified_name").alias("target")), "target", "left_semi").select(*graph.edges.columns)


def get_nodes(graph: Graph, names: DataFrame) -> DataFrame:
    return graph.nodes.join(names.select("qualified_name"), "qualified_name", "left_semi")


def subgraph(graph: Graph, names: DataFrame) -> Graph:
    return Graph(get_nodes(graph, names), edges_among(graph, names))


def call_targets(graph: Graph, include_file_sources: bool = True) -> DataFrame:
    calls = graph.of_kind("CALLS")
    if not include_file_sources:
        files = graph.nodes.where("kind = 'File'").select(F.col("qualified_name").alias("source"))
        calls = calls.join(files, "source", "left_anti")
    return calls.select("target").distinct()


def outgoing_targets(graph: Graph, names: DataFrame) -> DataFrame:
    return graph.edges.join(names.select(F.col("qualified_name").alias("source")), "source", "left_semi").select("target")


def incoming_sources(graph: Graph, names: DataFrame) -> DataFrame:
    return graph.edges.join(names.select(F.col("qualified_name").alias("target")), "target", "left_semi").select("source")


def nodes_without_signature(graph: Graph) -> DataFrame:
    return graph.nodes.where(F.col("signature").isNull())


def has_nodes(graph: Graph, language: str | None = None) -> bool:
    return not (graph.nodes.where(F.col("language") == language) if language else graph.nodes).isEmpty()


def adjacency(graph: Graph) -> DataFrame:
    """Of each source its CALLS targets, and whether it has a test."""
    calls = graph.of_kind("CALLS").groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    return calls.join(graph.of_kind("TESTED_BY").select("source").distinct().withColumn("tested", F.lit(True)), "source", "left").fillna(False, ["tested"])


def collapsed(graph: Graph, weights: dict, default: float) -> DataFrame:
    """One row for each pair of ends: how many edges, the kind with the largest weight, and that weight."""
    from graphloom.graph import lookup

    weighed = graph.edges.withColumn("w", lookup(weights, F.col("kind"), default))
    return weighed.groupBy("source", "target").agg(F.count("*").alias("n"), F.max("w").alias("weight"), F.max_by("kind", F.struct("w", "kind")).alias("kind"))


def community_of(graph: Graph, names: DataFrame | None = None) -> DataFrame:
    return (graph.nodes if names is None else get_nodes(graph, names)).select("qualified_name", "community_id")


def community_members(graph: Graph, community_id: int) -> DataFrame:
    return graph.nodes.where(F.col("community_id") == community_id)


def edge_view(edges: DataFrame, most: int = 20) -> DataFrame:
    """Edges as shown: with the candidates that resolution left, at most 20 of each list."""
    lists = {name: F.slice(F.from_json(F.get_json_object("extra", f"$.{name}"), "array<string>"), 1, most) for name in ("ambiguous_targets", "unresolved_targets")}
    return edges.withColumns(lists)
