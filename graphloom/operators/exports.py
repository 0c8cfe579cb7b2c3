"""Exports: JSON, GraphML, Cypher, Markdown pages. Text is made in columns and written by Spark's text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cypher_escape, wiki_slug
from graphloom.graph import Graph
from graphloom.operators.analytics import cross_community
from graphloom.operators.resolve import link_targets


def export_rows(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as JSON texts; edges lead to nodes by best effort."""
    linked = link_targets(graph)
    return graph.nodes.select(F.to_json(F.struct(*graph.nodes.columns)).alias("value")), linked.select(F.to_json(F.struct(*linked.columns)).alias("value"))


def export_json(graph: Graph, path: str) -> None:
    nodes, edges = export_rows(graph)
    nodes.write.mode("overwrite").text(f"{path}/nodes")
    edges.write.mode("overwrite").text(f"{path}/edges")


def xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml_rows(graph: Graph) -> DataFrame:
    """(part, value): head, nodes, edges, foot in this order."""
    spark = graph.nodes.sparkSession
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"><data key="kind">%s</data><data key="name">%s</data></node>', xml(F.col("qualified_name")), xml(F.col("kind")), xml(F.col("name"))).alias("value"))
    edges = graph.edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', xml(F.col("source")), xml(F.col("target")), xml(F.col("kind"))).alias("value"))
    return head.union(nodes).union(edges)


def export_graphml(graph: Graph, path: str) -> None:
    graphml_rows(graph).sortWithinPartitions("part").repartitionByRange(4, "part").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def cypher_rows(graph: Graph) -> DataFrame:
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.format_string("CREATE (:%s {qualified_name: '%s', name: '%s'});", "kind", cypher_escape(F.col("qualified_name")), cypher_escape(F.col("name"))).alias("value"))
    edges = graph.edges.select(F.lit(2).alias("part"), F.format_string("MATCH (a {qualified_name: '%s'}), (b {qualified_name: '%s'}) CREATE (a)-[:%s]->(b);", cypher_escape(F.col("source")), cypher_escape(F.col("target")), "kind").alias("value"))
    return nodes.union(edges)


def vault_pages(graph: Graph) -> DataFrame:
    """(slug, page): a page for each node with its links, both ways and once each; equal slugs get a number."""
    slug = wiki_slug(F.col("name"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("qualified_name"))
    named = graph.nodes.withColumn("s", slug).withColumn("slug", F.when(place == 1, F.col("s")).otherwise(F.concat("s", F.lit("-"), place)))
    own = named.select("qualified_name", "slug")
    both = graph.edges.select("source", "target").union(graph.edges.select("target", "source")).distinct().where("source <> target")
    links = both.join(own.toDF("target", "other"), "target").groupBy(F.col("source").alias("qualified_name")).agg(F.sort_array(F.collect_set(F.concat(F.lit("- [["), "other", F.lit("]]")))).alias("links"))
    page = F.concat(F.format_string("---\nkind: %s\nfile: %s\n---\n# %s\n", "kind", "file_path", "name"), F.coalesce(F.array_join("links", "\n"), F.lit("")))
    return named.join(links, "qualified_name", "left").select("slug", page.alias("page"))


def wiki_pages(graph: Graph, names: DataFrame, members: int = 50, top: int = 15) -> DataFrame:
    """(slug, page) of each community: members, and the communities that it depends on or that depend on it."""
    ranked = graph.nodes.where("community_id IS NOT NULL AND kind <> 'File'").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("qualified_name"))).where(F.col("r") <= members)
    listed = ranked.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "qualified_name"))), lambda s: F.concat(F.lit("- "), s["qualified_name"])), "\n").alias("members"))
    pairs = cross_community(graph).groupBy("a", "b").agg(F.count("*").alias("n"))
    around = pairs.union(pairs.select("b", "a", "n")).toDF("community_id", "other", "n").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("n"), "other"))).where(F.col("r") <= top)
    depends = around.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "other", "n"))), lambda s: F.format_string("- %d (%d)", s["other"], s["n"])), "\n").alias("around"))
    page = F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.lit("## Members"), "members", F.lit("## Neighbours"), "around")
    place = F.row_number().over(Window.partitionBy("s").orderBy("community_id"))
    return names.join(listed, "community_id", "left").join(depends, "community_id", "left").withColumn("s", wiki_slug(F.col("name"))).select(F.when(place == 1, F.col("s")).otherwise(F.concat("s", F.lit("-"), place)).alias("slug"), page.alias("page"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").partitionBy("slug").text(path)
