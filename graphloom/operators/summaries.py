"""Materialised summaries, snapshots and their differences, and measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, rounded
from graphloom.operators.traverse import degrees

#: Words in a name that raise a node's risk.
RISK_WORDS = "auth login password token session crypt secret credential permission sql execute".split()


def community_summaries(graph: Graph, top: int = 5) -> DataFrame:
    """community_id, size, key_symbols: the members with most edges (ties by name)."""
    members = graph.nodes.where("community_id IS NOT NULL AND kind <> 'File'").join(degrees(graph).select("qualified_name", "degree"), "qualified_name", "left").fillna(0, ["degree"])
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("degree"), "qualified_name")))
    names = ranked.where(F.col("r") <= top).groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ",").alias("key_symbols"))
    purpose = members.groupBy("community_id").agg(F.count("*").alias("size"), F.min("file_path").alias("a"), F.max("file_path").alias("b"))
    parts = F.filter(F.arrays_zip(F.split("a", "/").alias("x"), F.split("b", "/").alias("y")), lambda z: z["x"] == z["y"])
    shared = F.array_join(F.transform(parts, lambda z: z["x"]), "/")
    return purpose.join(names, "community_id").select("community_id", "size", "key_symbols", F.element_at(F.split(shared, "/"), -1).alias("purpose"), F.lit("unknown").alias("risk"))


def flow_snapshots(flow_table: DataFrame) -> DataFrame:
    """flow_id, entry, critical_path: the entry, the next three steps and the last."""
    path = F.col("path")
    return flow_table.select("flow_id", "entry", F.array_distinct(F.array_compact(F.concat(F.array("entry"), F.slice(path, 2, 3), F.array(F.element_at(path, -1))))).alias("critical_path"))


def risk_index(graph: Graph) -> DataFrame:
    """qualified_name, caller_count, tested, risk: callers over 10 .3, over 3 .15; no tests .3; risky words in the name .4."""
    callers = graph.of_kind("CALLS").groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("caller_count"))
    tested = graph.of_kind("TESTED_BY").select(F.col("source").alias("qualified_name")).distinct().withColumn("tested", F.lit(True))
    own = graph.nodes.where(F.col("kind").isin("Function", "Class", "Test")).select("qualified_name", "name")
    joined = own.join(callers, "qualified_name", "left").join(tested, "qualified_name", "left").fillna(0, ["caller_count"]).fillna(False, ["tested"])
    n = F.col("caller_count")
    score = F.when(n > 10, 0.3).when(n > 3, 0.15).otherwise(0.0) + F.when(F.col("tested"), 0.0).otherwise(0.3) + F.when(F.lower("name").rlike("|".join(RISK_WORDS)), 0.4).otherwise(0.0)
    return joined.select("qualified_name", "caller_count", "tested", rounded(F.least(score, F.lit(1.0))).alias("risk"))


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """`def n(params) -> ret`, `class n` or the name, at most 512 characters."""
    call = F.concat(F.lit("def "), name, F.coalesce(F.when(params.startswith("("), params).otherwise(F.concat(F.lit("("), params, F.lit(")"))), F.lit("()")), F.when(returns.isNotNull(), F.concat(F.lit(" -> "), returns)).otherwise(""))
    return F.substring(F.when(kind.isin("Function", "Test"), call).when(kind == "Class", F.concat(F.lit("class "), name)).otherwise(name), 1, 512)


def with_signatures(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("signature", signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type")))


# Snapshots


def take_snapshot(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes with kind, file and community; edges as text."""
    nodes = graph.nodes.select("qualified_name", "kind", "file_path", "community_id")
    return nodes, graph.edges.select(F.concat("source", F.lit("->"), "target", F.lit(":"), "kind").alias("edge")).distinct()


def diff_snapshots(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    """New and removed nodes and edges, and nodes that changed their community."""
    (n0, e0), (n1, e1) = before, after
    moved = n0.select("qualified_name", F.col("community_id").alias("community_before")).join(n1.select("qualified_name", F.col("community_id").alias("community_after")), "qualified_name").where(~F.col("community_before").eqNullSafe(F.col("community_after")))
    return {"new_nodes": n1.join(n0, "qualified_name", "left_anti"), "removed_nodes": n0.join(n1, "qualified_name", "left_anti"), "new_edges": e1.join(e0, "edge", "left_anti"), "removed_edges": e0.join(e1, "edge", "left_anti"), "moved": moved}


def save_snapshot(snapshot: tuple[DataFrame, DataFrame], path: str) -> None:
    snapshot[0].write.mode("overwrite").json(f"{path}/nodes")
    snapshot[1].write.mode("overwrite").json(f"{path}/edges")


def load_snapshot(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("qualified_name string, kind string, file_path string, community_id long").json(f"{path}/nodes"), spark.read.schema("edge string").json(f"{path}/edges")


# Measures


def token_efficiency(raw: Column, graph_tokens: Column) -> Column:
    ratio = F.when(graph_tokens > 0, raw / graph_tokens).otherwise(0.0)
    return F.struct(rounded(ratio, 2).alias("ratio"), rounded(F.when(raw > 0, 100 * (1 - graph_tokens / raw)).otherwise(0.0), 2).alias("reduction_percent"))


def reciprocal_rank(results: DataFrame, correct: DataFrame) -> DataFrame:
    """results(query, item, rank), correct(query, item) to query, rr: 1 / rank of the first hit, 0 without."""
    hits = results.join(correct, ["query", "item"], "left_semi").groupBy("query").agg(F.min("rank").alias("rank"))
    return correct.select("query").distinct().join(hits, "query", "left").select("query", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))


def precision_recall(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """precision, recall, f1 of two sets; all 1 if both are empty."""
    p, a = predicted.select(key).distinct(), actual.select(key).distinct()
    n = lambda df: df.agg(F.count("*")).scalar()
    one = predicted.sparkSession.range(1).select(n(p).alias("p"), n(a).alias("a"), n(p.join(a, key, "left_semi")).alias("tp"))
    empty = (F.col("p") == 0) & (F.col("a") == 0)
    pr = lambda d: F.when(empty, 1.0).when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(0.0)
    out = one.select(pr("p").alias("precision"), pr("a").alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select(rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"), rounded(f1).alias("f1"))
