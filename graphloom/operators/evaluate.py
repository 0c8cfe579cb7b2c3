"""Measures of whole runs: recall of entry points, of two-step retrieval, seconds of a build; and warnings of a result."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, rounded

#: Over this risk a result warns; so many gaps and notes it names.
RISKY, GAPS_SHOWN, NOTES_SHOWN = 0.7, 5, 3


def warnings(gaps: Column, risk: Column, notes: Column) -> Column:
    """What to warn of: the first names without tests, a high risk, the first notes. Nulls give none."""
    listed = F.coalesce(gaps, F.array().cast("array<string>"))
    return F.array_compact(
        F.concat(
            F.array(F.when(F.size(listed) > 0, F.concat(F.lit("Test coverage gaps: "), F.array_join(F.slice(listed, 1, GAPS_SHOWN), ", ")))),
            F.array(F.when(risk > RISKY, F.format_string("High risk score (%.2f) — review carefully", risk))),
            F.slice(F.coalesce(notes, F.array().cast("array<string>")), 1, NOTES_SHOWN),
        )
    )


def flow_recall(flow_table: DataFrame, known: list[str]) -> DataFrame:
    """flows(entry, depth) against the names of entry points that are known: one row. known is a short list of a
    configuration; a name is found if any entry holds it."""
    names = sorted(set(known))
    found = reduce(add, [F.coalesce(F.max(F.col("entry").contains(n).cast("int")), F.lit(0)) for n in names], F.lit(0))
    return flow_table.agg(
        F.lit(len(names)).alias("known_entry_points"),
        found.alias("detected_entry_points"),
        rounded(found / max(len(names), 1), 3).alias("recall"),
        F.count("*").alias("detected_flows"),
        F.coalesce(rounded(F.avg("depth"), 1), F.lit(0.0)).alias("avg_flow_depth"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_flow_depth"),
    )


def multi_hop_recall(graph: Graph, tasks: DataFrame, hits: DataFrame, kind: str = "CALLS", incoming: bool = True) -> DataFrame:
    """tasks(task, suffix, expected array<string>), hits(task, qualified_name, rank): the anchor is the first hit that ends
    with the suffix; of what stands one edge away from it, which expected names (in any case) are there."""
    own, other = ("target", "source") if incoming else ("source", "target")
    fits = F.lower("qualified_name").endswith(F.lower("suffix"))
    anchors = hits.join(tasks, "task").where(fits).groupBy("task").agg(F.min(F.struct("rank", "qualified_name")).alias("first"))
    anchors = anchors.select("task", F.col("first.rank").alias("anchor_rank"), F.col("first.qualified_name").alias("anchor"))
    edges = graph.of_kind(kind).select(F.col(own).alias("anchor"), F.col(other).alias("qualified_name")).distinct()
    near = anchors.join(edges, "anchor").join(graph.nodes.select("qualified_name", F.lower("name").alias("name")), "qualified_name")
    counts = near.groupBy("task").agg(F.count("*").alias("neighbor_count"))
    asked = tasks.select("task", F.posexplode("expected").alias("place", "name")).select("task", F.lower("name").alias("name"))
    matched = asked.join(near.select("task", "name"), ["task", "name"], "left_semi").groupBy("task").agg(F.count("*").alias("matched_count"))
    joined = tasks.join(anchors, "task", "left").join(counts, "task", "left").join(matched, "task", "left").fillna(0, ["neighbor_count", "matched_count"])
    expected = F.greatest(F.size("expected"), F.lit(0))
    return joined.select(
        "task",
        F.col("anchor").isNotNull().alias("anchor_found"),
        F.coalesce("anchor_rank", F.lit(-1)).alias("anchor_rank"),
        "neighbor_count",
        expected.alias("expected_count"),
        "matched_count",
        F.when(expected > 0, rounded(F.col("matched_count") / expected, 3)).otherwise(0.0).alias("neighbor_recall"),
    )


def build_seconds(graph: Graph, steps: dict[str, Callable[[Graph], DataFrame]]) -> dict[str, float]:
    """Counts of a graph, the seconds that each step takes to run in full, and nodes a second of all steps."""
    sizes = {"node_count": graph.nodes.count(), "edge_count": graph.edges.count(), "file_count": graph.nodes.select("file_path").distinct().count()}
    seconds = {}
    for name, step in steps.items():
        began = time.perf_counter()
        step(graph).write.format("noop").mode("overwrite").save()
        seconds[f"{name}_seconds"] = round(time.perf_counter() - began, 3)
    return sizes | seconds | {"nodes_per_second": round(sizes["node_count"] / max(sum(seconds.values()), 0.001))}
