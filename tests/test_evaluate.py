"""Measures of whole runs at their edges."""

from pyspark.sql import functions as F

from graphloom.operators import evaluate
from graphloom.sources import tables


def test_warnings_of_nulls_long_lists_and_borders(spark):
    rows = [(1, None, None, None), (2, list("abcdef"), 0.7, ["n"] * 5), (3, [], 0.75, [])]
    df = spark.createDataFrame(rows, "id int, gaps array<string>, risk double, notes array<string>")
    found = {r.id: r.w for r in df.select("id", evaluate.warnings(F.col("gaps"), F.col("risk"), F.col("notes")).alias("w")).collect()}
    assert found == {1: [], 2: ["Test coverage gaps: a, b, c, d, e", "n", "n", "n"], 3: ["High risk score (0.75) — review carefully"]}


def test_recall_without_flows_or_names(spark):
    none = spark.createDataFrame([], "entry string, depth int")
    assert tuple(evaluate.flow_recall(none, ["main"]).first()) == (1, 0, 0.0, 0, 0.0, 0)
    assert tuple(evaluate.flow_recall(spark.createDataFrame([("a::main", 2), ("b::run", 3)], none.schema), []).first()) == (0, 0, 0.0, 2, 2.5, 3)


def test_tasks_without_hits_or_expectations(spark):
    g = tables.graph(spark, "/root/testdata/sf0.001")
    tasks = spark.createDataFrame([("a", "x", ["y"]), ("b", "x", []), ("c", "x", None)], "task string, suffix string, expected array<string>")
    hits = spark.createDataFrame([("b", "p::X", 3)], "task string, qualified_name string, rank int")
    found = sorted(tuple(r) for r in evaluate.multi_hop_recall(g, tasks, hits).collect())
    assert found == [("a", False, -1, 0, 1, 0, 0.0), ("b", True, 3, 0, 0, 0, 0.0), ("c", False, -1, 0, 0, 0, 0.0)]


def test_build_seconds_names_each_step(spark):
    made = evaluate.build_seconds(tables.graph(spark, "/root/testdata/sf0.001"), {"names": lambda g: g.nodes.select("name")})
    assert set(made) == {"node_count", "edge_count", "file_count", "names_seconds", "nodes_per_second"} and made["nodes_per_second"] > 0
