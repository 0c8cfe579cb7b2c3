"""Changes: from line ranges to nodes, their risk, and review reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, large, rounded
from graphloom.operators.flows import SECURITY_WORDS, affected_flows, criticality
from graphloom.operators.traverse import impact_radius, test_counts

#: Names of methods that a framework calls (fixed values).
LIFECYCLE = ("__init__", "__enter__", "__exit__", "__str__", "__repr__", "constructor", "ngOnInit", "ngOnDestroy", "componentDidMount", "componentWillUnmount", "render")


def parse_unified_diff(lines: DataFrame) -> DataFrame:
    """lines(n, line) of a diff without context to (file_path, line_start, line_end); a hunk of 0 lines has one.

    The file of a hunk is the last one named above it: lines are numbered, and their order is that of the whole diff. With a
    column diff, each of several diffs is read on its own, and is named in the result."""
    by = ["diff"] if "diff" in lines.columns else []
    own = lines.select(*by, "n", "line", F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1).alias("f"), F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 1).alias("s"), F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 2).alias("c"))
    own = own.where("f <> '' OR s <> ''").withColumn("file_path", F.last(F.when(F.col("f") != "", F.col("f")), ignorenulls=True).over(Window.partitionBy(*by).orderBy("n")))
    start, count = F.col("s").cast("long"), F.when(F.col("c") == "", 1).otherwise(F.col("c").cast("long"))
    return own.where("s <> ''").select(*by, "file_path", start.alias("line_start"), F.when(count == 0, start).otherwise(start + count - 1).alias("line_end"))


def parse_numstat(records: DataFrame) -> DataFrame:
    """records(commit, path) to commits per path."""
    return records.where("path IS NOT NULL AND path <> ''").dropDuplicates(["commit", "path"]).groupBy("path").agg(F.count("*").alias("commits"))


def changed_nodes(graph: Graph, ranges: DataFrame) -> DataFrame:
    """Nodes that overlap ranges(file_path, line_start, line_end): by equal path, else where a stored path ends so."""
    r = ranges.select(F.col("file_path").alias("f"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    files = graph.nodes.select("file_path").distinct()
    loose = r.join(files, r.f == files.file_path, "left_anti")
    # By the last path segment first, then by the whole suffix.
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    loose = loose.withColumn("k", last(F.col("f"))).join(files.withColumn("k", last(F.col("file_path"))), "k").where(F.col("file_path").endswith(F.concat(F.lit("/"), F.col("f")))).select(F.col("file_path").alias("f"), "a", "b")
    all_ = r.join(files, r.f == files.file_path, "left_semi").union(loose)
    n = graph.nodes
    return n.join(all_, (n.file_path == all_.f) & (n.line_start <= all_.b) & (n.line_end >= all_.a), "left_semi")


def node_at(graph: Graph, cursors: DataFrame) -> DataFrame:
    """cursors(file_path, line) to the innermost node that holds the line."""
    c = cursors.select(F.col("file_path").alias("f"), "line")
    n = graph.nodes
    inside = n.join(c, (n.file_path == c.f) & (n.line_start <= c.line) & (n.line_end >= c.line))
    best = Window.partitionBy("f", "line").orderBy(F.col("line_end") - F.col("line_start"), "qualified_name")
    return inside.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "f")


def risk(graph: Graph, nodes: DataFrame, flow_scores: DataFrame | None = None, churn: DataFrame | None = None, many: bool = False) -> DataFrame:
    """nodes with risk_score: flows up to .25, callers of other communities .15, missing tests (also of what they contain
    and call) .30 down to .05, security .20, callers .10, churn .15. flow_scores(node, criticality) has a row for each flow
    that passes a node: the sum of what is known counts, or .05 for each flow; churn(path, commits). many: nodes grow
    with the graph, so no join may send them through the driver."""
    sized = large if many else lambda df: df
    own = sized(nodes.select("qualified_name", "name", "file_path", "community_id"))
    calls = graph.of_kind("CALLS").select(F.col("source").alias("caller"), F.col("target").alias("qualified_name")).join(own.select("qualified_name"), "qualified_name", "left_semi")
    callers = calls.groupBy("qualified_name").agg(F.count("*").alias("callers"))
    community = graph.nodes.select(F.col("qualified_name").alias("caller"), F.col("community_id").alias("cc"))
    crossing = calls.distinct().join(large(community), "caller").join(own.select("qualified_name", "community_id"), "qualified_name").where("cc <> community_id").groupBy("qualified_name").agg(F.count("*").alias("crossing"))
    tests = sized(test_counts(graph, nodes, many=many))
    joined = own.join(callers, "qualified_name", "left").join(crossing, "qualified_name", "left").join(tests, "qualified_name", "left")
    if flow_scores is not None:
        joined = joined.join(flow_scores.groupBy(F.col("node").alias("qualified_name")).agg(F.coalesce(F.sum("criticality"), F.count("*") * 0.05).alias("flow")), "qualified_name", "left")
    else:
        joined = joined.withColumn("flow", F.lit(0.0))
    joined = joined.join(churn.toDF("file_path", "commits"), "file_path", "left") if churn is not None else joined.withColumn("commits", F.lit(0))
    joined = joined.fillna(0, ["callers", "crossing", "tests", "commits"]).fillna(0.0, ["flow"])
    cap = lambda x, most: F.least(x, F.lit(most))
    secure = F.lower(F.concat_ws(" ", "name", "qualified_name")).rlike("|".join(SECURITY_WORDS))
    score = cap(F.col("flow"), 0.25) + cap(F.col("crossing") * 0.05, 0.15) + (0.3 - cap(F.col("tests") / 5, 1.0) * 0.25) + F.when(secure, 0.2).otherwise(0.0) + cap(F.col("callers") / 20, 0.1) + cap(F.col("commits") / 10, 1.0) * 0.15
    return joined.select("qualified_name", "name", "file_path", rounded(cap(score, 1.0)).alias("risk_score"), "callers", "tests")


def test_gaps(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Functions without a test, without tests themselves and lifecycle methods."""
    tested = graph.of_kind("TESTED_BY").select(F.col("source").alias("qualified_name"))
    return nodes.where((F.col("kind") == "Function") & ~F.col("is_test") & ~F.col("name").isin(*LIFECYCLE)).join(tested, "qualified_name", "left_anti")


def analyze(graph: Graph, ranges: DataFrame, steps: DataFrame | None = None, churn: DataFrame | None = None, most: int = 500) -> dict[str, DataFrame]:
    """The parts of a change report: changed functions with their risk, priorities, gaps, affected flows and a summary."""
    hit = changed_nodes(graph, ranges).where("kind <> 'File'")
    scores = None if steps is None else steps.select("entry", "node").distinct().join(criticality(graph, steps).select("entry", "criticality"), "entry").select("node", "criticality")
    scored = risk(graph, hit, scores, churn)
    parts = {"changed": scored.orderBy(F.desc("risk_score"), "qualified_name").limit(most), "priorities": scored.orderBy(F.desc("risk_score"), "qualified_name").limit(10), "gaps": test_gaps(graph, hit)}
    if steps is not None:
        parts["flows"] = affected_flows(graph, steps, hit.select("file_path").distinct())
    parts["summary"] = scored.agg(F.count("*").alias("changed"), F.max("risk_score").alias("risk"), F.countDistinct("file_path").alias("files"))
    return parts


def merged_ranges(ranges: DataFrame, most: int | None = None) -> DataFrame:
    """ranges(file_path, line_start, line_end) with overlapping and adjacent ones joined; of each file the first `most` lines."""
    by = Window.partitionBy("file_path").orderBy("line_start", "line_end")
    reach = F.max("line_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = ranges.withColumn("new", F.coalesce(F.col("line_start") > reach + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by))
    joined = own.groupBy("file_path", "island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    if most is not None:
        before = F.coalesce(F.sum(F.col("line_end") - F.col("line_start") + 1).over(Window.partitionBy("file_path").orderBy("line_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        joined = joined.withColumn("before", before).where(F.col("before") < most).withColumn("line_end", F.least("line_end", F.col("line_start") + most - F.col("before") - 1))
    return joined.select("file_path", "line_start", "line_end")


def review_guidance(graph: Graph, files: list[str]) -> DataFrame:
    """Messages: many untested changes, over 20 affected nodes, inheritance touched, over three files."""
    own = graph.nodes.where(F.col("file_path").isin(files))
    n = lambda df: df.agg(F.count("*")).scalar()
    gaps, affected = n(test_gaps(graph, own)), n(impact_radius(graph, files, limit=None))
    inherited = n(graph.of_kind("INHERITS", "IMPLEMENTS").join(own.select(F.col("qualified_name").alias("target")), "target", "left_semi"))
    one = graph.nodes.sparkSession.range(1)
    messages = [F.when(gaps > 0, F.format_string("%d changed functions have no tests", gaps)), F.when(affected > 20, F.format_string("%d nodes may be affected", affected)), F.when(inherited > 0, F.format_string("%d subtypes depend on changed types", inherited)), F.when(F.lit(len(files) > 3), F.lit(f"{len(files)} files change together"))]
    return one.select(F.explode(F.array_compact(F.array(*messages))).alias("message"))


def minimal_context(graph: Graph, files: list[str]) -> DataFrame:
    """Size of the graph, the largest risk of the changed nodes and its bucket."""
    own = graph.nodes.where(F.col("file_path").isin(files) & (F.col("kind") != "File"))
    worst = risk(graph, own).agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("risk"))
    bucket = F.when(F.col("risk") > 0.7, "high").when(F.col("risk") > 0.4, "medium").otherwise("low")
    return worst.select("risk", bucket.alias("bucket"), graph.nodes.agg(F.count("*")).scalar().alias("nodes"), graph.edges.agg(F.count("*")).scalar().alias("edges"))


