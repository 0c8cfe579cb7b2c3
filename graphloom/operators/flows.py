"""Execution flows: entry points, traces along calls, criticality."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_test_file
from graphloom.graph import Graph, durable, rounded
from graphloom.operators.traverse import LAZY_HOPS

# Names of entry points, in any language and in one; decorators of entry points, without regard to case and
# with it; words that concern security.
ENTRY_NAMES = (
    r"^main$",
    r"^__main__$",
    r"^test_",
    r"^Test[A-Z]",
    r"^on_",
    r"^handle_",
    r"^handler$",
    r"^handle$",
    r"^lambda_handler$",
    r"^upgrade$",
    r"^downgrade$",
    r"^lifespan$",
    r"^get_db$",
    r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)",
    r"^do(Get|Post|Put|Delete)$",
    r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$",
    r"^log_message$",
    r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$",
    r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$",
    r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$",
    r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
)
ENTRY_NAMES_OF = {"php": (r"^(boot|register)$", r"^__invoke$")}
ENTRY_DECORATORS = (
    r"app\.(get|post|put|delete|patch|route|websocket|on_event)",
    r"router\.(get|post|put|delete|patch|route)",
    r"blueprint\.(route|before_request|after_request)",
    r"(before|after)_(request|response)",
    r"click\.(command|group)",
    r"\w+\.(command|group)\b",
    r"(field|model)_(serializer|validator)",
    r"(celery\.)?(task|shared_task|periodic_task)",
    r"receiver",
    r"api_view",
    r"\baction\b",
    r"(override_settings|modify_settings)",
    r"(event\.)?listens_for",
    r"(Get|Post|Put|Delete|Patch|RequestMapping)Mapping",
    r"(Scheduled|EventListener|Bean|Configuration)",
    r"KafkaListener",
    r"(WorkflowMethod|ActivityMethod)",
    r"(Component|Injectable|Controller|Module|Guard|Pipe)",
    r"(Subscribe|Mutation|Query|Resolver)",
    r"@(Override|OnLifecycleEvent|Composable)",
    r"(HiltViewModel|AndroidEntryPoint|Inject)",
    r"\w+\.(tool|tool_plain|system_prompt|result_validator)\b",
    r"\w+\.(middleware|exception_handler|on_exception)\b",
    r"\w+\.route\b",
)
ENTRY_DECORATORS_EXACT = (r"pytest\.(fixture|mark)", r"(app|router)\.(get|post|put|delete|patch|use|all)\b", r"^tool\b")
SECURITY_WORDS = "auth login password token session crypt secret credential permission sql query execute connect socket request http sanitize validate encrypt decrypt hash sign verify admin privilege".split()


def has_entry_name(name: Column, language: Column) -> Column:
    """Whether a name is one of the entry points' names, in any language or in this one."""
    of_language = [(language == own) & name.rlike("|".join(patterns)) for own, patterns in ENTRY_NAMES_OF.items()]
    return F.coalesce(functools.reduce(lambda a, b: a | b, of_language, name.rlike("|".join(ENTRY_NAMES))), F.lit(False))


def has_entry_decorator(extra: Column) -> Column:
    """Whether a decorator in extra (a list of them or one string) is that of an entry point."""
    one = F.get_json_object(extra, "$.decorators")
    several = F.coalesce(F.from_json(one, "array<string>"), F.array(one))
    entry = lambda d: d.rlike("(?i)" + "|".join(ENTRY_DECORATORS)) | d.rlike("|".join(ENTRY_DECORATORS_EXACT))
    return F.coalesce(F.exists(several, entry), F.lit(False))


def entry_points(graph: Graph, include_tests: bool = False) -> DataFrame:
    """Functions that nobody calls (calls by files don't count), or with the name or decorator of an entry point."""
    called = graph.of_kind("CALLS").join(graph.nodes.where("kind = 'File'").select(F.col("qualified_name").alias("source")), "source", "left_anti").select(F.col("target").alias("qualified_name")).distinct().withColumn("called", F.lit(True))
    found = graph.nodes.where(F.col("kind").isin("Function", "Test")).join(called, "qualified_name", "left")
    marked = has_entry_name(F.col("name"), F.col("language") if "language" in graph.nodes.columns else F.lit(None).cast("string"))
    if "extra" in graph.nodes.columns:
        marked = marked | has_entry_decorator(F.col("extra"))
        found = found.where(F.get_json_object("extra", "$.verilog_kind").isNull())
    found = found.where(F.col("called").isNull() | marked)
    return (found if include_tests else found.where(~F.col("is_test") & ~is_test_file(F.col("file_path")))).drop("called")


def trace_flows(graph: Graph, entries: DataFrame | None = None, max_depth: int = 15) -> DataFrame:
    """(entry, node, depth, position) of each flow of two nodes or more: breadth first along CALLS to nodes that exist,
    every node once, in the order (depth, place of the caller, name)."""
    entries = entry_points(graph) if entries is None else entries
    known = graph.nodes.select(F.col("qualified_name").alias("target"))
    calls = graph.of_kind("CALLS").join(known, "target", "left_semi").select("source", "target").distinct()
    if max_depth > LAZY_HOPS:
        calls = durable(calls)
    # last: how many places a flow has used, known in each of its rows.
    level = entries.select(F.col("qualified_name").alias("entry"), F.col("qualified_name").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("last"))
    level = durable(level) if max_depth > LAZY_HOPS else level
    found = level
    for depth in range(1, max_depth + 1):
        nexts = level.join(calls, level.node == calls.source).groupBy("entry", F.col("target").alias("node")).agg(F.min("position").alias("caller"), F.max("last").alias("last"))
        nexts = nexts.join(found.select("entry", "node"), ["entry", "node"], "left_anti")
        own = Window.partitionBy("entry")
        place = (F.row_number().over(own.orderBy("caller", "node")) + F.col("last")).cast("long")
        level = nexts.select("entry", "node", F.lit(depth).alias("depth"), place.alias("position"), (F.count("*").over(own) + F.col("last")).alias("last"))
        if max_depth > LAZY_HOPS:
            level = durable(level)
            if level.isEmpty():
                break
        found = found.union(level)
    found = found.drop("last")
    long_enough = found.where("depth > 0").select("entry").distinct()
    return found.join(long_enough, "entry", "left_semi")


def criticality(graph: Graph, steps: DataFrame) -> DataFrame:
    """entry, depth, node_count, file_count, criticality of the flows in steps(entry, node, depth, position):
    .3 file spread, .2 calls out of the graph, .25 security words, .15 missing tests, .1 depth."""
    own = graph.nodes.select(F.col("qualified_name").alias("node"), "name", "file_path")
    tested = graph.of_kind("TESTED_BY").select(F.col("source").alias("node")).distinct().withColumn("tested", F.lit(1))
    known = graph.nodes.select(F.col("qualified_name").alias("target"))
    outside = graph.of_kind("CALLS").join(known, "target", "left_anti").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outside"))
    text = F.lower(F.concat_ws(" ", "name", "node"))
    secure = text.rlike("|".join(SECURITY_WORDS)).cast("int")
    joined = steps.join(own, "node").join(tested, "node", "left").join(outside, "node", "left").fillna(0, ["tested", "outside"]).withColumn("secure", secure)
    sums = joined.groupBy("entry").agg(F.max("depth").alias("depth"), F.count("*").alias("node_count"), F.countDistinct("file_path").alias("file_count"), F.sum("outside").alias("outside"), F.sum("secure").alias("secure"), F.sum("tested").alias("tested"))
    cap = lambda x: F.least(x, F.lit(1.0))
    n = F.col("node_count")
    score = 0.3 * cap((F.col("file_count") - 1) / 4) + 0.2 * cap(F.col("outside") / 5) + 0.25 * (F.col("secure") / n) + 0.15 * (1 - F.col("tested") / n) + 0.1 * cap(F.col("depth") / 10)
    return sums.select("entry", "depth", "node_count", "file_count", rounded(score).alias("criticality"))


def flows(graph: Graph, steps: DataFrame, sort_by: str = "criticality", limit: int | None = 50) -> DataFrame:
    found = criticality(graph, steps).join(graph.nodes.select(F.col("qualified_name").alias("entry"), "name"), "entry")
    return found if limit is None else found.orderBy(F.col(sort_by) if sort_by == "name" else F.desc(sort_by), "entry").limit(limit)


def flow_rows(graph: Graph, steps: DataFrame) -> DataFrame:
    """Flows as stored: with their path in order."""
    path = steps.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "node"))), lambda s: s["node"]).alias("path"))
    return flows(graph, steps, limit=None).join(path, "entry").withColumn("flow_id", F.xxhash64("entry"))


def memberships(flow_table: DataFrame) -> DataFrame:
    """(flow_id, node, position), each node of a flow once."""
    return flow_table.select("flow_id", F.posexplode("path").alias("position", "node")).groupBy("flow_id", "node").agg(F.min("position").alias("position"))


def flows_of_nodes(flow_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qualified_name, flow_id, entry, criticality): the flows that pass each of nodes(qualified_name), once each."""
    own = memberships(flow_table).join(nodes.select(F.col("qualified_name").alias("node")).distinct(), "node")
    return own.join(flow_table.select("flow_id", "entry", "criticality"), "flow_id").select(F.col("node").alias("qualified_name"), "flow_id", "entry", "criticality")


def flow_by_id(graph: Graph, flow_table: DataFrame, flow_id: int, max_steps: int = 50) -> DataFrame:
    steps = memberships(flow_table.where(F.col("flow_id") == flow_id))
    return steps.join(graph.nodes, steps.node == graph.nodes.qualified_name).orderBy("position").limit(max_steps)


def affected_flows(graph: Graph, steps: DataFrame, files: list[str] | DataFrame) -> DataFrame:
    """Flows that pass a node of the changed files, a list or a DataFrame(file_path) of any length."""
    own = graph.nodes.join(files, "file_path", "left_semi") if isinstance(files, DataFrame) else graph.nodes.where(F.col("file_path").isin(files))
    touched = own.select(F.col("qualified_name").alias("node"))
    hit = steps.join(touched, "node", "left_semi").select("entry").distinct()
    return flows(graph, steps.join(hit, "entry", "left_semi"), limit=None)


def retrace(graph: Graph, steps: DataFrame, files: list[str], max_depth: int = 15) -> DataFrame:
    """steps after a change of these files: flows that touch them are traced again, with the entries that they hold."""
    touched = graph.nodes.where(F.col("file_path").isin(files)).select(F.col("qualified_name").alias("node"))
    gone = steps.join(graph.nodes.select(F.col("qualified_name").alias("node")), "node", "left_anti").select("entry")
    stale = durable(steps.join(touched, "node", "left_semi").select("entry").union(gone).distinct())
    entries = entry_points(graph)
    again = entries.join(stale.select(F.col("entry").alias("qualified_name")), "qualified_name", "left_semi").union(entries.where(F.col("file_path").isin(files))).dropDuplicates(["qualified_name"])
    # Entries that no flow had, and flows whose entry is one no longer.
    new = entries.join(steps.select(F.col("entry").alias("qualified_name")).distinct(), "qualified_name", "left_anti")
    again = again.union(new).dropDuplicates(["qualified_name"])
    kept = steps.join(stale, "entry", "left_anti").join(entries.select(F.col("qualified_name").alias("entry")), "entry", "left_semi")
    return kept.join(again.select(F.col("qualified_name").alias("entry")), "entry", "left_anti").unionByName(trace_flows(graph, again, max_depth).select(*kept.columns))


def within_steps(listed: DataFrame, budget: int = 400) -> DataFrame:
    """flows(entry, criticality, path) most critical first until their steps use up the budget; the flow at the border
    is cut, and the number of steps left out is told."""
    before = F.coalesce(F.sum(F.size("path")).over(Window.orderBy(F.desc("criticality"), "entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), budget - F.col("before")).cast("int")
    return listed.orderBy(F.desc("criticality"), "entry").limit(budget).withColumn("before", before).withColumn("shown", F.slice("path", F.lit(1), room)).withColumn("steps_omitted", F.size("path") - F.size("shown")).drop("before")
