"""One-hop queries around a node, each by its name, and the resolution of what a user typed to a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import file_of
from graphloom.graph import Graph
from graphloom.operators import store
from graphloom.operators.traverse import transitive_tests

#: Names so common that a bare call of them says nothing (fixed values).
COMMON_BUILTINS = frozenset("print len str int float list dict set tuple range map filter sorted min max sum open type isinstance getattr setattr append join split get items keys values format log push pop forEach then catch toString".split())


def _ends(graph: Graph, kinds: tuple[str, ...], own: str, other: str, name: str) -> DataFrame:
    found = graph.of_kind(*kinds).where(F.col(own) == name).select(F.col(other).alias("qualified_name")).distinct()
    return graph.nodes.join(found, "qualified_name", "left_semi")


def callers_of(graph: Graph, name: str, bare: str | None = None, language: str | None = None) -> DataFrame:
    """Sources of CALLS into the node; with a bare name also callers of that name, marked unresolved. A call of a
    common builtin is never taken for one of the node."""
    found = _ends(graph, ("CALLS",), "target", "source", name).withColumn("unresolved", F.lit(False))
    if not bare or bare in COMMON_BUILTINS:
        return found
    loose = store.edges_by_target_name(graph, bare, "CALLS", language).select(F.col("source").alias("qualified_name")).distinct()
    loose = graph.nodes.join(loose, "qualified_name", "left_semi").join(found, "qualified_name", "left_anti")
    return found.unionByName(loose.withColumn("unresolved", F.lit(True)))


def references_to(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("REFERENCES",), "target", "source", name)


def callees_of(graph: Graph, name: str) -> DataFrame:
    """Targets of CALLS from the node; those without a node are shown as unresolved."""
    targets = graph.of_kind("CALLS").where(F.col("source") == name).select(F.col("target").alias("qualified_name")).distinct()
    return targets.join(graph.nodes, "qualified_name", "left").withColumn("unresolved", F.col("kind").isNull())


def imports_of(graph: Graph, name: str) -> DataFrame:
    return graph.of_kind("IMPORTS_FROM").where(F.col("source") == name).select("target")


def importers_of(graph: Graph, path: str, namespaces: tuple[str, ...] = ()) -> DataFrame:
    """Files that import the path, or one of the namespaces that it declares."""
    return graph.of_kind("IMPORTS_FROM").where((file_of(F.col("target")) == path) | F.col("target").isin(*namespaces)).select(F.col("file_path").alias("importer")).distinct()


def children_of(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("CONTAINS",), "source", "target", name)


def tests_for(graph: Graph, name: str, short: str, max_depth: int = 1) -> DataFrame:
    """Tests by edges, and by the names test_<name> and Test<name> (ten of each at most)."""
    by_edge = transitive_tests(graph, [name], max_depth).select(F.col("test").alias("qualified_name")).withColumn("by", F.lit("edge"))
    named = graph.nodes.where("is_test")
    by_name = [named.where(F.col("name").startswith(p)).select("qualified_name").orderBy("qualified_name").limit(10) for p in (f"test_{short}", f"Test{short}")]
    return by_edge.unionByName(by_name[0].union(by_name[1]).distinct().join(by_edge, "qualified_name", "left_anti").withColumn("by", F.lit("name")))


def inheritors_of(graph: Graph, name: str, bare: str | None = None) -> DataFrame:
    """Sources of INHERITS and IMPLEMENTS; by the bare name only if the qualified one has none."""
    found = _ends(graph, ("INHERITS", "IMPLEMENTS"), "target", "source", name)
    return _ends(graph, ("INHERITS", "IMPLEMENTS"), "target", "source", bare) if bare and found.isEmpty() else found


def triggers_of(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("TRIGGERS",), "source", "target", name)


def triggered_by(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("TRIGGERS",), "target", "source", name)


def publishers_of(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("PUBLISHES",), "target", "source", name)


def listeners_of(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("HANDLES",), "target", "source", name)


handlers_of = listeners_of


def endpoints_for(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, ("HANDLES",), "source", "target", name).where("kind = 'Endpoint'")


def consumers_of(graph: Graph, key: str) -> DataFrame:
    return store.config_consumers(graph, key).select("source").distinct()


def file_summary(graph: Graph, paths: list[str]) -> DataFrame:
    return graph.nodes.where(F.col("file_path").isin(paths))


PATTERNS = {f.__name__: f for f in (callers_of, references_to, callees_of, imports_of, importers_of, children_of, inheritors_of, triggers_of, triggered_by, publishers_of, listeners_of, endpoints_for, consumers_of)} | {"handlers_of": listeners_of}


def disambiguate(candidates: DataFrame, target: str) -> DataFrame:
    """Exact qualified name, exact name, qualified name that ends so, the rest; then by name."""
    q, n = F.col("qualified_name"), F.col("name")
    rank = F.when(q == target, 0).when(n == target, 1).when(q.endswith(f"::{target}") | q.endswith(f".{target}"), 2).otherwise(3)
    return candidates.withColumn("match_rank", rank).orderBy("match_rank", "qualified_name")


def resolve_target(graph: Graph, target: str, limit: int = 20) -> DataFrame:
    """The node meant by target: exact, else by Java name, else by search."""
    exact = store.get_node(graph, target)
    if not exact.isEmpty():
        return exact.withColumn("match_rank", F.lit(0))
    parts = target.split(".")
    java = graph.nodes.where((F.col("name") == parts[-1]) & (F.col("parent_name") == parts[-2])) if len(parts) > 1 else graph.nodes.limit(0)
    return disambiguate(java if not java.isEmpty() else store.search_nodes(graph, target, None), target).limit(limit)


def bounded(rows: DataFrame, most: int, order: list) -> tuple[DataFrame, int, bool]:
    """The first rows, how many there are, and whether some are left out."""
    total = rows.count()
    return rows.orderBy(*order).limit(most), total, total > most
