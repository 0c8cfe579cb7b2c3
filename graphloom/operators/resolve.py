"""Entity resolution: from names as written to nodes, by evidence. Every pass may run again without further effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import file_of
from graphloom.graph import Graph, large

CANDIDATES = 20


def _edge_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_id", F.xxhash64("kind", "source", "target", "file_path", "line"))


def resolve_bare_endpoints(graph: Graph, kind: str, endpoint: str) -> DataFrame:
    """Edges with bare ends of this kind resolved where exactly one node of that name is in the same file or in one that
    the file imports; several leave their names in ambiguous_targets. A name that is unique in the graph is no evidence."""
    edges = _edge_id(graph.edges)
    bare = edges.where((F.col("kind") == kind) & ~F.col(endpoint).contains("::")).select("_id", F.col("file_path").alias("context"), F.col(endpoint).alias("name")).distinct()
    nodes = graph.nodes.where(F.col("kind").isin("Function", "Test", "Class")).select("name", "qualified_name", F.col("file_path").alias("home"))
    imports = graph.of_kind("IMPORTS_FROM").select(F.col("file_path").alias("context"), file_of(F.col("target")).alias("home")).distinct()
    imports = imports.union(bare.select("context", F.col("context").alias("home"))).distinct()
    # The file and the name at once: a name that many files have would meet all its nodes.
    supported = bare.join(imports, "context").join(large(nodes), ["name", "home"])
    found = supported.groupBy("_id").agg(F.array_sort(F.collect_set("qualified_name")).alias("names"))
    joined = edges.join(large(found), "_id", "left")
    new = F.when(F.size("names") == 1, F.col("names")[0]).otherwise(F.col(endpoint))
    ambiguous = F.when(F.size("names") > 1, F.slice("names", 1, CANDIDATES))
    return joined.withColumn(endpoint, new).withColumn("ambiguous_targets", ambiguous).drop("_id", "names")


def resolve_bare_calls(graph: Graph) -> DataFrame:
    return resolve_bare_endpoints(graph, "CALLS", "target")


def resolve_bare_tests(graph: Graph) -> DataFrame:
    return resolve_bare_endpoints(graph, "TESTED_BY", "source")


def suffix_index(files: DataFrame) -> DataFrame:
    """files(file_path) to (module, file_path): each dotted suffix of a Python file's module path."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\.pyi?$", ""), "/__init__$", "")
    parts = F.split(path, "/")
    own = files.where(F.col("file_path").rlike(r"\.pyi?$")).select("file_path", parts.alias("parts"))
    return own.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))).alias("module"))


def resolve_python_imports(graph: Graph) -> DataFrame:
    """Import edges whose target is a module: the file whose path is its only match; else the candidates."""
    files = graph.nodes.where("kind = 'File'").select("file_path").distinct()
    modules = suffix_index(files).groupBy("module").agg(F.array_sort(F.collect_set("file_path")).alias("files"))
    edges = graph.edges.withColumn("module", F.when((F.col("kind") == "IMPORTS_FROM") & ~F.col("target").contains("/"), F.col("target")))
    joined = edges.join(modules, "module", "left")
    one = F.when(F.size("files") == 1, F.col("files")[0]).otherwise(F.col("target"))
    return joined.withColumn("target", one).withColumn("ambiguous_targets", F.when(F.size("files") > 1, F.slice("files", 1, CANDIDATES))).drop("module", "files")


def fold(language, name):
    """Names as their language compares them: PHP without regard to case."""
    return F.when(language == "php", F.lower(name)).otherwise(name)


def resolve_scoped_calls(graph: Graph) -> DataFrame:
    """Class::method calls of PHP, Rust and C#: the only method of that class and name in the language, else the only
    one in an imported file. Resolved edges are INFERRED."""
    from graphloom.functions.text import scoped_parts

    own = graph.nodes.select(F.col("qualified_name").alias("source"), "language", F.col("parent_name").alias("own_class"))
    edges = _edge_id(graph.edges)
    calls = edges.where("kind = 'CALLS'").join(own.where(F.col("language").isin("php", "rust", "csharp")), "source").withColumn("parts", scoped_parts(F.col("target"), F.col("language"))).where("parts IS NOT NULL")
    scope = F.substring_index(F.col("parts.scope"), "::", -1)
    scope = F.when(scope.isin("Self", "static", "self"), F.col("own_class")).otherwise(scope)
    asked = calls.select("_id", "file_path", "language", fold(F.col("language"), scope).alias("c"), fold(F.col("language"), F.col("parts.method")).alias("m"))
    methods = graph.nodes.where("parent_name IS NOT NULL").select("language", fold(F.col("language"), F.col("parent_name")).alias("c"), fold(F.col("language"), F.col("name")).alias("m"), "qualified_name", F.col("file_path").alias("home"))
    imports = graph.of_kind("IMPORTS_FROM").select("file_path", file_of(F.col("target")).alias("home")).distinct().withColumn("imported", F.lit(True))
    matched = asked.join(methods, ["language", "c", "m"]).join(imports, ["file_path", "home"], "left")
    agreed = matched.groupBy("_id").agg(F.collect_set("qualified_name").alias("all"), F.collect_set(F.when(F.col("imported") | (F.col("file_path") == F.col("home")), F.col("qualified_name"))).alias("near"))
    pick = F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("near") == 1, F.col("near")[0])
    joined = edges.join(agreed.select("_id", pick.alias("found")), "_id", "left")
    tier = F.col("confidence_tier") if "confidence_tier" in graph.edges.columns else F.lit("EXTRACTED")
    return joined.withColumn("confidence_tier", F.when(F.col("found").isNotNull(), "INFERRED").otherwise(tier)).withColumn("target", F.coalesce("found", "target")).drop("_id", "found")


def resolve_cpp_scoped_calls(graph: Graph) -> DataFrame:
    """Scope::call of C++: the scopes around the caller from the innermost out; the first with candidates decides, one
    resolves and several are ambiguous."""
    own = graph.nodes.where("language = 'cpp'").select(F.col("qualified_name").alias("source"), F.coalesce("parent_name", F.lit("")).alias("around"))
    edges = _edge_id(graph.edges)
    calls = edges.where((F.col("kind") == "CALLS") & F.col("target").contains("::") & ~F.col("target").contains("/")).join(own, "source")
    scopes = F.filter(F.split("around", "::"), lambda s: s != "")
    written, method = F.regexp_replace("target", "::[^:]*$", ""), F.substring_index("target", "::", -1)
    tries = F.transform(F.sequence(F.size("scopes"), F.lit(0)), lambda k: F.struct((F.size("scopes") - k).alias("r"), F.array_join(F.concat(F.slice("scopes", F.lit(1), k), F.array("written")), "::").alias("p")))
    asked = calls.withColumn("scopes", scopes).withColumn("written", written).withColumn("method", method).select("_id", "method", F.explode(tries).alias("t")).select("_id", "method", "t.r", "t.p")
    nodes = graph.nodes.where("language = 'cpp'").select(F.col("name").alias("method"), F.col("parent_name").alias("p"), "qualified_name")
    found = asked.join(nodes, ["method", "p"]).withColumn("first", F.min("r").over(Window.partitionBy("_id"))).where("r = first").groupBy("_id").agg(F.array_sort(F.collect_set("qualified_name")).alias("names"))
    joined = edges.join(found, "_id", "left")
    return joined.withColumn("target", F.when(F.size("names") == 1, F.col("names")[0]).otherwise(F.col("target"))).withColumn("ambiguous_targets", F.when(F.size("names") > 1, F.slice("names", 1, CANDIDATES))).drop("_id", "names")


def resolve_injected_calls(graph: Graph, fields: DataFrame, only_one: bool = True) -> DataFrame:
    """receiver.method calls through an injected field: fields(class, field, type). With exactly one implementor of the
    type its method, else the type's own; a method without node becomes `Type.method`."""
    calls = _edge_id(graph.edges).where("kind = 'CALLS'")
    own = graph.nodes.select(F.col("qualified_name").alias("source"), F.col("parent_name").alias("class"))
    asked = calls.where(F.col("target").rlike(r"^\w+\.\w+$")).join(own, "source").select("_id", "class", F.substring_index("target", ".", 1).alias("field"), F.substring_index("target", ".", -1).alias("method"))
    typed = asked.join(fields, ["class", "field"])
    implementors = graph.of_kind("INHERITS", "IMPLEMENTS").groupBy(F.substring_index(F.regexp_replace("target", "^.*::", ""), ".", -1).alias("type")).agg(F.countDistinct("source").alias("n"), F.min(F.regexp_replace("source", "^.*::", "")).alias("only"))
    holder = typed.join(implementors, "type", "left").withColumn("holder", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("type")))
    methods = graph.nodes.where("parent_name IS NOT NULL").groupBy(F.col("parent_name").alias("holder"), F.col("name").alias("method")).agg(F.max("qualified_name").alias("found"))
    found = holder.join(methods, ["holder", "method"], "left").groupBy("_id").agg(F.min(F.coalesce("found", F.concat("holder", F.lit("."), "method"))).alias("found"))
    joined = _edge_id(graph.edges).join(found, "_id", "left")
    return joined.withColumn("target", F.coalesce("found", "target")).drop("_id", "found")


def injected_fields(graph: Graph, kind: str = "INJECTS") -> DataFrame:
    """(class, field, type) of edges that inject a type into a class's field."""
    return graph.of_kind(kind).select(F.regexp_replace("source", "^.*::", "").alias("class"), F.get_json_object("extra", "$.field_name").alias("field"), F.regexp_replace("target", "^.*::", "").alias("type")).where("field IS NOT NULL").distinct()


def resolve_spring_calls(graph: Graph) -> DataFrame:
    return resolve_injected_calls(graph, injected_fields(graph))


def resolve_temporal_calls(graph: Graph) -> DataFrame:
    return resolve_injected_calls(graph, injected_fields(graph, "TEMPORAL_STUB"))


def event_calls(graph: Graph) -> DataFrame:
    """Derived CALLS from each publisher of an event to each of its listeners (confidence .95, INFERRED); earlier derived
    ones are dropped first. Publishers of the same events are a class, as are listeners to the same ones; blocks of both
    meet, and are opened only in the task that gives the rows, so no pair is shuffled or compared."""
    spark = graph.edges.sparkSession

    def blocks(ends: DataFrame, events: str, i: str, *columns: str) -> DataFrame:
        """(events, i, members): the rows of a class in some 256 a block."""
        sizes = ends.groupBy(events).agg(F.ceil(F.count("*") / 256).alias("n"))
        dealt = ends.join(sizes, events).withColumn(i, F.pmod(F.xxhash64(*columns), F.col("n")))
        return dealt.groupBy(events, i).agg(F.collect_list(F.struct(*columns)).alias(f"{events}_by"))

    publishes = graph.of_kind("PUBLISHES").groupBy("source", "file_path", "line").agg(F.array_sort(F.collect_set("target")).alias("said"))
    handles = graph.of_kind("HANDLES").groupBy(F.col("source").alias("target")).agg(F.array_sort(F.collect_set("target")).alias("heard"))
    opened = lambda ends, events: ends.select(events).distinct().select(events, F.explode(events).alias("event"))
    met = opened(publishes, "said").join(opened(handles, "heard"), "event").groupBy("said", "heard").agg(F.min("event").alias("event"))
    both = met.join(blocks(publishes, "said", "i", "source", "file_path", "line"), "said").join(blocks(handles, "heard", "j", "target"), "heard")
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "said", "i", "heard", "j")
    pairs = both.select("event", F.explode("said_by").alias("p"), "heard_by").select("event", "p.*", F.explode("heard_by").alias("h")).select("event", "source", "file_path", "line", "h.target")
    made = pairs.select(F.lit("CALLS").alias("kind"), "source", "target", "file_path", "line", F.lit(0.95).alias("confidence"), F.lit("INFERRED").alias("confidence_tier"), F.to_json(F.struct(F.lit("event").alias("derived"), "event")).alias("extra"))
    kept = graph.edges.where(~F.coalesce(F.get_json_object("extra", "$.derived") == "event", F.lit(False))) if "extra" in graph.edges.columns else graph.edges
    return kept.unionByName(made, allowMissingColumns=True)


def resolve_module_references(graph: Graph) -> DataFrame:
    """Configuration modules: a name that is unique in the same directory, or a local module path as its main.tf, else
    its first file."""
    files = graph.nodes.where("kind = 'File' AND file_path LIKE '%.tf'").select("file_path", F.regexp_replace("file_path", "/[^/]*$", "").alias("dir"))
    main = files.groupBy("dir").agg(F.min_by("file_path", F.struct((~F.col("file_path").endswith("/main.tf")).alias("o"), "file_path")).alias("main"))
    edges = _edge_id(graph.edges)
    refs = edges.where((F.col("kind") == "IMPORTS_FROM") & F.col("target").rlike(r"^\.\.?/")).withColumn("from", F.regexp_replace("file_path", "/[^/]*$", ""))
    joined = F.concat_ws("/", "from", "target")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/+$", ""), r"[^/]+/\.\./", "")
    by_path = refs.select("_id", clean.alias("dir")).join(main, "dir").select("_id", F.col("main").alias("found"))
    named = graph.nodes.where("language = 'hcl' AND kind <> 'File'").select("name", F.regexp_replace("file_path", "/[^/]*$", "").alias("dir"), "qualified_name").groupBy("name", "dir").agg(F.count("*").alias("n"), F.min("qualified_name").alias("found")).where("n = 1")
    by_name = edges.where("kind = 'REFERENCES'").select("_id", F.col("target").alias("name"), F.regexp_replace("file_path", "/[^/]*$", "").alias("dir")).join(named, ["name", "dir"]).select("_id", "found")
    return edges.join(by_path.union(by_name).groupBy("_id").agg(F.min("found").alias("found")), "_id", "left").withColumn("target", F.coalesce("found", "target")).drop("_id", "found")


def longest_tail(targets: DataFrame, known: DataFrame) -> DataFrame:
    """targets(target) to the known(qualified_name tail `alias`) that matches the longest tail of its dotted parts."""
    parts = F.split("target", r"\.")
    tails = targets.select("target", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("p", "alias"))
    return tails.join(known, "alias").groupBy("target").agg(F.min_by("qualified_name", F.struct("p", "qualified_name")).alias("qualified_name"))


def resolve_module_calls(graph: Graph) -> DataFrame:
    """Module.function calls of languages whose modules are files: by base name (.res before .resi), longest tail first."""
    files = graph.nodes.where("language = 'rescript'").select("qualified_name", F.regexp_extract("file_path", r"([^/]+)\.resi?$", 1).alias("module"), "name", F.col("file_path").endswith("i").alias("interface"))
    known = files.groupBy(F.concat_ws(".", "module", "name").alias("alias")).agg(F.min_by("qualified_name", F.struct("interface", "qualified_name")).alias("qualified_name"))
    found = longest_tail(graph.of_kind("CALLS").where(F.col("target").contains(".")).select("target").distinct(), known)
    return graph.edges.join(found.withColumnRenamed("qualified_name", "found"), "target", "left").withColumn("target", F.coalesce("found", "target")).drop("found")


def name_index(nodes: DataFrame) -> DataFrame:
    """(alias, qualified_name): the name, file::name, the dotted module, and of files each path suffix."""
    parts = F.split("file_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tail = F.concat(F.element_at(parts, -1), F.lit("::"), F.col("name"))
    dotted = F.replace(F.regexp_replace("file_path", r"\.\w+$", ""), F.lit("/"), F.lit("."))
    return nodes.select("qualified_name", F.explode(F.array_distinct(F.when(F.col("kind") == "File", F.concat(suffixes, F.array("name", dotted))).otherwise(F.array(F.col("name"), tail, F.concat(dotted, F.lit("."), F.col("name")))))).alias("alias")).distinct()


def link_targets(graph: Graph) -> DataFrame:
    """Edges with target_node by best effort: the node itself, a unique alias, one in the same file, in the same
    directory, else the first by name."""
    nodes = graph.nodes.select("qualified_name", F.col("file_path").alias("home"))
    exact = graph.edges.join(nodes.select(F.col("qualified_name").alias("target")), "target", "left_semi").withColumn("target_node", F.col("target"))
    open_ = _edge_id(graph.edges.join(nodes.select(F.col("qualified_name").alias("target")), "target", "left_anti"))
    dir_ = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    candidates = open_.select("_id", F.col("target").alias("alias"), "file_path").distinct().join(name_index(graph.nodes), "alias").join(nodes, "qualified_name")
    priority = F.when(F.col("home") == F.col("file_path"), 0).when(dir_(F.col("home")) == dir_(F.col("file_path")), 1).otherwise(2)
    pick = candidates.groupBy("_id").agg(F.min(F.struct(priority, "qualified_name")).alias("best"), F.count("*").alias("n")).select("_id", F.col("best.qualified_name").alias("target_node"))
    return exact.unionByName(open_.join(pick, "_id", "left").drop("_id"))


def graph_paths(graph: Graph, wanted: DataFrame) -> DataFrame:
    """wanted(path) to the stored paths: equal, else those that end so (by their last segment first)."""
    files = graph.nodes.select("file_path").distinct()
    exact = wanted.join(files, wanted.path == files.file_path).select("path", "file_path")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    rest = wanted.join(exact, "path", "left_anti").withColumn("k", last(F.col("path"))).join(files.withColumn("k", last(F.col("file_path"))), "k").where(F.col("file_path").endswith(F.concat(F.lit("/"), F.col("path")))).select("path", "file_path")
    return exact.union(rest)


def java_candidates(graph: Graph, target: str) -> DataFrame:
    """Methods that a fully qualified Java name may mean, by class, file or the tail of the qualified name."""
    cls, method = (target.split(".")[-2:] + [""])[:2] if "." in target else ("", target)
    own = F.col("name") == method
    return graph.nodes.where(own & ((F.col("parent_name") == cls) | F.col("file_path").endswith(f"/{cls}.java") | F.col("qualified_name").endswith(f"{cls}.{method}")))
