"""Refactoring: renames, dead code, moves."""

from __future__ import annotations

import difflib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import file_of, is_test_file
from graphloom.graph import Graph
from graphloom.operators.analytics import referenced_type_names
from graphloom.operators.flows import has_entry_decorator, has_entry_name

# Decorators and base classes that a framework calls.
EXEMPT_DECORATOR = r"(?i)(property|abstractmethod|classmethod|staticmethod|hostlistener|dataclass|override)"
FRAMEWORK_BASES = ("BaseModel", "Model", "TestCase", "Exception", "Enum", "Protocol", "NamedTuple", "TypedDict", "Schema", "Serializer", "View", "APIView", "Construct", "Stack")


def rename_preview(graph: Graph, old: str, new: str) -> DataFrame:
    """Edits (file_path, line, why): the definition, calls of it, bare calls, imports. Calls of the exact target are all
    listed; the others once for each file and line."""
    own = graph.nodes.where(F.col("name") == old)
    definition = own.select("file_path", F.col("line_start").alias("line"), F.lit("definition").alias("why"))
    targets = own.select(F.col("qualified_name").alias("target"))
    calls = graph.of_kind("CALLS").join(targets, "target", "left_semi").select("file_path", "line", F.lit("call").alias("why"))
    bare = graph.of_kind("CALLS").where(F.col("target") == old).select("file_path", "line", F.lit("call").alias("why"))
    imports = graph.of_kind("IMPORTS_FROM").where(F.col("target").endswith(f"::{old}")).select("file_path", "line", F.lit("import").alias("why"))
    once = definition.union(bare).union(imports).dropDuplicates(["file_path", "line"])
    return once.union(calls).withColumn("replacement", F.lit(new))


def dead_code(graph: Graph, kind: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Functions and classes without evidence of use: no edge into them by qualified name, no bare call of their name
    from a file that could mean them (the same file, one that imports theirs, or any if the name is unique), no type
    annotation, no subclass; tests, entry points and what a framework calls don't count."""
    n = graph.nodes.where(F.col("kind").isin("Function", "Class") & ~F.col("is_test") & ~is_test_file(F.col("file_path")))
    n = n.where(~F.col("file_path").endswith(".d.ts") & ~F.col("name").rlike(r"^__\w+__$") & (F.col("name") != "constructor") & ~has_entry_name(F.col("name"), F.col("language") if "language" in graph.nodes.columns else F.lit(None).cast("string")))
    if "extra" in graph.nodes.columns:
        extra = F.coalesce(F.get_json_object("extra", "$.decorators"), F.lit(""))
        n = n.where(F.get_json_object("extra", "$.verilog_kind").isNull() & ~has_entry_decorator(F.col("extra")) & ~extra.rlike(EXEMPT_DECORATOR) & ~((F.col("kind") == "Class") & (extra != "")))
    n = n.where(F.col("kind") == kind) if kind else n
    n = n.where(F.col("file_path").ilike(f"%{file_pattern}%")) if file_pattern else n
    key = lambda df, c: df.select(F.col(c).alias("qualified_name")).distinct()
    used = key(graph.of_kind("CALLS", "IMPORTS_FROM", "REFERENCES", "INHERITS", "IMPLEMENTS"), "target").union(key(graph.of_kind("TESTED_BY"), "source")).distinct()
    n = n.join(used, "qualified_name", "left_anti")
    n = n.join(referenced_type_names(graph).withColumn("kind", F.lit("Class")), ["name", "kind"], "left_anti")
    bases = graph.of_kind("INHERITS").where(F.substring_index("target", "::", -1).isin(*FRAMEWORK_BASES)).select(F.col("source").alias("qualified_name"))
    n = n.join(bases, "qualified_name", "left_anti")
    # Bare calls, by name first, then by whether the caller's file could mean this node.
    unique = graph.nodes.where(~F.col("is_test")).groupBy("name").agg(F.count("*").alias("same_name"))
    bare = graph.of_kind("CALLS").where(~F.col("target").contains("::")).select(F.col("target").alias("name"), F.col("file_path").alias("caller_file")).distinct()
    imports = graph.of_kind("IMPORTS_FROM").select(F.col("file_path").alias("caller_file"), file_of(F.col("target")).alias("file_path")).distinct().withColumn("imported", F.lit(True))
    maybe = n.select("qualified_name", "name", "file_path").join(bare, "name").join(unique, "name").join(imports, ["caller_file", "file_path"], "left")
    plausible = maybe.where("caller_file = file_path OR imported OR same_name = 1").select("qualified_name").distinct()
    n = n.join(plausible, "qualified_name", "left_anti")
    # A method is alive if a method of the same name of a base class is called.
    methods = graph.nodes.where("parent_name IS NOT NULL").select("qualified_name", "name", "parent_name")
    bases = graph.of_kind("INHERITS", "IMPLEMENTS").select(F.substring_index("source", "::", -1).alias("child"), F.substring_index("target", "::", -1).alias("parent"))
    called = methods.join(key(graph.of_kind("CALLS"), "target"), "qualified_name", "left_semi").select(F.col("parent_name").alias("parent"), "name")
    alive = methods.join(bases, methods.parent_name == bases.child).join(called, ["parent", "name"]).select("qualified_name")
    # A class is alive if one of its members is called.
    members = methods.join(key(graph.of_kind("CALLS"), "target"), "qualified_name", "left_semi").select(F.col("parent_name").alias("name"), F.lit("Class").alias("kind"))
    return n.join(alive, "qualified_name", "left_anti").join(members, ["name", "kind"], "left_anti").select(*graph.nodes.columns)


def move_suggestions(graph: Graph) -> DataFrame:
    """Functions whose callers are all of one other community: qualified_name, community_id, target_community."""
    own = graph.nodes.where("community_id IS NOT NULL").select("qualified_name", "community_id", "kind")
    calls = graph.of_kind("CALLS").join(own.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("caller")), "source")
    seen = calls.groupBy(F.col("target").alias("qualified_name")).agg(F.min("caller").alias("low"), F.max("caller").alias("high"))
    return own.where("kind = 'Function' OR kind = 'Class'").join(seen.where("low = high"), "qualified_name").where("low <> community_id").select("qualified_name", "community_id", F.col("low").alias("target_community"))


def suggestions(graph: Graph) -> DataFrame:
    dead = dead_code(graph).select("qualified_name", F.lit("remove").alias("action"), F.lit(None).cast("long").alias("target_community"))
    return dead.union(move_suggestions(graph).select("qualified_name", F.lit("move"), "target_community"))


def apply_edits(edits: list[dict], root: str, dry_run: bool = True) -> str:
    """On the driver: the first old name on each edit's line (else in the file) replaced; returns the diff. Files outside
    root are refused."""
    base, out, texts = Path(root).resolve(), [], {}
    for e in edits:
        path = (base / e["file_path"]).resolve()
        if not path.is_relative_to(base):
            raise ValueError(f"{path} is outside {base}")
        lines = texts.setdefault(path, path.read_text().splitlines(keepends=True))
        k = e["line"] - 1
        at = k if 0 <= k < len(lines) and e["old"] in lines[k] else next((i for i, x in enumerate(lines) if e["old"] in x), None)
        if at is not None:
            lines[at] = lines[at].replace(e["old"], e["new"], 1)
    for path, lines in texts.items():
        before = path.read_text().splitlines(keepends=True)
        out += difflib.unified_diff(before, lines, str(path), str(path))
        if not dry_run:
            path.write_text("".join(lines))
    return "".join(out)
