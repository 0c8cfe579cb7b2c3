"""Source files as nodes and edges: the inventory with its ignore rules, and a parser for Python by the standard library."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

# Extensions of languages, and what is never read.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".h": "cpp", ".c": "c", ".rb": "ruby", ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".tf": "hcl", ".res": "rescript", ".resi": "rescript", ".sql": "sql", ".sh": "bash"}
IGNORED = ["node_modules/", ".git/", "__pycache__/", "dist/", "build/", ".venv/", "venv/", "*.min.js", "*.lock"]
MANIFESTS = {"target": ("Cargo.toml", "pom.xml"), "build": ("build.gradle", "build.gradle.kts", "CMakeLists.txt", "pyproject.toml")}
NODE_DDL = "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, extra string, file_hash string"
EDGE_DDL = "kind string, source string, target string, file_path string, line long, extra string"
PARSED = f"path string, sha string, error string, nodes array<struct<{NODE_DDL.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean')}>>, edges array<struct<{EDGE_DDL.replace(' string', ':string').replace(' long', ':long')}>>"


def ignore_rules(text: str = "", keep_builtin: bool = True) -> list[str]:
    """Rules of an ignore file, one a line; `!rule` takes one of the built-in ones back."""
    own = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    kept = {x[1:] for x in own if x.startswith("!")}
    return [x for x in (IGNORED if keep_builtin else []) + [x for x in own if not x.startswith("!")] if x not in kept]


def is_ignored(path, rules: list[str]):
    """Whether a path column meets a rule: a directory at any depth (`x/`), an anchored prefix (`/x`), or a glob."""
    from graphloom.functions.text import glob_regex

    found = F.lit(False)
    for r in rules:
        if r.startswith("/"):
            found = found | path.startswith(r.strip("/") + "/") | (path == r.strip("/"))
        elif r.endswith("/"):
            found = found | F.array_contains(F.split(path, "/"), r.rstrip("/"))
        else:
            found = found | path.rlike(glob_regex(r)) | F.element_at(F.split(path, "/"), -1).rlike(glob_regex(r))
    return found


def collect_files(spark: SparkSession, root: str, rules: list[str] | None = None, languages: dict[str, str] | None = None, longest: int = 4096) -> DataFrame:
    """(path, language, content, length) of the readable source files below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + str(Path(root).resolve()) if "://" not in root else root
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), f"^{re.escape(base.rstrip('/'))}/", "")
    known = languages or LANGUAGES
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    named = raw.select(path.alias("path"), "content", "length").withColumn("language", F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[extension])
    own = named.where(F.col("language").isNotNull() & (F.length("path") <= longest) & ~is_ignored(F.col("path"), ignore_rules() if rules is None else rules))
    return own.where(~is_binary(F.col("content")))


def is_binary(content):
    """A NUL among the first 8192 bytes."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(..)*00")


def output_dirs(files: DataFrame) -> DataFrame:
    """files(path) to directories named like build output that stand beside a manifest."""
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("dir")).distinct()
    parent = lambda c: F.regexp_replace(c, "(^|/)[^/]*$", "")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    manifests = files.select(parent(F.col("path")).alias("parent"), last(F.col("path")).alias("m"))
    wanted = files.sparkSession.createDataFrame([(d, m) for d, ms in MANIFESTS.items() for m in ms], "name string, m string")
    beside = manifests.join(F.broadcast(wanted), "m").select("parent", "name").distinct()
    return dirs.select("dir", parent(F.col("dir")).alias("parent"), last(F.col("dir")).alias("name")).join(beside, ["parent", "name"], "left_semi").select("dir")


class _Reader(ast.NodeVisitor):
    """Nodes and edges of one Python module."""

    def __init__(self, path: str, sha: str):
        self.path, self.sha, self.nodes, self.edges, self.stack = path, sha, [], [], []

    def add(self, kind, name, node, parent=None, params=None, returns=None, extra=None):
        test = name.startswith("test") or bool(re.search(r"(^|/)(tests?/|test_)", self.path))
        qn = self.path if kind == "File" else f"{self.path}::{parent + '.' if parent else ''}{name}"
        self.nodes.append({"kind": kind, "name": name, "qualified_name": qn, "file_path": self.path, "line_start": getattr(node, "lineno", 1), "line_end": getattr(node, "end_lineno", None) or 1, "language": "python", "parent_name": parent, "params": params, "return_type": returns, "is_test": test and kind == "Function", "extra": json.dumps(extra or {}), "file_hash": self.sha})
        return qn

    def link(self, kind, target, node):
        self.edges.append({"kind": kind, "source": self.stack[-1][0] if self.stack else self.path, "target": target, "file_path": self.path, "line": getattr(node, "lineno", 1), "extra": "{}"})

    def inside(self, qn, cls, node):
        self.stack.append((qn, cls))
        for child in node.body:
            self.visit(child)
        self.stack.pop()

    def visit_ClassDef(self, node):
        qn = self.add("Class", node.name, node, extra={"decorators": [ast.unparse(d) for d in node.decorator_list]})
        self.link("CONTAINS", qn, node)
        self.stack.append((qn, node.name))
        for b in node.bases:
            self.link("INHERITS", ast.unparse(b), node)
        self.stack.pop()
        self.inside(qn, node.name, node)

    def visit_FunctionDef(self, node):
        parent = self.stack[-1][1] if self.stack else None
        qn = self.add("Function", node.name, node, parent, f"({ast.unparse(node.args)})", ast.unparse(node.returns) if node.returns else None, {"decorators": [ast.unparse(d) for d in node.decorator_list]})
        self.link("CONTAINS", qn, node)
        self.inside(qn, parent, node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            own = self.stack[-1][1] if self.stack else None
            to_self = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self" and own
            self.link("CALLS", f"{self.path}::{own}.{name}" if to_self else name, node)
        self.generic_visit(node)

    def visit_If(self, node):
        # Branches that never run give no edges.
        dead = isinstance(node.test, ast.Constant) and not node.test.value
        for child in ([] if dead else [node.test, *node.body]) + node.orelse:
            self.visit(child)

    def visit_Import(self, node):
        for a in node.names:
            self.link("IMPORTS_FROM", a.name, node)

    def visit_ImportFrom(self, node):
        if node.module:
            self.link("IMPORTS_FROM", node.module, node)


def parse_python(path: str, content: bytes) -> tuple[list[dict], list[dict]]:
    reader = _Reader(path, hashlib.sha256(content).hexdigest())
    tree = ast.parse(content)
    lines = content.count(b"\n") + 1
    reader.add("File", path.rsplit("/", 1)[-1], ast.Pass(lineno=1, end_lineno=lines))
    for child in tree.body:
        reader.visit(child)
    known = {n["name"]: n["qualified_name"] for n in reader.nodes if n["kind"] == "Function" and n["parent_name"] is None}
    for e in reader.edges:
        if e["kind"] == "CALLS" and e["target"] in known:
            e["target"] = known[e["target"]]
        if e["kind"] == "CALLS" and re.search(r"::(.*\.)?test", e["source"]):
            reader.edges.append(e | {"kind": "TESTED_BY", "source": e["target"], "target": e["source"]}) if "::" in e["target"] else None
    return reader.nodes, reader.edges


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, content) to (path, sha, error, nodes, edges); an error is a value, not an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                sha = hashlib.sha256(content).hexdigest()
                try:
                    nodes, edges = parse_python(path, bytes(content))
                    rows.append((path, sha, None, nodes, edges))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, sha, f"{type(e).__name__}: {e}", [], []))
            yield pd.DataFrame(rows, columns=["path", "sha", "error", "nodes", "edges"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def to_graph(parsed: DataFrame) -> Graph:
    return Graph(parsed.select(F.inline("nodes")), parsed.select(F.inline("edges")))


def full_build(spark: SparkSession, root: str, rules: list[str] | None = None) -> Graph:
    """Inventory, parse, resolve imports and bare calls."""
    from graphloom.operators import resolve

    files = collect_files(spark, root, rules).where("language = 'python'")
    built = to_graph(parse_files(files))
    imported = built.with_tables(edges=resolve.resolve_python_imports(built).drop("ambiguous_targets"))
    called = imported.with_tables(edges=resolve.resolve_bare_calls(imported).drop("ambiguous_targets"))
    return called.with_tables(edges=resolve.resolve_bare_tests(called).drop("ambiguous_targets"))


def custom_languages(path: str) -> dict[str, str]:
    """Further extensions of a languages.toml: [languages.name] extensions = [...]; built-in ones can't be taken."""
    found = tomllib.loads(Path(path).read_text()).get("languages", {})
    return {x: name for name, v in found.items() for x in v.get("extensions", []) if x.startswith(".") and x not in LANGUAGES}


def alias_targets(config: dict, imported: str) -> list[str]:
    """Paths that a compiler config's `paths` give an import: the longest literal prefix wins, one * is captured."""
    best = None
    for pattern, targets in config.get("compilerOptions", {}).get("paths", {}).items():
        head, star, tail = pattern.partition("*")
        if (imported == pattern) if not star else (imported.startswith(head) and imported.endswith(tail) and len(imported) >= len(head) + len(tail)):
            if best is None or len(head) > best[0]:
                middle = imported[len(head) : len(imported) - len(tail)] if star else ""
                best = (len(head), [t.replace("*", middle, 1) for t in targets])
    base = config.get("compilerOptions", {}).get("baseUrl", ".")
    return [str(Path(base) / t) for t in best[1]] if best else []


def probe(paths: list[str], exists, extensions=(".ts", ".tsx", ".d.ts", ".js", ".jsx")) -> str | None:
    """The first path that exists as it is, with an extension, or as a directory's index."""
    tries = [t for p in paths for t in (p, *(p + x for x in extensions), *(f"{p}/index{x}" for x in extensions))]
    return next((t for t in tries if exists(t)), None)


