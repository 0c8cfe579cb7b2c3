"""Version control on the driver: tracked and changed files, line ranges, churn; and a catalog of repositories."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.changes import parse_numstat, parse_unified_diff


def _run(args: list[str], cwd: str, seconds: int = 60) -> str:
    done = subprocess.run(args, cwd=cwd, capture_output=True, timeout=seconds, check=False)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def tracked_files(spark: SparkSession, root: str, submodules: bool = False) -> DataFrame:
    if (Path(root) / ".svn").exists():
        names = [x[8:].strip() for x in _run(["svn", "status", "-v"], root).splitlines()]
    else:
        names = _run(["git", "ls-files", "-z", *(["--recurse-submodules"] if submodules else [])], root).split("\0")
    return spark.createDataFrame([(x,) for x in names if x], "path string")


def decode_name_status(output: str) -> list[str]:
    """Paths of NUL-separated status records; renames and copies have two."""
    parts, out, k = output.split("\0"), [], 0
    while k < len(parts) and parts[k]:
        n = 2 if parts[k][0] in "RC" else 1
        out += parts[k + 1 : k + 1 + n]
        k += 1 + n
    return list(dict.fromkeys(out))


def changed_files(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    return spark.createDataFrame([(x,) for x in decode_name_status(_run(["git", "diff", "--name-status", "-z", base], root))], "path string")


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """Staged and unstaged changes."""
    names = {p for extra in ([], ["--cached"]) for p in decode_name_status(_run(["git", "diff", "--name-status", "-z", *extra], root))}
    return spark.createDataFrame([(x,) for x in sorted(names)], "path string")


def incremental_base(metadata: DataFrame, root: str) -> str | None:
    """What an incremental update compares with: the commit that metadata(key, value) names as git_head_sha, as long as the
    repository has it; HEAD~1 where root is no git tree; None where a full build is needed."""
    if not (Path(root) / ".git").exists():
        return "HEAD~1"
    stored = metadata.where("key = 'git_head_sha' AND value IS NOT NULL").first()
    return stored.value if stored and _run(["git", "cat-file", "-t", stored.value], root).strip() == "commit" else None


def check_root(graph: Graph, root: str) -> None:
    """Raises where the graph has files, none of them below root: it was built elsewhere, and an update would remove all."""
    files = graph.nodes.where("kind = 'File'").select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("f"))
    own = root.replace("\\", "/").rstrip("/") + "/"
    seen = files.agg(F.count("*").alias("n"), F.min("f").alias("first"), F.coalesce(F.bool_or(F.col("f").startswith(own)), F.lit(False)).alias("below")).first()
    if seen.n and not seen.below:
        raise RuntimeError(f"the graph's {seen.n} files, such as {seen.first}, are not below {root}: build it anew, or name the root that it was built with")


def diff_ranges(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    svn = (Path(root) / ".svn").exists()
    text = _run(["svn", "diff", "-r", base] if svn else ["git", "diff", "--unified=0", base], root)
    text = text.replace("\n+++ ", "\n+++ b/") if svn else text
    return parse_unified_diff(spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "n long, line string"))


def churn(spark: SparkSession, root: str, days: int = 90) -> DataFrame:
    log = _run(["git", "log", f"--since={days}.days", "--numstat", "--format=%x01%H"], root)
    rows = [(block.splitlines()[0], line.split("\t")[2]) for block in log.split("\x01")[1:] for line in block.splitlines()[1:] if line.count("\t") == 2]
    return parse_numstat(spark.createDataFrame(rows, "commit string, path string"))


class Catalog:
    """Repositories by path and alias, in one JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> list[dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else []

    def add(self, path: str, alias: str | None = None) -> None:
        kept = [r for r in self.all() if r["path"] != path]
        if alias and any(r["alias"] == alias for r in kept):
            raise ValueError(f"the alias {alias} is taken")
        self.path.write_text(json.dumps([*kept, {"path": path, "alias": alias or Path(path).name}]))

    def remove(self, name: str) -> bool:
        kept = [r for r in self.all() if name not in (r["path"], r["alias"])]
        changed = len(kept) != len(self.all())
        self.path.write_text(json.dumps(kept))
        return changed

    def resolve(self, name: str) -> dict | None:
        return next((r for r in self.all() if name in (r["path"], r["alias"])), None)
