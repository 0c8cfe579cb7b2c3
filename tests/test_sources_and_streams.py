"""Files, version control, catalogs and streams."""

import datetime
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.sources import files, vcs
from graphloom.streaming import pipelines

SOURCES = {
    "src/util.py": "def helper():\n    return 1\n",
    "src/main.py": "from src.util import helper\nimport os\n\nclass Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return helper()\n\nclass Child(Base):\n    pass\n\ndef main() -> int:\n    if False:\n        never()\n    return Base().run()\n",
    "tests/test_main.py": "from src.main import main\n\ndef test_main():\n    assert main() == 1\n",
    "src/broken.py": "def x(:\n",
    "node_modules/a.py": "x = 1\n",
    "src/data.py": "\0binary",
    "README.md": "text",
}


@pytest.fixture
def repo(tmp_path):
    for path, text in SOURCES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_inventory(spark, repo):
    found = {r.path for r in files.collect_files(spark, str(repo)).select("path").collect()}
    assert found == {"src/util.py", "src/main.py", "tests/test_main.py", "src/broken.py"}
    rules = files.ignore_rules("# mine\n/src\n!node_modules/\n")
    assert {r.path for r in files.collect_files(spark, str(repo), rules).select("path").collect()} == {"tests/test_main.py", "node_modules/a.py"}


def test_output_dirs_need_a_manifest(spark):
    df = spark.createDataFrame([(p,) for p in ("a/Cargo.toml", "a/target/x.rs", "b/target/y.rs", "build/z.py", "pyproject.toml")], "path string")
    assert {r.dir for r in files.output_dirs(df).collect()} == {"a/target", "build"}


def test_parsed_files_and_build(spark, repo):
    parsed = {r.path: r for r in files.parse_files(files.collect_files(spark, str(repo))).collect()}
    assert parsed["src/broken.py"].error.startswith("SyntaxError") and not parsed["src/broken.py"].nodes
    main = {n.qualified_name: n for n in parsed["src/main.py"].nodes}
    assert main["src/main.py::Base.run"].parent_name == "Base" and main["src/main.py::main"].return_type == "int"
    assert {(e.source, e.target) for e in parsed["src/main.py"].edges if e.kind == "CALLS"} >= {("src/main.py::Base.run", "src/main.py::Base.step"), ("src/main.py::Base.step", "helper")}
    assert not any(e.target == "never" for e in parsed["src/main.py"].edges)
    graph = files.full_build(spark, str(repo))
    edges = {(r.kind, r.source, r.target) for r in graph.edges.collect()}
    assert ("IMPORTS_FROM", "src/main.py", "src/util.py") in edges
    assert ("CALLS", "src/main.py::Base.step", "src/util.py::helper") in edges
    assert ("CALLS", "tests/test_main.py::test_main", "src/main.py::main") in edges


def test_incremental_equals_full_build(spark, repo, tmp_path_factory):
    kept = tmp_path_factory.mktemp("kept")

    def stored(df, name):
        df.write.parquet(f"{kept}/{name}")
        return spark.read.parquet(f"{kept}/{name}")

    def build():
        return files.to_graph(files.parse_files(files.collect_files(spark, str(repo))))

    def as_sets(g: Graph):
        return {r.qualified_name for r in g.nodes.collect()}, {(r.kind, r.source, r.target, r.line) for r in g.edges.collect()}

    before = build()
    before = Graph(stored(before.nodes, "nodes"), stored(before.edges, "edges"))
    hashes = stored(files.parse_files(files.collect_files(spark, str(repo))).select("path", "sha"), "hashes")
    (repo / "src/util.py").write_text("def helper():\n    return 2\n\ndef more():\n    return helper()\n")
    (repo / "src/new.py").write_text("x = 1\n")
    (repo / "tests/test_main.py").unlink()
    changed = files.collect_files(spark, str(repo)).select("path", "content", F.sha2("content", 256).alias("sha"))
    changed = changed.union(spark.createDataFrame([("tests/test_main.py", None, None)], "path string, content binary, sha string").withColumn("sha", F.lit("gone")))
    after = pipelines.incremental_update(before, changed, lambda f: files.to_graph(files.parse_files(f)), hashes)
    assert as_sets(after) == as_sets(build())


def test_compiler_aliases():
    config = {"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["app/*"], "@/deep/*": ["other/*"], "exact": ["lib/exact"]}}}
    assert files.alias_targets(config, "@/deep/x") == ["src/other/x"] and files.alias_targets(config, "exact") == ["src/lib/exact"] and files.alias_targets(config, "no") == []
    assert files.probe(["src/a"], {"src/a/index.ts", "src/a.js"}.__contains__) == "src/a.js"


def test_version_control(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("1\n2\n3\n")
    (tmp_path / "b.py").write_text("x\n" * 20)
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("1\nB\n3\n4\n")
    git("mv", "b.py", "c.py")
    git("add", ".")
    git("commit", "-qm", "two")
    root = str(tmp_path)
    assert {r.path for r in vcs.tracked_files(spark, root).collect()} == {"a.py", "c.py"}
    assert {r.path for r in vcs.changed_files(spark, root).collect()} == {"a.py", "b.py", "c.py"}
    assert {tuple(r) for r in vcs.diff_ranges(spark, root).where("file_path = 'a.py'").collect()} == {("a.py", 2, 2), ("a.py", 4, 4)}
    assert {r.path: r.commits for r in vcs.churn(spark, root).collect()}["a.py"] == 2
    (tmp_path / "a.py").write_text("changed\n")
    assert [r.path for r in vcs.working_tree(spark, root).collect()] == ["a.py"]


def test_catalog(tmp_path):
    c = vcs.Catalog(str(tmp_path / "c.json"))
    c.add("/x/one")
    c.add("/x/two", "second")
    with pytest.raises(ValueError):
        c.add("/x/three", "second")
    assert c.resolve("second")["path"] == "/x/two" and c.resolve("one")["path"] == "/x/one" and c.remove("one") and not c.remove("one")


# Streams

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def stream(spark, tmp_path, batches, schema, name="in"):
    """A file stream that reads one batch a trigger."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_upserts_by_stream_equal_one_batch(spark, tmp_path):
    schema = "path string, seq long, value string"
    batches = [[("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], [("b", 4, "w")], [("c", 5, "v"), ("a", 6, "u")]]
    for _ in range(2):  # a second run finds nothing new
        q = pipelines.upsert_stream(stream(spark, tmp_path, batches if not (tmp_path / "in").exists() else [], schema), str(tmp_path / "state"), ["path"], "seq", str(tmp_path / "check"))
        q.awaitTermination(120)
    version = pipelines.current_version(spark, str(tmp_path / "state"))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/state/v={version}").collect()} == {("a", 6, "u"), ("b", 4, "w"), ("c", 5, "v")}


def test_debounce(spark, tmp_path):
    schema = "path string, ts timestamp"
    source = stream(spark, tmp_path, [[("a", at(0)), ("a", at(0.5)), ("a", at(5)), ("b", at(0.2))], [("z", at(100))]], schema)
    q = pipelines.debounce(source).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.n) for r in spark.table("debounced").collect()} >= {("a", 2), ("a", 1), ("b", 1)}


def test_distinct_events(spark, tmp_path):
    q = pipelines.distinct_events(stream(spark, tmp_path, [[("a", at(0)), ("a", at(1))], [("a", at(2)), ("b", at(2))]], "path string, ts timestamp"), ["path"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.path for r in spark.table("once").collect()) == ["a", "b"]


def test_watched_paths_come_once_a_batch(spark, tmp_path):
    seen = []
    source = stream(spark, tmp_path, [[("a", 1), ("a", 2), ("b", 3)]], "path string, seq long")
    q = source.writeStream.foreachBatch(lambda b, n: seen.extend(sorted(r.path for r in b.select("path").distinct().collect()))).option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == ["a", "b"]


def test_session_state(spark, tmp_path):
    schema = "session string, tool string, ts timestamp"
    batches = [[("s", "query_graph", at(1)), ("s", "traverse_graph", at(2)), ("t", "refactor", at(1))], [("s", "semantic_search", at(3))]]
    q = pipelines.session_state(stream(spark, tmp_path, batches, schema), keep=2).writeStream.format("memory").queryName("sessions").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = {r.session: r for r in spark.table("sessions").orderBy("calls").collect()}
    assert (last["s"].calls, last["s"].last_tools, last["s"].intent) == (3, ["traverse_graph", "semantic_search"], "debug")
    assert last["t"].intent == "refactor"
    hints = pipelines.next_steps(spark.createDataFrame([last["s"]]), spark.createDataFrame([("debug", "query_graph", 1), ("debug", "traverse_graph", 2), ("review", "x", 1)], "intent string, tool string, rank int"))
    assert [r.tool for r in hints.collect()] == ["query_graph"]
