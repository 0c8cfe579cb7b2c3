import itertools
import random
import subprocess

import pytest

from graphloom.graph import Graph
from graphloom.operators import communities
from graphloom.sources import vcs


def made(spark, names, edges):
    nodes = spark.createDataFrame([("Function", n, n, "/a.py", 1) for n in names], "kind string, name string, qualified_name string, file_path string, community_id long")
    return Graph(nodes, spark.createDataFrame([("CALLS", a, b, "/a.py", 1) for a, b in edges], "kind string, source string, target string, file_path string, line long"))


def quality(edges, label, resolution):
    """Modularity by its definition, pair by pair."""
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    m, names = len(pairs), sorted({x for p in pairs for x in p})
    degree = {n: sum(n in p for p in pairs) for n in names}
    return sum((tuple(sorted((a, b))) in pairs and a != b) / (2 * m) - resolution * degree[a] * degree[b] / (4 * m * m) for a in names for b in names if label[a] == label[b])


def best(edges, names, resolution):
    """The largest modularity of all partitions of a few nodes."""
    top = -1.0
    for cut in itertools.product(range(3), repeat=len(names)):
        top = max(top, quality(edges, dict(zip(names, cut, strict=True)), resolution))
    return top


def test_cliques_are_communities(spark):
    names = [f"{g}{k}" for g in "ab" for k in range(5)]
    edges = [(x, y) for g in "ab" for x, y in itertools.combinations([n for n in names if n[0] == g], 2)] + [("a0", "b0"), ("b2", "b2")]
    found = {r.qualified_name: r.label for r in communities.modularity_communities(made(spark, [*names, "alone"], edges), 1.0, levels=2).collect()}
    assert found == {n: n[0] + "0" for n in names} | {"alone": "alone"}


def test_close_to_the_best_partition(spark):
    rng = random.Random(3)
    names = [f"n{k}" for k in range(8)]
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < (0.8 if (a < "n4") == (b < "n4") else 0.15)]
    found = {r.qualified_name: r.label for r in communities.modularity_communities(made(spark, names, edges), 1.0, levels=2).collect()}
    assert quality(edges, found, 1.0) >= 0.9 * best(edges, names, 1.0)
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u string, v string, w double")
    labels = spark.createDataFrame(list(found.items()), "q string, label string")
    assert communities.modularity(pairs, labels, 1.0) == pytest.approx(quality(edges, found, 1.0))


def test_no_community_is_disconnected(spark):
    labels = spark.createDataFrame([(n, "x") for n in "abcdef"], "q string, label string")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("d", "e", 1.0)], "u string, v string, w double")
    found = {r.q: r.label for r in communities.connected_parts(pairs, labels).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_pieces_and_dealt_nodes_change_no_community(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"n{k:02}" for k in range(60)]
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < (0.5 if int(a[1:]) % 4 == int(b[1:]) % 4 else 0.05)]
    edges += [("n00", n) for n in names[1:40]]
    graph = made(spark, names, edges)
    found = lambda: {r.qualified_name: r.label for r in communities.modularity_communities(graph, 1.0, levels=2, rounds=3).collect()}
    alone = found()
    assert 1 < len(set(alone.values())) < 30
    for name, most in (("BLOCK", 16), ("PIECE", 99), ("HUB", 30)):
        monkeypatch.setattr(communities.blocks, name, most)
    assert found() == alone


def test_a_small_graph_takes_few_jobs(spark):
    names = [f"{g}{k}" for g in "abc" for k in range(5)]
    edges = [(x, y) for g in "abc" for x, y in itertools.combinations([n for n in names if n[0] == g], 2)] + [("a0", "b0"), ("b2", "c2")]
    spark.sparkContext.setJobGroup("few", "few")
    communities.modularity_communities(made(spark, names, edges), 1.0).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 60


def test_oversized_communities_are_split(spark):
    names = [f"{g}{k}" for g in "ab" for k in range(6)]
    edges = [(x, y) for g in "ab" for x, y in itertools.combinations([n for n in names if n[0] == g], 2)] + [("a0", "b0")]
    parts = {}
    for r in communities.split_oversized(made(spark, names, edges), 0.25, 5).collect():
        parts.setdefault(r.part, set()).add(r.qualified_name[0])
    assert sorted(map(sorted, parts.values())) == [["a"], ["b"]]
    assert communities.resolution_for(10) == 1.0 and communities.resolution_for(1000) == pytest.approx(1 / 3)


def test_base_of_an_incremental_update(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    assert vcs.incremental_base(rows(("git_head_sha", "abc")), str(tmp_path)) == "HEAD~1"
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "one")
    head = git("rev-parse", "HEAD")
    assert vcs.incremental_base(rows(("git_head_sha", head)), str(tmp_path)) == head
    assert vcs.incremental_base(rows(("git_head_sha", "0" * 40)), str(tmp_path)) is None
    assert vcs.incremental_base(rows(("other", head)), str(tmp_path)) is None


def test_a_graph_of_another_root_is_refused(spark):
    nodes = lambda *paths: Graph(spark.createDataFrame([("File", p) for p in paths] + [("Class", "/else/x.py")], "kind string, file_path string"), None)
    vcs.check_root(nodes("/repo/a.py", "/old/b.py"), "/repo")
    vcs.check_root(nodes(), "/repo")
    vcs.check_root(nodes("C:\\repo\\a.py"), "C:\\repo\\")
    with pytest.raises(RuntimeError, match="2 files"):
        vcs.check_root(nodes("/repository/a.py", "/old/b.py"), "/repo")
