"""Operators on small hand-built graphs, held against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import analytics, changes, communities, embeddings, exports, flows, patterns, refactor, resolve, search, store, summaries, traverse

NODE = "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, extra string, community_id long"
EDGE = "kind string, source string, target string, file_path string, line long, extra string"


def node(name, path="/a.py", kind="Function", lines=(1, 10), parent=None, test=False, extra=None, community=None, language="python", params=None, returns=None):
    qn = path if kind == "File" else f"{path}::{parent + '.' if parent else ''}{name}"
    return (kind, name, qn, path, lines[0], lines[1], language, parent, params, returns, test, extra, community)


def edge(source, target, kind="CALLS", line=5, path=None, extra=None):
    return (kind, source, target, path or source.split("::")[0], line, extra)


@pytest.fixture
def make(spark):
    return lambda nodes, edges: Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def names(df, *cols):
    rows = df.select(*(cols or ("qualified_name",))).collect()
    return {tuple(r) for r in rows} if cols else {r[0] for r in rows}


# Impact

WEIGHT = {"CALLS": 1.0, "INHERITS": 0.9, "TESTED_BY": 0.7, "REFERENCES": 0.6, "IMPORTS_FROM": 0.5, "OTHER": 0.5}


def best_scores(edges, seeds, depth, decay=0.6, floor=0.05):
    arcs = []
    for kind, s, t, *_ in edges:
        if kind != "CONTAINS":
            arcs.append((s, t, WEIGHT[kind]) if kind == "TESTED_BY" else (t, s, WEIGHT[kind]))
    best = dict.fromkeys(seeds, 1.0)
    frontier = dict(best)
    for _ in range(depth):
        reached = {}
        for s, t, w in arcs:
            if s in frontier and (x := frontier[s] * w * decay) > floor:
                reached[t] = max(reached.get(t, 0), x)
        frontier = {t: x for t, x in reached.items() if x > best.get(t, 0)}
        best |= frontier
    return best


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_impact_on_random_graphs(make, depth):
    rng = random.Random(depth)
    nodes = [node(f"n{i}", f"/f{i % 3}.py") for i in range(12)]
    edges = [edge(rng.choice(nodes)[2] if rng.random() < 0.9 else "ghost", rng.choice(nodes)[2] if rng.random() < 0.9 else "ghost", rng.choice([*WEIGHT, "CONTAINS"]), k, "/x.py") for k in range(40)]
    seeds = [n[2] for n in nodes if n[3] == "/f0.py"]
    expected = {q: round(s, 4) for q, s in best_scores(edges, seeds, depth).items() if q not in seeds and q != "ghost"}
    found = {r.qualified_name: r.impact_score for r in traverse.impact_radius(make(nodes, edges), ["/f0.py"], depth, limit=None).collect()}
    assert found == pytest.approx(expected)


def test_dense_cycle_ends(make):
    nodes = [node(f"n{i}", f"/{i}.py") for i in range(12)]
    edges = [edge(a[2], b[2], "CALLS" if (i + j) % 2 else "IMPORTS_FROM") for (i, a), (j, b) in itertools.permutations(enumerate(nodes), 2)]
    assert traverse.impact_radius(make(nodes, edges), ["/0.py"], 25, 20).count() == 11


def test_ghosts_bridge_but_do_not_surface(make):
    g = make([node("a"), node("b", "/b.py")], [edge("/b.py::b", "ghost"), edge("ghost", "/a.py::a", path="/c.py")])
    assert names(traverse.impact_radius(g, ["/a.py"], 2)) == {"/b.py::b"}


# Flows and communities


@pytest.fixture
def calls(make):
    nodes = [node("main", "/app.py"), node("a", "/app.py"), node("b", "/lib.py"), node("c", "/lib.py"), node("alone", "/app.py"), node("test_a", "/tests/t.py", test=True)]
    q = {n[1]: n[2] for n in nodes}
    return make(nodes, [edge(q["main"], q["a"]), edge(q["a"], q["b"]), edge(q["b"], q["c"]), edge(q["c"], q["a"]), edge(q["b"], "print"), edge(q["a"], q["test_a"], "TESTED_BY"), edge("/app.py", q["c"])]), q


def test_flow_of_a_cycle(calls):
    g, q = calls
    steps = flows.trace_flows(g)
    assert [(r.node, r.depth, r.position) for r in steps.where(F.col("entry") == q["main"]).orderBy("position").collect()] == [(q["main"], 0, 0), (q["a"], 1, 1), (q["b"], 2, 2), (q["c"], 3, 3)]
    assert names(steps, "entry") == {(q["main"],)}
    row = flows.criticality(g, steps).first()
    assert row.criticality == pytest.approx(round(0.3 / 4 + 0.2 / 5 + 0.15 * 0.75 + 0.03, 4)) and (row.depth, row.node_count, row.file_count) == (3, 4, 2)
    table = flows.flow_rows(g, steps)
    assert flows.memberships(table).count() == 4 and flows.flow_by_id(g, table, table.first().flow_id, 2).count() == 2


def test_entry_points_by_name_and_decorator(make):
    nodes = [node("main"), node("x", extra='{"decorators": ["app.route(\'/\')"]}'), node("y"), node("z"), node("v", extra='{"verilog_kind": "net"}'), node("t", test=True)]
    g = make(nodes, [edge("/a.py::z", f"/a.py::{n}") for n in ("main", "x", "y")])
    assert names(flows.entry_points(g), "name") == {("main",), ("x",), ("z",)}


def test_retrace_equals_full_trace(calls):
    g, q = calls
    before = flows.trace_flows(g.with_tables(edges=g.edges.where(F.col("source") != q["b"])))
    assert names(flows.retrace(g, before, ["/lib.py"]), "entry", "node") == names(flows.trace_flows(g), "entry", "node")


def test_directories_split_until_there_are_enough(make):
    nodes = [node(f"f{k}{i}", f"/src/pkg{k}/m{i}.py") for k in range(11) for i in range(3)]
    found = communities.detect_by_directory(make(nodes, [edge("a", "b")]))
    assert found.select("community").distinct().count() == 11 and found.count() == 33


def test_label_propagation_finds_cliques(make):
    nodes = [node(f"{c}{i}") for c in "ab" for i in range(5)]
    edges = [edge(f"/a.py::{c}{i}", f"/a.py::{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [edge("/a.py::a0", "/a.py::b0", "CONTAINS")]
    labels = {r.qualified_name: r.label for r in communities.label_propagation(make(nodes, edges), 8).collect()}
    assert len({labels[f"/a.py::a{i}"] for i in range(5)}) == len({labels[f"/a.py::b{i}"] for i in range(5)}) == 1


def test_cohesion_counts_ghosts_as_external(make):
    g = make([node("a", community=1), node("b", community=1), node("c", community=2)], [edge("/a.py::a", "/a.py::b"), edge("/a.py::a", "ghost"), edge("/a.py::b", "/a.py::c"), edge("/a.py::a", "/a.py::a")])
    assert names(analytics.cohesion(g), "community_id", "internal", "external", "cohesion") == {(1, 2, 2, 0.5), (2, 0, 1, 0.0)}


def brandes(vertices, arcs):
    score = dict.fromkeys(vertices, 0.0)
    out = {v: sorted({t for s, t in arcs if s == v and t != v}) for v in vertices}
    for s in vertices:
        dist, sigma, order, level = {s: 0}, {s: 1.0}, [s], [s]
        while level:
            nexts = []
            for v in level:
                for t in out[v]:
                    if t not in dist:
                        dist[t], sigma[t] = dist[v] + 1, 0.0
                        nexts.append(t)
                    if dist[t] == dist[v] + 1:
                        sigma[t] += sigma[v]
            order, level = order + nexts, nexts
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for t in out[v]:
                if dist[t] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[t] * (1 + delta[t])
            if v != s:
                score[v] += delta[v]
    n = len(vertices)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness(make):
    rng = random.Random(7)
    nodes = [node(f"n{i}") for i in range(9)]
    edges = [edge(rng.choice(nodes)[2], rng.choice(nodes)[2], rng.choice(["CALLS", "CONTAINS"]), k) for k in range(18)]
    expected = brandes([n[2] for n in nodes], [(e[1], e[2]) for e in edges])
    assert {r.qualified_name: r.betweenness for r in traverse.betweenness(make(nodes, edges)).collect()} == pytest.approx(expected)


# Patterns, resolution, maintenance


def test_patterns(make):
    nodes = [node("f"), node("g"), node("C", kind="Class"), node("D", kind="Class"), node("E", kind="Endpoint"), node("js", "/x.ts", language="typescript"), node("tsx", "/y.tsx", language="tsx")]
    q = {n[1]: n[2] for n in nodes}
    g = make(nodes, [edge(q["f"], q["g"]), edge(q["f"], q["g"], line=9), edge(q["f"], "gone"), edge(q["tsx"], "js"), edge(q["f"], "js"), edge(q["D"], q["C"], "INHERITS"), edge(q["f"], q["E"], "HANDLES"), edge(q["f"], "topic", "PUBLISHES"), edge(q["g"], "topic", "HANDLES"), edge(q["f"], "config:app.db.*", "DEPENDS_ON_CONFIG"), edge(q["g"], "config:app.db.url", "DEPENDS_ON_CONFIG"), edge(q["f"], "/x.ts::js", "IMPORTS_FROM")])
    assert names(patterns.callers_of(g, q["g"])) == {q["f"]}
    assert names(patterns.callers_of(g, q["js"], "js", "typescript"), "qualified_name", "unresolved") == {(q["tsx"], True)}
    assert names(patterns.callees_of(g, q["f"]), "qualified_name", "unresolved") == {(q["g"], False), ("gone", True), ("js", True)}
    assert names(patterns.inheritors_of(g, q["C"])) == {q["D"]} and names(patterns.endpoints_for(g, q["f"])) == {q["E"]}
    assert names(patterns.publishers_of(g, "topic")) == {q["f"]} and names(patterns.listeners_of(g, "topic")) == {q["g"]}
    assert names(patterns.consumers_of(g, "app.db.url"), "source") == {(q["f"],), (q["g"],)}
    assert names(patterns.importers_of(g, "/x.ts"), "importer") == {("/a.py",)}
    assert patterns.resolve_target(g, "f").first().qualified_name == q["f"]
    assert patterns.PATTERNS.keys() >= {"triggers_of", "triggered_by", "references_to", "children_of", "handlers_of"}


def test_bare_names_need_evidence(make):
    nodes = [node("h", "/one.py"), node("h", "/two.py"), node("only", "/three.py"), node("own", "/main.py"), node("main", "/main.py")]
    g = make(nodes, [edge("/main.py::main", "h", line=1), edge("/main.py::main", "only", line=2), edge("/main.py::main", "own", line=3), edge("/main.py", "/one.py", "IMPORTS_FROM"), edge("/x.py::x", "h", line=4), edge("/x.py", "/one.py::h", "IMPORTS_FROM"), edge("/x.py", "/two.py", "IMPORTS_FROM")])
    out = {r.line: (r.target, r.ambiguous_targets) for r in resolve.resolve_bare_calls(g).where("kind = 'CALLS'").collect()}
    assert out == {1: ("/one.py::h", None), 2: ("only", None), 3: ("/main.py::own", None), 4: ("h", ["/one.py::h", "/two.py::h"])}
    again = resolve.resolve_bare_calls(g.with_tables(edges=resolve.resolve_bare_calls(g).drop("ambiguous_targets")))
    assert {r.line: r.target for r in again.where("kind = 'CALLS'").collect()} == {k: t for k, (t, _) in out.items()}


def test_python_modules(make):
    g = make([node("u", p, "File") for p in ("a/pkg/util.py", "b/pkg/util.py", "lib/core/__init__.py", "main.py")], [edge("main.py", "pkg.util", "IMPORTS_FROM", 1), edge("main.py", "core", "IMPORTS_FROM", 2), edge("main.py", "os", "IMPORTS_FROM", 3)])
    assert {r.line: (r.target, r.ambiguous_targets) for r in resolve.resolve_python_imports(g).collect()} == {1: ("pkg.util", ["a/pkg/util.py", "b/pkg/util.py"]), 2: ("lib/core/__init__.py", None), 3: ("os", None)}


def test_scoped_and_injected_calls(make):
    nodes = [node("run", "/a.php", parent="Job", language="php"), node("go", "/b.php", parent="Other", language="php"), node("save", "/s.java", parent="RepoImpl", language="java"), node("act", "/c.java", parent="Svc", language="java"), node("RepoImpl", "/s.java", "Class", language="java")]
    edges = [edge("/b.php::Other.go", "JOB::Run"), edge("/b.php::Other.go", "parent::x", line=6), edge("/c.java::Svc.act", "repo.save"), edge("/c.java::Svc.act", "repo.find", line=7), edge("/c.java::Svc", "Repo", "INJECTS", extra='{"field_name": "repo"}'), edge("/s.java::RepoImpl", "Repo", "INHERITS")]
    g = make(nodes, edges)
    assert {(r.target, r.confidence_tier) for r in resolve.resolve_scoped_calls(g).where("source LIKE '%go'").collect()} == {("/a.php::Job.run", "INFERRED"), ("parent::x", "EXTRACTED")}
    assert names(resolve.resolve_spring_calls(g).where("kind = 'CALLS' AND source LIKE '%act'"), "target") == {("/s.java::RepoImpl.save",), ("RepoImpl.find",)}


def test_scopes_from_the_innermost_out(make):
    nodes = [node("f", "/x.cpp", parent="A::B", language="cpp"), node("call", "/x.cpp", parent="B", language="cpp"), node("call", "/y.cpp", parent="A::B", language="cpp"), node("g", "/x.cpp", parent="A", language="cpp")]
    out = resolve.resolve_cpp_scoped_calls(make(nodes, [edge("/x.cpp::A.g", "B::call")]))
    assert out.first().target == "/y.cpp::A::B.call"


def test_events_and_modules(make):
    g = make([node("p"), node("h1"), node("h2"), node("m", "infra/net/main.tf", "File", language="hcl"), node("o", "infra/net/a.tf", "File", language="hcl")], [edge("/a.py::p", "Ev", "PUBLISHES"), edge("/a.py::h1", "Ev", "HANDLES"), edge("/a.py::h2", "Ev", "HANDLES"), edge("infra/app/x.tf", "../net", "IMPORTS_FROM")])
    made = resolve.event_calls(g)
    assert names(made.where("kind = 'CALLS'"), "source", "target", "confidence") == {("/a.py::p", "/a.py::h1", 0.95), ("/a.py::p", "/a.py::h2", 0.95)}
    assert resolve.event_calls(g.with_tables(edges=made.select(*g.edges.columns))).where("kind = 'CALLS'").count() == 2
    assert resolve.resolve_module_references(g).where("kind = 'IMPORTS_FROM'").first().target == "infra/net/main.tf"


def test_upserts_and_deletes(make, spark, tmp_path):
    g = make([node("a"), node("b", "/b.py")], [edge("/a.py::a", "/b.py::b"), edge("/b.py::b", "/a.py::a")])
    new = make([node("a", lines=(3, 4)), node("c")], [edge("/a.py::a", "/b.py::b", extra='{"confidence": 0.5, "confidence_tier": "INFERRED"}')])
    assert names(store.upsert_nodes(g.nodes, new.nodes), "name", "line_start") == {("a", 3), ("b", 1), ("c", 1)}
    assert {(r.source, r.confidence, r.confidence_tier) for r in store.upsert_edges(store.lift_confidence(g.edges), new.edges).collect()} == {("/a.py::a", 0.5, "INFERRED"), ("/b.py::b", 1.0, "EXTRACTED")}
    gone = spark.createDataFrame([("/a.py",)], "file_path string")
    assert store.remove_files(g, gone).edges.count() == 1 and store.remove_files_permanently(g, gone)[0].edges.count() == 0
    assert names(store.reconcile(g, spark.createDataFrame([("/b.py",)], "file_path string")).nodes, "name") == {("b",)}
    store.publish(g, str(tmp_path / "g"))
    assert names(store.load(spark, str(tmp_path / "g")).nodes, "name") == {("a",), ("b",)}
    store.publish(new, str(tmp_path / "g"))
    assert names(store.load(spark, str(tmp_path / "g")).nodes, "name") == {("a",), ("c",)}


# Changes, search, refactoring, exports


def test_diff_ranges_and_overlap(make, spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +5,3 @@ def f\n+a\n@@ -9 +20,0 @@\n+++ b/deep/y.py\n@@ -0,0 +1 @@"
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "n long, line string")
    ranges = changes.parse_unified_diff(lines)
    assert names(ranges, "file_path", "line_start", "line_end") == {("x.py", 5, 7), ("x.py", 20, 20), ("deep/y.py", 1, 1)}
    g = make([node("in", "/repo/x.py", lines=(7, 9)), node("out", "/repo/x.py", lines=(8, 19)), node("at", "deep/y.py", lines=(1, 1)), node("other", "/repo/zx.py", lines=(5, 5))], [edge("a", "b")])
    assert names(changes.changed_nodes(g, ranges), "name") == {("in",), ("at",)}


def test_risk_grows_without_tests(make):
    nodes = [node("login", community=1), node("plain", community=1), node("covered", community=1), *[node(f"c{i}", "/c.py", community=2) for i in range(4)], *[node(f"t{i}", "/t.py") for i in range(5)]]
    g = make(nodes, [edge(f"/c.py::c{i}", "/a.py::login") for i in range(4)] + [edge("/a.py::covered", f"/t.py::t{i}", "TESTED_BY") for i in range(5)])
    r = {x.name: x.risk_score for x in changes.risk(g, g.nodes).collect()}
    assert r["login"] == pytest.approx(0.15 + 0.3 + 0.2 + 0.1) and r["plain"] == 0.3 and r["covered"] == pytest.approx(0.05)


def test_ranges_merge_and_cap(spark):
    df = spark.createDataFrame([("f", 1, 5), ("f", 6, 8), ("f", 20, 30), ("f", 2, 3), ("g", 1, 1)], "file_path string, line_start long, line_end long")
    assert names(changes.merged_ranges(df), "file_path", "line_start", "line_end") == {("f", 1, 8), ("f", 20, 30), ("g", 1, 1)}
    assert names(changes.merged_ranges(df, 10), "file_path", "line_start", "line_end") == {("f", 1, 8), ("f", 20, 21), ("g", 1, 1)}


def test_search(make):
    g = make([node("get_users", "api.py"), node("create_user", "api.py"), node("authenticate", "auth.py"), node("UserService", "services.py", "Class"), node("UserResponse", "models.py", "Type")], [edge("a", "b")])
    postings = search.index(g.nodes, ("name", "qualified_name"), "qualified_name")
    assert names(search.phrase_search(postings, "get users"), "doc") == {("api.py::get_users",)}
    assert search.phrase_search(postings, "users get").count() == 0
    assert search.keyword_search(g, "authenticate").first().score == 3.0
    assert search.hybrid_search(g, postings, "get users").first().qualified_name == "api.py::get_users"
    assert search.hybrid_search(g, postings, "userserv", kind="Class").first().name == "UserService"
    assert [search.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "adjustment", "controlling")] == ["caress", "poni", "relat", "hop", "adjust", "control"]
    assert search.kind_boosts("UserService") == {"Class": 1.5, "Type": 1.5} and search.kind_boosts("a.b") == {"_qualified": 2.0}


def test_dead_code(make):
    nodes = [node("used"), node("dead"), node("test_x", test=True), node("main"), node("__str__"), node("near", "/n.py"), node("far", "/f.py"), node("far", "/g.py"), node("T", kind="Class"), node("U", kind="Class"), node("typed", params="(x: T)"), node("base", parent="Base"), node("base", parent="Child", path="/k.py")]
    g = make(nodes, [edge("/a.py::main", "/a.py::used"), edge("/z.py::z", "near"), edge("/z.py::z", "far"), edge("/a.py::main", "/a.py::typed"), edge("/a.py::main", "/a.py::Base.base"), edge("/k.py::Child", "/a.py::Base", "INHERITS")])
    assert names(refactor.dead_code(g)) == {"/a.py::dead", "/f.py::far", "/g.py::far", "/a.py::U"}


def test_moves_and_renames(make, tmp_path):
    g = make([node("m", community=1), node("x", "/b.py", community=2), node("y", "/b.py", community=2)], [edge("/b.py::x", "/a.py::m", line=3), edge("/b.py::y", "/a.py::m", line=3)])
    assert names(refactor.move_suggestions(g), "qualified_name", "target_community") == {("/a.py::m", 2)}
    assert sorted((r.line, r.why) for r in refactor.rename_preview(g, "m", "n").collect()) == [(1, "definition"), (3, "call"), (3, "call")]
    (tmp_path / "f.py").write_text("m = 1\nprint(m)\n")
    edits = [{"file_path": "f.py", "line": 2, "old": "m)", "new": "n)"}]
    assert "+print(n)" in refactor.apply_edits(edits, str(tmp_path)) and "m)" in (tmp_path / "f.py").read_text()
    refactor.apply_edits(edits, str(tmp_path), dry_run=False)
    assert "print(n)" in (tmp_path / "f.py").read_text()
    with pytest.raises(ValueError):
        refactor.apply_edits([{"file_path": "../f.py", "line": 1, "old": "a", "new": "b"}], str(tmp_path))


def test_snapshots(make, spark, tmp_path):
    a = make([node("x", community=1), node("y")], [edge("/a.py::x", "/a.py::y")])
    b = make([node("x", community=2), node("z")], [edge("/a.py::x", "/a.py::z")])
    summaries.save_snapshot(summaries.take_snapshot(a), str(tmp_path))
    d = summaries.diff_snapshots(summaries.load_snapshot(spark, str(tmp_path)), summaries.take_snapshot(b))
    assert names(d["new_nodes"]) == {"/a.py::z"} and names(d["removed_nodes"]) == {"/a.py::y"} and names(d["moved"]) == {"/a.py::x"}
    assert names(d["new_edges"], "edge") == {("/a.py::x->/a.py::z:CALLS",)}


def test_exports(make, tmp_path, spark):
    g = make([node("it's"), node("b", community=1)], [edge("/a.py::it's", "/a.py::b"), edge("/a.py::b", "/a.py::it's")])
    assert any(r"it\'s" in r.value for r in exports.cypher_rows(g).collect())
    exports.export_graphml(g, str(tmp_path / "g"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    assert text.count("<node") == 2 and text.count("<edge") == 2
    assert {r.slug: r.page.count("[[") for r in exports.vault_pages(g).collect()} == {"its": 1, "b": 1}
    exports.export_json(g, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "nodes")).count() == 2
    assert exports.wiki_pages(g, spark.createDataFrame([(1, "Core things")], "community_id long, name string")).first().slug == "core-things"


def test_embeddings_are_only_made_anew_for_changed_texts(make, spark):
    by = embeddings.provider("hashing", dimension=16)
    none = spark.createDataFrame([], "qualified_name string, vector array<float>, text_hash string, provider string")
    first = embeddings.embed_nodes(make([node("a"), node("b")], [edge("a", "b")]).nodes, none, by)
    marked = first.withColumn("vector", F.array(*[F.lit(0.0).cast("float")] * 16))
    again = embeddings.embed_nodes(make([node("a"), node("b", params="(x)")], [edge("a", "b")]).nodes, marked, by)
    assert {r.qualified_name: any(r.vector) for r in again.collect()} == {"/a.py::a": False, "/a.py::b": True}
    with pytest.raises(ValueError):
        embeddings.refresh(make([node("a")], [edge("a", "b")]).nodes, first, embeddings.provider("hashing", dimension=8))


def test_measures(spark):
    results = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("r", "z", 1)], "query string, item string, rank int")
    assert names(summaries.reciprocal_rank(results, spark.createDataFrame([("q", "y"), ("r", "n")], "query string, item string")), "query", "rr") == {("q", 0.5), ("r", 0.0)}
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    assert tuple(summaries.precision_recall(df("a", "b"), df("b", "c", "d"), "k").first()) == (0.5, 0.3333, 0.4)
    assert tuple(summaries.precision_recall(df(), df(), "k").first()) == (1.0, 1.0, 1.0)


# Reports


def test_forgetting_equals_a_build_without(make, spark):
    from graphloom.operators import reports

    nodes = [node("helper", "util.py"), node("shared", "shared.py"), node("main", "main.py")]
    g = make(nodes, [edge("main.py::main", "util.py::helper"), edge("main.py::main", "shared.py::shared"), edge("main.py", "util.py", "IMPORTS_FROM")])
    rebuilt = make([nodes[2]], [edge("main.py::main", "helper"), edge("main.py::main", "shared.py::shared"), edge("main.py", "util", "IMPORTS_FROM")])
    contents = spark.createDataFrame([("main.py", b""), ("shared.py", b"")], "path string, content binary")
    asked = []

    def parse(files):
        asked.extend(r.path for r in files.collect())
        return rebuilt

    out = reports.forget_files(g, spark.createDataFrame([("util.py",)], "file_path string"), parse, contents)
    assert asked == ["main.py"] and names(out.nodes, "name") == {("shared",), ("main",)}
    assert names(out.edges, "source", "target") == {("main.py::main", "helper"), ("main.py::main", "shared.py::shared"), ("main.py", "util")}


def test_reports(make, tmp_path):
    from graphloom.operators import reports

    g = make([node(x, lines=(k * 10, k * 10 + 5)) for k, x in enumerate("abcd")], [edge("/a.py::a", "/a.py::c"), edge("/a.py::a", "/a.py::b"), edge("/a.py::b", "/a.py::d"), edge("/a.py::d", "ghost")])
    assert reports.walk_depth_first(g, "/a.py::a", 2) == [("/a.py::a", 0), ("/a.py::b", 1), ("/a.py::d", 2), ("/a.py::c", 1)]
    context = reports.review_context(g, ["/a.py"])
    assert context["changed"].count() == 4 and context["ranges"].count() == 4 and context["impacted"].count() == 0
    assert reports.within_tokens(g.nodes.select("name"), ["name"], 8).count() == 2
    assert reports.gap_note("python", "callers_of") and reports.gap_note("go", "tests_for") and reports.gap_note("go", "callers_of") is None
    assert reports.compact("s", nodes=list(range(9))) == {"summary": "s", "risk": "unknown", "nodes": [0, 1, 2, 3, 4], "nodes_total": 9}
    assert "why" in open(reports.save_answer(str(tmp_path), "why", "so")).read()
    sizes = g.nodes.sparkSession.createDataFrame([("/a.py", 40_000)], "file_path string, length long")
    postings = search.index(g.nodes, ("name", "qualified_name"), "qualified_name")
    assert reports.token_benchmark(g, postings, sizes, ["a", "b"]).where("ratio > 10").count() == 2


def test_maintenance_of_communities(make):
    g = make([node(f"n{i}", f"/p/{i % 2}.py", community=1 if i < 30 else 2) for i in range(34)], [edge(f"/p/{i % 2}.py::n{i}", f"/p/{j % 2}.py::n{j}") for i in range(15) for j in range(i)] + [edge(f"/p/{i % 2}.py::n{i}", f"/p/{j % 2}.py::n{j}") for i in range(15, 30) for j in range(15, i)])
    assert names(communities.oversized(g), "community_id") == {(1,)}
    assert communities.split_oversized(g).select("part").distinct().count() == 2
    assert communities.needs_detection(g, ["/p/0.py"]) and not communities.needs_detection(g, ["/q.py"])
    members = g.nodes.select("qualified_name").limit(3).withColumn("community_id", F.lit(9).cast("long"))
    assert store.has_nodes(g, "python") and communities.store_communities(g.nodes, members).where("community_id = 9").count() == 3
    assert analytics.auto_mode(10, 10) == "full" and analytics.auto_mode(5000, 10) == "community" and analytics.auto_mode(10, 10_000, has_communities=False) == "file"
