import pytest

from graphloom.graph import Graph
from graphloom.operators import changes, flows, refactor, search, traverse

NODES = "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, community_id long, extra string"


def made(spark, nodes, edges):
    """nodes: (kind, name, language, extra); edges: (kind, source, target) of names."""
    rows = [(k, n, f"/a.x::{n}", "/a.x", 1, 2, language, None, None, None, False, 1, extra) for k, n, language, extra in nodes]
    known = {n: f"/a.x::{n}" for _, n, *_ in nodes}
    lines = [(k, known.get(a, a), known.get(b, b), "/a.x", i) for i, (k, a, b) in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, NODES), spark.createDataFrame(lines, "kind string, source string, target string, file_path string, line long"))


ENTRIES = "main __main__ test_x TestCase on_click handle_it handler handle lambda_handler upgrade downgrade lifespan get_db onCreateView doGet do_POST log_message errorHandler middleware ngOnInit transform canActivate componentDidMount render".split()
OTHERS = "run start serve app cli index execute testing widget Test1 Main my_handler doget do_get ngOnInitX rendering boot register __invoke onclick".split()
DECORATORS = ["app.get('/x')", "router.post", "bp.route('/')", "receiver(sig)", "agent.tool", "tool", "GetMapping", "celery.task", "pytest.fixture", "field_validator('x')", "mygroup.command()", "@Override", "event.listens_for(x)", "api.middleware('http')"]
PLAIN = ["widget", "toolbox", "Pytest.Fixture", "functools.lru_cache", "router.use2"]


def test_names_and_decorators_of_entry_points(spark):
    names = [("Function", n, "python", None) for n in ENTRIES + OTHERS] + [("Function", "boot", "php", None), ("Function", "__invoke", "php", None)]
    names = [n for n in names if n[1] not in ("boot", "__invoke") or n[2] == "php"] + [("Function", "register", "java", None)]
    names = list(dict.fromkeys(names))
    decorated = [("Function", f"d{k}", "python", '{"decorators": ["x.y", "%s"]}' % d) for k, d in enumerate(DECORATORS)]
    decorated += [("Function", "one", "python", '{"decorators": "app.route"}')] + [("Function", f"p{k}", "python", '{"decorators": ["%s"]}' % d) for k, d in enumerate(PLAIN)]
    nodes = names + decorated
    g = made(spark, nodes, [("CALLS", "main", n) for _, n, *_ in nodes])
    found = {r.name for r in flows.entry_points(g, include_tests=True).collect()}
    assert found == {*ENTRIES, "boot", "__invoke", "one", *(f"d{k}" for k in range(len(DECORATORS)))}


def test_dead_code_leaves_entry_points(spark):
    g = made(spark, [("Function", n, "python", None) for n in ("upgrade", "run", "d")] + [("Function", "e", "python", '{"decorators": ["agent.tool"]}')], [("CALLS", "nobody", "elsewhere")])
    assert {r.name for r in refactor.dead_code(g).collect()} == {"run", "d"}


def test_tests_of_members_and_callees_count(spark):
    nodes = [("Class", "K", "x", None)] + [("Function", n, "x", None) for n in ("m", "f", "g", "h", "t1", "t2", "t3")] + [("File", "file", "x", None)]
    edges = [("CONTAINS", "K", "m"), ("TESTED_BY", "m", "t1"), ("CALLS", "f", "g"), ("CALLS", "g", "h"), ("TESTED_BY", "g", "t2"), ("TESTED_BY", "h", "t3"), ("TESTED_BY", "f", "unknown"), ("TESTED_BY", "g", "t1")]
    g = made(spark, nodes, edges)
    found = {r.qualified_name[6:]: r.tests for r in traverse.test_counts(g, g.nodes).collect()}
    assert found == {"K": 1, "m": 1, "f": 2, "g": 3, "h": 1, "file": 3}


def test_flows_count_for_the_risk(spark):
    g = made(spark, [("Function", n, "x", None) for n in ("a", "b", "c")], [("CALLS", "a", "b")])
    scores = spark.createDataFrame([("/a.x::a", 0.1), ("/a.x::a", 0.05), ("/a.x::b", None), ("/a.x::b", None)], "node string, criticality double")
    risk = {r.name: r.risk_score for r in changes.risk(g, g.nodes, scores).collect()}
    assert risk == {"a": pytest.approx(0.45), "b": pytest.approx(0.45), "c": pytest.approx(0.3)}
    ranges = spark.createDataFrame([("/a.x", 1, 9)], "file_path string, line_start long, line_end long")
    steps = flows.trace_flows(g)
    with_flows = {r.name: r.risk_score for r in changes.analyze(g, ranges, steps)["changed"].collect()}
    worth = flows.criticality(g, steps).first().criticality
    assert with_flows == {"a": pytest.approx(0.3 + min(worth, 0.25)), "b": pytest.approx(0.35 + min(worth, 0.25)), "c": pytest.approx(0.3)}


def test_several_diffs_and_catalogs(spark):
    lines = [(d, n, line) for d in ("x", "y") for n, line in enumerate([f"+++ b/{d}.py", "@@ -1,0 +5,2 @@", "+a", f"+++ b/{d}2.py", "@@ -1 +7 @@"])]
    found = changes.parse_unified_diff(spark.createDataFrame(lines, "diff string, n int, line string")).collect()
    assert sorted(map(tuple, found)) == [(d, f"{d}{k}.py", a, b) for d in ("x", "y") for k, a, b in (("", 5, 6), ("2", 7, 7))]
    lists = [(name, spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "doc int, score double")) for name in ("one", "two")]
    merged = search.cross_repo(lists, "doc", 5).collect()
    assert [(r.repo, r["rank"], r.doc) for r in merged] == [("one", 1, 6), ("two", 1, 6), ("one", 2, 13), ("two", 2, 13), ("one", 3, 20)]
