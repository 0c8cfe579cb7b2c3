import random

from graphloom.graph import Graph
from graphloom.operators import resolve
from graphloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_risk_sends_no_table_through_the_driver(spark):
    assert "BroadcastExchange" not in plan(QUERIES["node_risk"][0](spark, SF))


def test_names_and_nodes_are_not_sent_through_the_driver(spark):
    assert "BroadcastExchange" not in plan(QUERIES["tested_names"][0](spark, SF))


def test_pairs_of_an_event_are_not_shuffled(spark):
    rng = random.Random(5)
    said = {(f"/p.py::p{k}", f"e{e}", "/p.py", k % 3) for k in range(400) for e in rng.sample(range(4), rng.randrange(3))}
    heard = {(f"/h.py::h{k}", f"e{e}", "/h.py", 1) for k in range(300) for e in rng.sample(range(4), rng.randrange(4))}
    edges = spark.createDataFrame([("PUBLISHES", *x) for x in said] + [("HANDLES", *x) for x in heard], "kind string, source string, target string, file_path string, line long")
    made = resolve.event_calls(Graph(None, edges)).where("kind = 'CALLS'").select("source", "target", "file_path", "line", "extra")
    expected = {}
    for p, e, f, n in said:
        for h, x, _, _ in heard:
            if x == e:
                expected[p, h, f, n] = min(e, expected.get((p, h, f, n), e))
    found = [(r.source, r.target, r.file_path, r.line, r.extra) for r in made.collect()]
    assert sorted(found) == sorted((*k, f'{{"derived":"event","event":"{e}"}}') for k, e in expected.items())
    assert "Exchange" not in plan(made.select("source", "target")).split("Generate explode")[0].split("Initial Plan")[-1]
