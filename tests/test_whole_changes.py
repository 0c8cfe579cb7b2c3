"""A change over more files than a report lists."""

from graphloom.operators import changes, flows
from graphloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_flows_of_all_changed_files(spark):
    g = tables.chain_graph(spark, SF)
    steps = flows.trace_flows(g)
    ranges = g.nodes.select("file_path", "line_start", "line_end")
    found = {r.entry for r in changes.analyze(g, ranges, steps, most=3)["flows"].select("entry").collect()}
    everything = {r.entry for r in flows.flows(g, steps, limit=None).select("entry").collect()}
    assert found == everything and len(everything) > 3
