"""Queries over all rows of their tables, against brute force."""

from collections import defaultdict

from graphloom.plans.queries import QUERIES
from graphloom.sources import tables

SF = "/root/testdata/sf0.001"


def lines_of(spark):
    found = defaultdict(list)
    for r in tables.read(spark, SF, "part").collect():
        found[f"part/{r.p_brand}"].append((r.p_partkey % 1000, r.p_size, f"part/{r.p_brand}::P{r.p_partkey}"))
    return found


def test_merged_ranges_of_all_parts(spark):
    expected = set()
    for f, own in lines_of(spark).items():
        lines = sorted({k for a, size, _ in own for k in range(a, a + size + 1)})
        starts = [k for k in lines if k - 1 not in set(lines)]
        ends = [k for k in lines if k + 1 not in set(lines)]
        expected |= {(f, a, b) for a, b in zip(starts, ends, strict=True)}
    rows = QUERIES["merged_ranges_all"][0](spark, SF).collect()
    assert {(r.file_path, r.line_start, r.line_end) for r in rows} == expected and len(rows) == len(expected)


def test_changed_nodes_and_cursors_of_all_parts(spark):
    parts = lines_of(spark)
    hit = QUERIES["changed_nodes_overlap_all"][0](spark, SF).collect()
    assert sorted(r.qualified_name for r in hit) == sorted(q for own in parts.values() for _, _, q in own)
    at = {(f, a): min((n, q) for b, n, q in [*own, (0, 0, f)] if b <= a <= b + n)[1] for f, own in parts.items() for a, _, _ in own}
    rows = QUERIES["node_at_cursor_all"][0](spark, SF).collect()
    assert {(r.file_path, r.line): r.qualified_name for r in rows} == at and len(rows) == len(at)


def test_cypher_of_all_nodes_and_edges(spark):
    g = tables.graph(spark, SF)
    rows = QUERIES["cypher_export_all"][0](spark, SF).collect()
    nodes, edges = [r.value for r in rows if r.part == 1], [r.value for r in rows if r.part == 2]
    assert len(nodes) == g.nodes.count() and len(edges) == g.edges.count()
    assert {v.split(" ")[1] for v in nodes} == {"(:File", "(:Class", "(:Function"}
    assert {v.split("[:")[1].split("]")[0] for v in edges} == {"CALLS", "DEPENDS_ON", "TESTED_BY", "CONTAINS"}
    for name in ("split_names_all", "path_functions_all"):
        assert QUERIES[name][0](spark, SF).count() == len(nodes)


def test_a_state_is_updated_and_added_to(spark):
    events = sorted((r.event_id % 2, r.ts, r.event_id, r.user_id, r.event_type) for r in tables.read(spark, SF, "events").collect())
    last, even = {u: t for *_, u, t in events}, {u: t for k, _, _, u, t in events if k == 0}
    rows = QUERIES["upsert_latest_halves"][0](spark, SF).collect()
    assert {r.user_id: r.event_type for r in rows} == last and len(rows) == len(last)
    assert {r.user_id for r in rows if r.known} == set(even)
    assert any(even[u] != last[u] for u in even)
