"""Queries over the relational tables: each an operator with its parameters, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.graph import Graph, large, shared_folder
from graphloom.operators import analytics, changes, communities, embeddings, evaluate, exports, flows, patterns, refactor, resolve, search, store, summaries, traverse
from graphloom.sources import tables

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
GRAPH = f"WITH nodes AS ({tables.plain(tables.NODES)}), edges AS ({tables.plain(tables.EDGES)})"
CHAIN = f"WITH nodes AS ({tables.plain(tables.CHAIN_NODES)}), edges AS ({tables.plain(tables.CHAIN_EDGES)})"
RICH = f"WITH nodes AS ({tables.plain(tables.RICH_NODES)}), edges AS ({tables.plain(tables.RICH_EDGES)})"
FILE = "part/Brand#2"
DEGREES = "degrees AS (SELECT q, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS degree FROM (SELECT source AS q, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) AS ends GROUP BY q)"
ARCS = """arcs AS (SELECT s, t, max(w) AS w FROM (SELECT CASE WHEN kind = 'TESTED_BY' THEN source ELSE target END AS s, CASE WHEN kind = 'TESTED_BY' THEN target ELSE source END AS t,
  CASE kind WHEN 'CALLS' THEN CAST(1.0 AS DOUBLE) WHEN 'TESTED_BY' THEN CAST(0.7 AS DOUBLE) WHEN 'DEPENDS_ON' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS w FROM edges WHERE kind <> 'CONTAINS') AS x GROUP BY s, t)"""
IMPACT = f"""seeds AS (SELECT DISTINCT qualified_name AS q FROM nodes WHERE file_path = '{FILE}'),
  h1 AS (SELECT t AS q, max(CAST(1.0 AS DOUBLE) * w * CAST(0.6 AS DOUBLE)) AS score FROM seeds JOIN arcs ON s = q GROUP BY t), k1 AS (SELECT * FROM h1 WHERE score > 0.05),
  h2 AS (SELECT t AS q, max(score * w * CAST(0.6 AS DOUBLE)) AS score FROM k1 JOIN arcs ON s = q GROUP BY t),
  best AS (SELECT q, max(score) AS score FROM (SELECT * FROM k1 UNION ALL SELECT * FROM h2 WHERE score > 0.05) AS u GROUP BY q)"""
GAPS = "SELECT n.qualified_name FROM nodes n WHERE n.kind = 'Function' AND NOT n.is_test AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'TESTED_BY' AND e.source = n.qualified_name)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def seed(g: Graph, tail: str) -> str:
    return g.nodes.where(F.col("qualified_name").endswith(tail)).select(F.min("qualified_name")).first()[0]


def graph(spark, sf_dir) -> Graph:
    return tables.graph(spark, sf_dir)


def chain(spark, sf_dir) -> Graph:
    return tables.chain_graph(spark, sf_dir)


# Traversal


@query(f"{GRAPH}, {ARCS}, {IMPACT} SELECT n.qualified_name, n.kind, n.file_path, round(b.score, 4) AS impact_score FROM best b JOIN nodes n ON n.qualified_name = b.q WHERE b.q NOT IN (SELECT q FROM seeds)")
def impact_radius(spark, sf_dir):
    return traverse.impact_radius(graph(spark, sf_dir), [FILE], limit=None).select("qualified_name", "kind", "file_path", "impact_score")


@query(f"{GRAPH}, {ARCS}, {IMPACT} SELECT n.qualified_name, round(b.score, 4) AS impact_score FROM best b JOIN nodes n ON n.qualified_name = b.q WHERE b.q NOT IN (SELECT q FROM seeds) ORDER BY b.score DESC, n.qualified_name LIMIT 100")
def impact_topk(spark, sf_dir):
    return traverse.impact_radius(graph(spark, sf_dir), [FILE], limit=100).select("qualified_name", "impact_score")


@query(f"{GRAPH}, {ARCS}, {IMPACT} SELECT count(*) AS total_impacted, count(DISTINCT n.file_path) AS impacted_files, CASE WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM best b JOIN nodes n ON n.qualified_name = b.q WHERE b.q NOT IN (SELECT q FROM seeds)")
def impact_summary(spark, sf_dir):
    return traverse.impact_summary(traverse.impact_radius(graph(spark, sf_dir), [FILE], limit=None))


@query(f"""{GRAPH}, both_ways AS (SELECT source s, target t FROM edges UNION SELECT target, source FROM edges), seeds AS (SELECT qualified_name q FROM nodes WHERE file_path = 'nation/7'),
  r1 AS (SELECT DISTINCT t AS q FROM both_ways JOIN seeds ON s = q WHERE t NOT IN (SELECT q FROM seeds))
  SELECT n.qualified_name, 1 AS hops FROM r1 JOIN nodes n ON n.qualified_name = q""")
def impact_bfs_undirected(spark, sf_dir):
    return traverse.impact_bfs(graph(spark, sf_dir), ["nation/7"], 1).select("qualified_name", "hops")


@query(f"{GRAPH}, {DEGREES} SELECT qualified_name, in_degree, out_degree, degree FROM degrees JOIN nodes ON qualified_name = q WHERE kind <> 'File' ORDER BY degree DESC, qualified_name LIMIT 10")
def hub_nodes(spark, sf_dir):
    return traverse.hub_nodes(graph(spark, sf_dir), 10).select("qualified_name", "in_degree", "out_degree", "degree")


@query(f"""{GRAPH}, f AS (SELECT DISTINCT n.file_path AS f, e.file_path AS d FROM edges e JOIN nodes n ON n.qualified_name = e.target WHERE e.kind = 'CALLS' AND n.file_path <> e.file_path)
  SELECT d AS file_path, min(h) AS hops, count(*) OVER () > 500 AS truncated FROM (SELECT d, 1 AS h FROM f WHERE f = 'nation/3' UNION ALL SELECT b.d, 2 FROM f a JOIN f b ON b.f = a.d WHERE a.f = 'nation/3') AS x WHERE d <> 'nation/3' GROUP BY d""")
def dependents(spark, sf_dir):
    return traverse.find_dependents(graph(spark, sf_dir), "nation/3", 2)


@query(f"""{GRAPH}, start AS (SELECT qualified_name q FROM nodes WHERE file_path = '{FILE}'), known AS (SELECT DISTINCT source s, target t FROM edges WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM nodes)),
  reached AS (SELECT q, 0 AS hops FROM start UNION ALL SELECT DISTINCT t, 1 FROM known JOIN start ON s = q WHERE t NOT IN (SELECT q FROM start))
  SELECT e.target AS test, min(hops) AS hops, any_value(n.file_path) AS file_path FROM reached JOIN edges e ON e.source = q AND e.kind = 'TESTED_BY' JOIN nodes n ON n.qualified_name = e.target GROUP BY e.target""")
def transitive_tests(spark, sf_dir):
    return traverse.transitive_tests(graph(spark, sf_dir), [FILE], 1, None)


@query(f"{GRAPH} SELECT DISTINCT file_path FROM edges WHERE (source IN (SELECT qualified_name FROM nodes WHERE file_path = 'nation/5') OR target IN (SELECT qualified_name FROM nodes WHERE file_path = 'nation/5')) AND file_path <> 'nation/5'")
def referrer_files(spark, sf_dir):
    g = graph(spark, sf_dir)
    own = g.nodes.where("file_path = 'nation/5'")
    return traverse.referrer_files(g, own.select("qualified_name"), own.select("file_path").distinct())


@query(f"""{CHAIN}, calls AS (SELECT source, target FROM edges WHERE kind IN ('CALLS', 'TESTED_BY')), both_ways AS (SELECT source s, target t FROM calls UNION SELECT target, source FROM calls), start AS (SELECT min(qualified_name) q FROM nodes),
  r1 AS (SELECT t q FROM both_ways JOIN start ON s = q), r2 AS (SELECT b.t q FROM both_ways b JOIN r1 ON b.s = r1.q WHERE r1.q IN (SELECT qualified_name FROM nodes)),
  met AS (SELECT q, min(h) AS hops FROM (SELECT q, 0 h FROM start UNION ALL SELECT q, 1 FROM r1 UNION ALL SELECT q, 2 FROM r2) AS x GROUP BY q)
  SELECT qualified_name, hops FROM met JOIN nodes ON qualified_name = q""")
def traverse_bfs(spark, sf_dir):
    g = chain(spark, sf_dir)
    return traverse.traverse(g, g.nodes.select(F.min("qualified_name")).first()[0], 2, 100_000).select("qualified_name", "hops")


@query(None)
def bridge_nodes(spark, sf_dir):
    return traverse.bridge_nodes(chain(spark, sf_dir), 10).select("qualified_name", F.round("betweenness", 8).alias("betweenness"))


# One-hop patterns

S1 = "(SELECT qualified_name FROM nodes WHERE qualified_name LIKE '%::S1')"


@query(f"{GRAPH} SELECT qualified_name, FALSE AS unresolved FROM nodes WHERE qualified_name IN (SELECT source FROM edges WHERE kind = 'CALLS' AND target = {S1})")
def callers_of(spark, sf_dir):
    g = graph(spark, sf_dir)
    return patterns.callers_of(g, seed(g, "::S1")).select("qualified_name", "unresolved")


@query(f"{GRAPH} SELECT DISTINCT target AS qualified_name, FALSE AS unresolved FROM edges WHERE kind = 'CALLS' AND source = (SELECT qualified_name FROM nodes WHERE qualified_name LIKE '%::C10')")
def callees_of(spark, sf_dir):
    g = graph(spark, sf_dir)
    return patterns.callees_of(g, seed(g, "::C10")).select("qualified_name", "unresolved")


@query(f"{GRAPH} SELECT qualified_name, kind FROM nodes WHERE qualified_name IN (SELECT target FROM edges WHERE kind = 'CONTAINS' AND source = 'nation/7')")
def children_of(spark, sf_dir):
    return patterns.children_of(graph(spark, sf_dir), "nation/7").select("qualified_name", "kind")


@query(f"{GRAPH} SELECT DISTINCT target AS qualified_name, 'edge' AS \"by\" FROM edges WHERE kind = 'TESTED_BY' AND source = (SELECT qualified_name FROM nodes WHERE qualified_name LIKE '%::P1')")
def tests_for(spark, sf_dir):
    g = graph(spark, sf_dir)
    return patterns.tests_for(g, seed(g, "::P1"), "no such name", 0)


@query(f"{GRAPH} SELECT qualified_name, kind, name FROM nodes WHERE file_path = '{FILE}'")
def file_summary(spark, sf_dir):
    return patterns.file_summary(graph(spark, sf_dir), [FILE]).select("qualified_name", "kind", "name")


@query(f"{GRAPH} SELECT qualified_name, CASE WHEN qualified_name = 'Brand#2' THEN 0 WHEN name = 'Brand#2' THEN 1 WHEN qualified_name LIKE '%::Brand#2' OR qualified_name LIKE '%.Brand#2' THEN 2 ELSE 3 END AS match_rank FROM nodes WHERE lower(qualified_name) LIKE '%brand#2%'")
def disambiguation(spark, sf_dir):
    g = graph(spark, sf_dir)
    return patterns.disambiguate(store.search_nodes(g, "Brand#2", None), "Brand#2").select("qualified_name", "match_rank")


def rich(spark, sf_dir) -> Graph:
    return tables.rich_graph(spark, sf_dir)


def _ends(kinds: str, own: str, other: str, name: str, more: str = "") -> str:
    return f"{RICH} SELECT qualified_name FROM nodes WHERE qualified_name IN (SELECT {other} FROM edges WHERE kind IN ({kinds}) AND {own} = {name}){more}"


S2, C12 = "(SELECT qualified_name FROM nodes WHERE qualified_name LIKE '%::S2')", "(SELECT qualified_name FROM nodes WHERE qualified_name LIKE '%::C12')"


@query(_ends("'REFERENCES'", "target", "source", S2))
def references_to(spark, sf_dir):
    g = rich(spark, sf_dir)
    return patterns.references_to(g, seed(g, "::S2")).select("qualified_name")


@query(_ends("'INHERITS', 'IMPLEMENTS'", "target", "source", S2))
def inheritors_of(spark, sf_dir):
    g = rich(spark, sf_dir)
    return patterns.inheritors_of(g, seed(g, "::S2")).select("qualified_name")


@query(_ends("'TRIGGERS'", "source", "target", S2))
def triggers_of(spark, sf_dir):
    g = rich(spark, sf_dir)
    return patterns.triggers_of(g, seed(g, "::S2")).select("qualified_name")


@query(_ends("'TRIGGERS'", "target", "source", C12))
def triggered_by(spark, sf_dir):
    g = rich(spark, sf_dir)
    return patterns.triggered_by(g, seed(g, "::C12")).select("qualified_name")


@query(_ends("'PUBLISHES'", "target", "source", "'event/purchase'"))
def publishers_of(spark, sf_dir):
    return patterns.publishers_of(rich(spark, sf_dir), "event/purchase").select("qualified_name")


@query(_ends("'HANDLES'", "target", "source", "'event/purchase'"))
def listeners_of(spark, sf_dir):
    return patterns.listeners_of(rich(spark, sf_dir), "event/purchase").select("qualified_name")


@query(_ends("'HANDLES'", "target", "source", "(SELECT min(qualified_name) FROM nodes WHERE kind = 'Endpoint')"))
def handlers_of(spark, sf_dir):
    g = rich(spark, sf_dir)
    return patterns.handlers_of(g, g.nodes.where("kind = 'Endpoint'").select(F.min("qualified_name")).first()[0]).select("qualified_name")


@query(_ends("'HANDLES'", "source", "target", S2, " AND kind = 'Endpoint'"))
def endpoints_for(spark, sf_dir):
    g = rich(spark, sf_dir)
    return patterns.endpoints_for(g, seed(g, "::S2")).select("qualified_name")


@query(f"{RICH} SELECT target FROM edges WHERE kind = 'IMPORTS_FROM' AND source = 'nation/4'")
def imports_of(spark, sf_dir):
    return patterns.imports_of(rich(spark, sf_dir), "nation/4")


@query(f"{RICH} SELECT DISTINCT file_path AS importer FROM edges WHERE kind = 'IMPORTS_FROM' AND target = 'nation/4'")
def importers_of(spark, sf_dir):
    return patterns.importers_of(rich(spark, sf_dir), "nation/4")


@query(f"{RICH} SELECT DISTINCT source FROM edges WHERE kind = 'DEPENDS_ON_CONFIG' AND target IN ('config:app.db.url', 'config:app.db.url.*', 'config:app.*', 'config:app.db.*')")
def consumers_of(spark, sf_dir):
    return patterns.consumers_of(rich(spark, sf_dir), "app.db.url")


@query(f"{RICH}, s AS (SELECT name FROM nodes WHERE qualified_name LIKE '%::S2') SELECT source, target FROM edges WHERE kind = 'CALLS' AND target = (SELECT name FROM s) AND source IN (SELECT qualified_name FROM nodes WHERE language = 'python')")
def edges_by_target_name(spark, sf_dir):
    g = rich(spark, sf_dir)
    name = g.nodes.where(F.col("qualified_name") == seed(g, "::S2")).first().name
    return store.edges_by_target_name(g, name, "CALLS", "python").select("source", "target")


@query(f"{RICH} SELECT DISTINCT p.source, h.source AS target, 0.95::DOUBLE AS confidence FROM edges p JOIN edges h ON p.target = h.target WHERE p.kind = 'PUBLISHES' AND h.kind = 'HANDLES'")
def event_calls(spark, sf_dir):
    g = rich(spark, sf_dir)
    return resolve.event_calls(g.with_tables(edges=g.edges.where("kind <> 'CALLS'"))).where("kind = 'CALLS'").select("source", "target", "confidence")


@query(f"""{RICH}, near AS (SELECT DISTINCT file_path AS c, split_part(target, '::', 1) AS h FROM edges WHERE kind = 'IMPORTS_FROM' UNION SELECT DISTINCT file_path, file_path FROM edges),
  f AS (SELECT e.source, e.target AS name, count(DISTINCT n.qualified_name) AS n, min(n.qualified_name) AS found FROM edges e JOIN nodes n ON n.name = e.target AND n.kind IN ('Function', 'Test', 'Class') JOIN near ON c = e.file_path AND h = n.file_path WHERE e.kind = 'CALLS' GROUP BY 1, 2)
  SELECT e.source, CASE WHEN f.n = 1 THEN f.found ELSE e.target END AS target FROM edges e LEFT JOIN f ON f.source = e.source AND f.name = e.target WHERE e.kind = 'CALLS'""")
def imported_calls(spark, sf_dir):
    return resolve.resolve_bare_calls(rich(spark, sf_dir)).where("kind = 'CALLS'").select("source", "target")


@query(f"{RICH}, f AS (SELECT DISTINCT split_part(target, '::', 1) AS f, file_path AS d FROM edges WHERE kind = 'IMPORTS_FROM' UNION SELECT n.file_path, e.file_path FROM edges e JOIN nodes n ON n.qualified_name = e.target WHERE e.kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS')) SELECT f AS file_path, d AS dependent FROM f WHERE f <> d AND f IN ('nation/1', 'nation/2')")
def file_dependents(spark, sf_dir):
    wanted = spark.createDataFrame([("nation/1",), ("nation/2",)], "file_path string")
    return traverse.single_hop_dependents(rich(spark, sf_dir), wanted)


@query(f"{RICH} SELECT split_part(qualified_name, '/', 1) AS grouping, count(*) AS n FROM nodes WHERE kind <> 'File' GROUP BY 1")
def detected_communities(spark, sf_dir):
    return communities.detect_by_directory(rich(spark, sf_dir)).groupBy("grouping").agg(F.count("*").alias("n"))


@query(f"{RICH} SELECT count(*) AS n FROM nodes WHERE kind = 'Event'")
def count_by_kind(spark, sf_dir):
    return store.nodes_by_kind(rich(spark, sf_dir), ("Event",)).agg(F.count("*").alias("n"))


# Reads and counts


@query(f"{GRAPH} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def graph_stats_by_kind(spark, sf_dir):
    return analytics.stats_by_kind(graph(spark, sf_dir))


@query(f"{GRAPH} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_stats(spark, sf_dir):
    return analytics.stats_by_edge_kind(graph(spark, sf_dir))


@query(f"{GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT file_path) FROM nodes) AS files, (SELECT count(*) FROM edges) AS edges")
def graph_stats(spark, sf_dir):
    return analytics.stats(graph(spark, sf_dir)).select("nodes", "files", "edges")


@query(f"{GRAPH} SELECT qualified_name, line_end - line_start + 1 AS line_count FROM nodes WHERE line_end - line_start + 1 >= 20 AND file_path ILIKE '%part%' ORDER BY line_count DESC, qualified_name LIMIT 50")
def large_nodes(spark, sf_dir):
    return store.nodes_by_size(graph(spark, sf_dir), 20, path_pattern="part").select("qualified_name", "line_count")


@query(f"{GRAPH} SELECT DISTINCT file_path FROM nodes WHERE file_path ILIKE '%#3'")
def files_matching(spark, sf_dir):
    return store.files_matching(graph(spark, sf_dir), "#3")


@query(f"{GRAPH} SELECT file_path FROM nodes UNION SELECT file_path FROM edges")
def all_files(spark, sf_dir):
    return store.all_files(graph(spark, sf_dir))


@query(f"{GRAPH} SELECT file_path FROM nodes WHERE kind = 'File'")
def file_markers(spark, sf_dir):
    return store.file_marker_paths(graph(spark, sf_dir))


@query(f"{GRAPH} SELECT kind, source, target, line FROM edges WHERE source IN (SELECT qualified_name FROM nodes WHERE file_path IN ('nation/1', 'nation/2')) AND target IN (SELECT qualified_name FROM nodes WHERE file_path IN ('nation/1', 'nation/2'))")
def edges_among(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.edges_among(g, g.nodes.where("file_path IN ('nation/1', 'nation/2')")).select("kind", "source", "target", "line")


@query(f"{GRAPH} SELECT DISTINCT target FROM edges WHERE kind = 'CALLS' AND source NOT IN (SELECT qualified_name FROM nodes WHERE kind = 'File')")
def call_targets(spark, sf_dir):
    return store.call_targets(graph(spark, sf_dir), False)


@query(f"{GRAPH} SELECT target FROM edges WHERE source IN (SELECT qualified_name FROM nodes WHERE file_path = 'nation/4')")
def outgoing_targets(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.outgoing_targets(g, g.nodes.where("file_path = 'nation/4'"))


@query(f"{GRAPH} SELECT source FROM edges WHERE target IN (SELECT qualified_name FROM nodes WHERE file_path = 'nation/4')")
def incoming_sources(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.incoming_sources(g, g.nodes.where("file_path = 'nation/4'"))


@query(f"{GRAPH} SELECT count(*) AS n FROM nodes WHERE name = 'Brand#1' AND kind IN ('File')")
def count_by_name(spark, sf_dir):
    return store.count_nodes_by_name(graph(spark, sf_dir), "Brand#1", kinds=("File",))


@query(f"{GRAPH} SELECT qualified_name, name FROM nodes WHERE kind IN ('Class', 'File')")
def nodes_by_kind(spark, sf_dir):
    return store.nodes_by_kind(graph(spark, sf_dir), ("Class", "File")).select("qualified_name", "name")


@query(f"{GRAPH} SELECT qualified_name FROM nodes WHERE (lower(name) LIKE '%customer%' OR lower(qualified_name) LIKE '%customer%') AND (lower(name) LIKE '%01%' OR lower(qualified_name) LIKE '%01%')")
def search_nodes(spark, sf_dir):
    return store.search_nodes(graph(spark, sf_dir), "customer 01", None).select("qualified_name")


@query(f"{GRAPH} SELECT source, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM edges WHERE kind = 'CALLS' GROUP BY source")
def adjacency(spark, sf_dir):
    return store.adjacency(graph(spark, sf_dir)).select("source", F.array_join("targets", ",").alias("targets"))


@query(f"""{GRAPH}, w AS (SELECT source, target, kind, CASE kind WHEN 'CALLS' THEN 1.0::DOUBLE WHEN 'TESTED_BY' THEN 0.7::DOUBLE WHEN 'DEPENDS_ON' THEN 0.6::DOUBLE WHEN 'CONTAINS' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS w FROM edges)
  SELECT source, target, count(*) AS n, max(w) AS weight FROM w GROUP BY source, target""")
def collapsed_edges(spark, sf_dir):
    from graphloom.schema import IMPACT_DEFAULT_WEIGHT, IMPACT_WEIGHT

    return store.collapsed(graph(spark, sf_dir), IMPACT_WEIGHT, IMPACT_DEFAULT_WEIGHT).select("source", "target", "n", "weight")


@query(f"{GRAPH} SELECT qualified_name, community_id FROM nodes WHERE file_path = 'nation/9'")
def community_map(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.community_of(g, g.nodes.where("file_path = 'nation/9'"))


@query(f"{GRAPH} SELECT qualified_name FROM nodes WHERE community_id = 3")
def community_members(spark, sf_dir):
    return store.community_members(graph(spark, sf_dir), 3).select("qualified_name")


@query(f"{GRAPH} SELECT DISTINCT unnest(regexp_extract_all(concat_ws(' ', params, return_type), '\\b[A-Z]\\w*')) AS name FROM nodes")
def referenced_types(spark, sf_dir):
    return analytics.referenced_type_names(graph(spark, sf_dir))


# Analytics


@query(f"{GRAPH}, {DEGREES} SELECT qualified_name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees ON q = qualified_name WHERE kind <> 'File' AND coalesce(degree, 0) <= 1")
def gaps_isolated(spark, sf_dir):
    return analytics.isolated(graph(spark, sf_dir), None).select("qualified_name", "degree")


@query(f"{GRAPH}, {DEGREES} SELECT qualified_name, degree FROM degrees JOIN nodes ON q = qualified_name WHERE kind <> 'File' AND NOT is_test AND degree >= 5 AND q NOT IN (SELECT source FROM edges WHERE kind = 'TESTED_BY')")
def gaps_hotspots(spark, sf_dir):
    return analytics.untested_hotspots(graph(spark, sf_dir), most=None).select("qualified_name", "degree")


@query(f"{GRAPH} SELECT community_id, count(*) AS n FROM nodes GROUP BY community_id HAVING count(*) < 900")
def gaps_thin(spark, sf_dir):
    return analytics.thin_communities(graph(spark, sf_dir), 900)


@query(f"{GRAPH} SELECT community_id, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes GROUP BY community_id HAVING count(DISTINCT file_path) = 1 AND count(*) >= 3")
def gaps_single_file(spark, sf_dir):
    return analytics.single_file_communities(graph(spark, sf_dir))


@query(f"""{GRAPH}, {DEGREES}, med AS (SELECT degree AS m FROM degrees WHERE degree > 0 ORDER BY degree LIMIT 1 OFFSET (SELECT count(*) // 2 FROM degrees WHERE degree > 0)),
  pairs AS (SELECT DISTINCT kind, source, target FROM edges WHERE kind <> 'CONTAINS'), own AS (SELECT nodes.*, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees ON q = qualified_name)
  SELECT p.kind, source, target, round(CASE WHEN s.community_id <> t.community_id THEN 0.3 ELSE 0 END + CASE WHEN regexp_extract(s.file_path, '\\.([^./]+)$', 1) <> regexp_extract(t.file_path, '\\.([^./]+)$', 1) THEN 0.2 ELSE 0 END
   + CASE WHEN (s.degree <= 2 AND t.degree >= greatest(3 * m, 10)) OR (t.degree <= 2 AND s.degree >= greatest(3 * m, 10)) THEN 0.2 ELSE 0 END + CASE WHEN s.is_test <> t.is_test THEN 0.15 ELSE 0 END
   + CASE WHEN p.kind = 'CALLS' AND (s.kind = 'Type' OR t.kind = 'Type') THEN 0.15 ELSE 0 END, 2)::DOUBLE AS score
  FROM pairs p JOIN own s ON s.qualified_name = source JOIN own t ON t.qualified_name = target, med WHERE score > 0""")
def surprising_connections(spark, sf_dir):
    return analytics.surprising_connections(graph(spark, sf_dir), None).select("kind", "source", "target", "score")


@query(f"""{GRAPH}, e AS (SELECT s.community_id sc, t.community_id tc FROM edges LEFT JOIN nodes s ON s.qualified_name = source LEFT JOIN nodes t ON t.qualified_name = target),
  touched AS (SELECT sc AS c, coalesce(sc = tc, FALSE) AS inside FROM e WHERE sc IS NOT NULL UNION ALL SELECT tc, FALSE FROM e WHERE tc IS NOT NULL AND sc IS DISTINCT FROM tc),
  sums AS (SELECT c, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS external FROM touched GROUP BY c)
  SELECT community_id, count(*) AS n, any_value(internal) AS internal, any_value(external) AS external, round(any_value(internal) / (any_value(internal) + any_value(external)), 4) AS cohesion FROM nodes JOIN sums ON c = community_id GROUP BY community_id""")
def cohesion(spark, sf_dir):
    return analytics.cohesion(graph(spark, sf_dir))


CROSS = "crossing AS (SELECT least(s.community_id, t.community_id) a, greatest(s.community_id, t.community_id) b, e.kind FROM edges e JOIN nodes s ON s.qualified_name = source JOIN nodes t ON t.qualified_name = target WHERE e.kind <> 'TESTED_BY' AND s.community_id <> t.community_id)"


@query(f"{GRAPH}, {CROSS} SELECT a, b, count(*) AS n, count(*) > 10 AS warning FROM crossing GROUP BY a, b")
def cross_community_pairs(spark, sf_dir):
    return analytics.architecture_overview(graph(spark, sf_dir))


@query(f"{GRAPH}, {CROSS}, k AS (SELECT a, b, kind, count(*) n, row_number() OVER (PARTITION BY a, b ORDER BY count(*) DESC, kind) r FROM crossing GROUP BY a, b, kind) SELECT a, b, string_agg(kind || ':' || n, ',' ORDER BY r) AS kinds FROM k WHERE r <= 3 GROUP BY a, b")
def top_kinds_of_pairs(spark, sf_dir):
    return analytics.top_kinds_of_pairs(graph(spark, sf_dir)).select("a", "b", F.array_join(F.transform("kinds", lambda k: F.concat_ws(":", k["kind"], k["n"])), ",").alias("kinds"))


@query(f"{GRAPH} SELECT s.community_id AS sc, t.community_id AS tc, count(*) AS weight FROM edges JOIN nodes s ON s.qualified_name = source JOIN nodes t ON t.qualified_name = target WHERE s.community_id <> t.community_id GROUP BY s.community_id, t.community_id")
def community_supergraph(spark, sf_dir):
    return analytics.community_supergraph(graph(spark, sf_dir))[1]


@query(f"{GRAPH} SELECT s.file_path AS sf, t.file_path AS tf, count(*) AS weight FROM edges JOIN nodes s ON s.qualified_name = source JOIN nodes t ON t.qualified_name = target WHERE s.file_path <> t.file_path GROUP BY s.file_path, t.file_path")
def file_supergraph(spark, sf_dir):
    return analytics.file_supergraph(graph(spark, sf_dir))[1]


@query(f"{GRAPH} SELECT file_path, count(*) FILTER (kind <> 'File') AS symbols FROM nodes GROUP BY file_path")
def file_nodes(spark, sf_dir):
    return analytics.file_supergraph(graph(spark, sf_dir))[0].select("file_path", "symbols")


@query(None)
def suggested_questions(spark, sf_dir):
    return analytics.suggested_questions(graph(spark, sf_dir))


# Communities


@query(f"{GRAPH} SELECT regexp_replace(file_path, '/[^/]*$', '') AS grouping, count(*) AS n FROM nodes WHERE kind <> 'File' GROUP BY 1 HAVING count(*) >= 2")
def directory_groups(spark, sf_dir):
    return communities.directory_groups(graph(spark, sf_dir), 1)


@query(f"""{GRAPH} SELECT least(source, target) AS u, greatest(source, target) AS v, max(CASE kind WHEN 'CALLS' THEN 1.0::DOUBLE WHEN 'DEPENDS_ON' THEN 0.6::DOUBLE WHEN 'TESTED_BY' THEN 0.4::DOUBLE WHEN 'CONTAINS' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM edges WHERE source <> target GROUP BY 1, 2""")
def undirected_weights(spark, sf_dir):
    return communities.undirected_weights(graph(spark, sf_dir))


@query(f"""{GRAPH}, votes AS (SELECT e.target q, s.community_id c, count(DISTINCT e.source) n FROM edges e JOIN nodes s ON s.qualified_name = e.source WHERE e.kind = 'TESTED_BY' GROUP BY 1, 2),
  r AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY n DESC, CASE WHEN c = t.community_id THEN 0 ELSE 1 END, c) r FROM votes JOIN nodes t ON t.qualified_name = q WHERE t.is_test) SELECT q AS qualified_name, c AS community_id FROM r WHERE r = 1""")
def reassigned_tests(spark, sf_dir):
    return communities.reassign_tests(graph(spark, sf_dir))


@query(f"{GRAPH} SELECT community_id, count(*) AS n FROM nodes GROUP BY community_id HAVING count(*) > greatest((SELECT count(*) FROM nodes) * 0.12, 10)")
def oversized_communities(spark, sf_dir):
    return communities.oversized(graph(spark, sf_dir), 0.12)


@query(None)
def label_propagation(spark, sf_dir):
    return communities.label_propagation(graph(spark, sf_dir), 4)


@query(None)
def community_names(spark, sf_dir):
    return communities.communities(graph(spark, sf_dir))


# Flows on the chains of turns

ENTRIES = "entries AS (SELECT n.qualified_name e FROM nodes n WHERE n.kind = 'Function' AND (NOT EXISTS (SELECT 1 FROM edges c WHERE c.kind = 'CALLS' AND c.target = n.qualified_name) OR regexp_matches(n.name, '^(main|__main__|handler|handle|lambda_handler|upgrade|downgrade|lifespan|get_db|log_message)$|^(test_|Test[A-Z]|on_|handle_|on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive))')))"
CALLED = "calls AS (SELECT DISTINCT source s, target t FROM edges WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM nodes))"
STEPS = f"steps AS (WITH RECURSIVE w AS (SELECT e AS entry, e AS node, 0 AS depth FROM entries UNION ALL SELECT entry, t, depth + 1 FROM w JOIN calls ON s = node WHERE depth < 15) SELECT * FROM w), long AS (SELECT * FROM steps WHERE entry IN (SELECT entry FROM steps WHERE depth > 0))"
SECURE = "'auth|login|password|token|session|crypt|secret|credential|permission|sql|query|execute|connect|socket|request|http|sanitize|validate|encrypt|decrypt|hash|sign|verify|admin|privilege'"


@query(f"{CHAIN}, {ENTRIES} SELECT e AS qualified_name FROM entries")
def entry_points(spark, sf_dir):
    return flows.entry_points(chain(spark, sf_dir)).select("qualified_name")


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS} SELECT entry, node, depth FROM long")
def flow_members(spark, sf_dir):
    return flows.trace_flows(chain(spark, sf_dir)).select("entry", "node", "depth")


CRITICALITY = f"""sums AS (SELECT entry, max(depth) AS depth, count(*) AS node_count, count(DISTINCT n.file_path) AS file_count,
   sum((SELECT count(*) FROM edges c WHERE c.kind = 'CALLS' AND c.source = node AND c.target NOT IN (SELECT qualified_name FROM nodes))) AS outside,
   sum(CASE WHEN regexp_matches(lower(n.name || ' ' || node), {SECURE}) THEN 1 ELSE 0 END) AS secure,
   sum(CASE WHEN EXISTS (SELECT 1 FROM edges c WHERE c.kind = 'TESTED_BY' AND c.source = node) THEN 1 ELSE 0 END) AS tested FROM long JOIN nodes n ON n.qualified_name = node GROUP BY entry),
  scored AS (SELECT entry, depth, node_count, file_count, round(0.3::DOUBLE * least((file_count - 1) / 4, 1) + 0.2::DOUBLE * least(outside / 5, 1) + 0.25::DOUBLE * (secure / node_count) + 0.15::DOUBLE * (1 - tested / node_count) + 0.1::DOUBLE * least(depth / 10, 1), 4) AS criticality FROM sums)"""


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, {CRITICALITY} SELECT entry, depth, node_count, file_count, criticality FROM scored")
def flow_criticality(spark, sf_dir):
    g = chain(spark, sf_dir)
    return flows.criticality(g, flows.trace_flows(g))


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, {CRITICALITY} SELECT entry, criticality FROM scored WHERE entry IN (SELECT entry FROM long JOIN nodes n ON n.qualified_name = node WHERE n.file_path IN ('conv/1/0', 'conv/2/1'))")
def affected_flows(spark, sf_dir):
    g = chain(spark, sf_dir)
    return flows.affected_flows(g, flows.trace_flows(g), ["conv/1/0", "conv/2/1"]).select("entry", "criticality")


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS} SELECT entry, string_agg(node, '>' ORDER BY depth) AS path FROM long GROUP BY entry")
def flow_paths(spark, sf_dir):
    g = chain(spark, sf_dir)
    return flows.flow_rows(g, flows.trace_flows(g)).select("entry", F.array_join("path", ">").alias("path"))


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, p AS (SELECT entry, list(node ORDER BY depth) AS path FROM long GROUP BY entry) SELECT entry, array_to_string(list_concat(path[1:4], CASE WHEN len(path) > 4 THEN [path[len(path)]] ELSE [] END), '>') AS critical_path FROM p")
def flow_snapshots(spark, sf_dir):
    g = chain(spark, sf_dir)
    return summaries.flow_snapshots(flows.flow_rows(g, flows.trace_flows(g))).select("entry", F.array_join("critical_path", ">").alias("critical_path"))


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS} SELECT entry, node, depth FROM long")
def flow_retrace(spark, sf_dir):
    """Flows traced with one file's calls missing, then brought up to date by that file: equal to a full trace."""
    g = chain(spark, sf_dir)
    before = flows.trace_flows(g.with_tables(edges=g.edges.where("file_path <> 'conv/3/0'")))
    return flows.retrace(g, before, ["conv/3/0", "conv/3/1"]).select("entry", "node", "depth")


@query(f"""{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, {CRITICALITY}, r AS (SELECT entry, node_count, coalesce(sum(node_count) OVER (ORDER BY criticality DESC, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scored)
  SELECT entry, CAST(node_count - least(node_count, greatest(0, 60 - before)) AS BIGINT) AS steps_omitted FROM (SELECT * FROM r ORDER BY before, entry LIMIT 60) AS x""")
def flow_budget(spark, sf_dir):
    g = chain(spark, sf_dir)
    return flows.within_steps(flows.flow_rows(g, flows.trace_flows(g)), 60).select("entry", F.col("steps_omitted").cast("long").alias("steps_omitted"))


# Changes

RANGES = "ranges AS (SELECT concat('part/', p_brand) AS f, CAST(p_partkey % 1000 AS BIGINT) AS a, CAST(p_partkey % 1000 + 3 AS BIGINT) AS b FROM part WHERE p_partkey % 50 = 0)"
HIT = "hit AS (SELECT * FROM nodes n WHERE n.kind <> 'File' AND EXISTS (SELECT 1 FROM ranges WHERE f = n.file_path AND n.line_start <= b AND n.line_end >= a))"


def ranges(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    return part.select(F.concat(F.lit("part/"), "p_brand").alias("file_path"), (F.col("p_partkey") % 1000).alias("line_start"), (F.col("p_partkey") % 1000 + 3).alias("line_end"))


@query(f"{GRAPH}, {RANGES}, {HIT} SELECT qualified_name FROM hit")
def changed_nodes_overlap(spark, sf_dir):
    return changes.changed_nodes(graph(spark, sf_dir), ranges(spark, sf_dir)).where("kind <> 'File'").select("qualified_name")


@query(f"{GRAPH}, {RANGES}, c AS (SELECT DISTINCT f, a AS line FROM ranges), r AS (SELECT line, n.*, row_number() OVER (PARTITION BY f, line ORDER BY line_end - line_start, qualified_name) r FROM nodes n JOIN c ON f = file_path AND line BETWEEN line_start AND line_end) SELECT file_path, line, qualified_name FROM r WHERE r = 1")
def node_at_cursor(spark, sf_dir):
    cursors = ranges(spark, sf_dir).select("file_path", F.col("line_start").alias("line")).distinct()
    return changes.node_at(graph(spark, sf_dir), cursors).select("file_path", "line", "qualified_name")


@query("""WITH r AS (SELECT concat('part/', p_brand) f, CAST(p_partkey % 1000 AS BIGINT) a, CAST(p_partkey % 1000 + p_size AS BIGINT) b FROM part WHERE p_partkey % 20 = 0),
  m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY f ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
  i AS (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT f AS file_path, min(a) AS line_start, max(b) AS line_end FROM i GROUP BY f, island""")
def merged_ranges(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").where("p_partkey % 20 = 0")
    own = part.select(F.concat(F.lit("part/"), "p_brand").alias("file_path"), (F.col("p_partkey") % 1000).alias("line_start"), (F.col("p_partkey") % 1000 + F.col("p_size")).alias("line_end"))
    return changes.merged_ranges(own)


# The same over all rows of part: the queries above take the rows that their SQL takes

ALL_RANGES = "ranges AS (SELECT concat('part/', p_brand) AS f, CAST(p_partkey % 1000 AS BIGINT) AS a, CAST(p_partkey % 1000 + 3 AS BIGINT) AS b FROM part)"


def all_ranges(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("part/"), "p_brand").alias("file_path"), (F.col("p_partkey") % 1000).alias("line_start"), (F.col("p_partkey") % 1000 + 3).alias("line_end"))


@query(f"{GRAPH}, {ALL_RANGES}, {HIT} SELECT qualified_name FROM hit")
def changed_nodes_overlap_all(spark, sf_dir):
    return changes.changed_nodes(graph(spark, sf_dir), all_ranges(spark, sf_dir)).where("kind <> 'File'").select("qualified_name")


@query(f"{GRAPH}, {ALL_RANGES}, c AS (SELECT DISTINCT f, a AS line FROM ranges), r AS (SELECT line, n.*, row_number() OVER (PARTITION BY f, line ORDER BY line_end - line_start, qualified_name) r FROM nodes n JOIN c ON f = file_path AND line BETWEEN line_start AND line_end) SELECT file_path, line, qualified_name FROM r WHERE r = 1")
def node_at_cursor_all(spark, sf_dir):
    cursors = all_ranges(spark, sf_dir).select("file_path", F.col("line_start").alias("line")).distinct()
    return changes.node_at(graph(spark, sf_dir), cursors).select("file_path", "line", "qualified_name")


@query("""WITH r AS (SELECT concat('part/', p_brand) f, CAST(p_partkey % 1000 AS BIGINT) a, CAST(p_partkey % 1000 + p_size AS BIGINT) b FROM part),
  m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY f ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
  i AS (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT f AS file_path, min(a) AS line_start, max(b) AS line_end FROM i GROUP BY f, island""")
def merged_ranges_all(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part")
    own = part.select(F.concat(F.lit("part/"), "p_brand").alias("file_path"), (F.col("p_partkey") % 1000).alias("line_start"), (F.col("p_partkey") % 1000 + F.col("p_size")).alias("line_end"))
    return changes.merged_ranges(own)


RISK = f"""calls AS (SELECT target q, count(*) n FROM edges WHERE kind = 'CALLS' GROUP BY 1),
  own AS (SELECT qualified_name o, qualified_name q FROM picked UNION SELECT p.qualified_name, e.target FROM picked p JOIN edges e ON e.source = p.qualified_name AND e.kind = 'CONTAINS' WHERE p.kind = 'Class'),
  callees AS (SELECT o, t AS q FROM (SELECT o, t, row_number() OVER (PARTITION BY o ORDER BY t) r FROM (SELECT DISTINCT o, e.target t FROM own JOIN edges e ON e.source = q AND e.kind = 'CALLS' WHERE e.target IN (SELECT qualified_name FROM nodes) AND (o, e.target) NOT IN (SELECT o, q FROM own)) AS d) AS x WHERE r <= 50),
  tests AS (SELECT o AS q, count(DISTINCT e.target) n FROM (SELECT * FROM own UNION SELECT * FROM callees) AS r JOIN edges e ON e.source = r.q AND e.kind = 'TESTED_BY' WHERE e.target IN (SELECT qualified_name FROM nodes) GROUP BY 1),
  crossing AS (SELECT t.qualified_name q, count(DISTINCT e.source) n FROM edges e JOIN nodes s ON s.qualified_name = e.source JOIN nodes t ON t.qualified_name = e.target WHERE e.kind = 'CALLS' AND s.community_id <> t.community_id GROUP BY 1),
  risks AS (SELECT h.qualified_name, round(least(coalesce(x.n, 0) * 0.05::DOUBLE, 0.15::DOUBLE) + (0.3::DOUBLE - least(coalesce(t.n, 0) / 5, 1) * 0.25::DOUBLE) + CASE WHEN regexp_matches(lower(h.name || ' ' || h.qualified_name), {SECURE}) THEN 0.2::DOUBLE ELSE 0 END + least(coalesce(c.n, 0) / 20, 0.1::DOUBLE), 4) AS risk_score FROM picked h LEFT JOIN calls c ON c.q = h.qualified_name LEFT JOIN tests t ON t.q = h.qualified_name LEFT JOIN crossing x ON x.q = h.qualified_name)"""


@query(f"{GRAPH}, picked AS (SELECT * FROM nodes WHERE kind <> 'File'), {RISK} SELECT qualified_name, risk_score FROM risks")
def node_risk(spark, sf_dir):
    g = graph(spark, sf_dir)
    return changes.risk(g, g.nodes.where("kind <> 'File'"), many=True).select("qualified_name", "risk_score")


@query(f"{GRAPH}, {RANGES}, {HIT}, picked AS (SELECT * FROM hit), {RISK} SELECT qualified_name, risk_score FROM risks ORDER BY risk_score DESC, qualified_name LIMIT 10")
def review_priorities(spark, sf_dir):
    return changes.analyze(graph(spark, sf_dir), ranges(spark, sf_dir))["priorities"].select("qualified_name", "risk_score")


@query(f"{GRAPH}, {ALL_RANGES}, {HIT}, picked AS (SELECT * FROM hit), {RISK} SELECT qualified_name, risk_score FROM risks ORDER BY risk_score DESC, qualified_name LIMIT 10")
def review_priorities_all(spark, sf_dir):
    return changes.analyze(graph(spark, sf_dir), all_ranges(spark, sf_dir))["priorities"].select("qualified_name", "risk_score")


@query(f"{GRAPH} {GAPS}")
def test_gaps(spark, sf_dir):
    g = graph(spark, sf_dir)
    return changes.test_gaps(g, g.nodes).select("qualified_name")


@query(f"{GRAPH}, picked AS (SELECT * FROM nodes WHERE kind <> 'File' AND file_path = '{FILE}'), {RISK} SELECT (SELECT max(risk_score) FROM risks) AS risk, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def minimal_context(spark, sf_dir):
    return changes.minimal_context(graph(spark, sf_dir), [FILE]).select("risk", "nodes", "edges")


@query(None)
def review_guidance(spark, sf_dir):
    return changes.review_guidance(graph(spark, sf_dir), [FILE])


@query("SELECT concat('src', e.user_id % 20, '.py') AS path, count(DISTINCT event_id // 10) AS commits FROM events e GROUP BY 1")
def file_churn(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events")
    return changes.parse_numstat(events.select(F.floor(F.col("event_id") / 10).alias("commit"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit(".py")).alias("path")))


# Summaries


@query(f"""{GRAPH}, calls AS (SELECT target q, count(*) n FROM edges WHERE kind = 'CALLS' GROUP BY 1) SELECT h.qualified_name, coalesce(c.n, 0) AS caller_count, h.qualified_name IN (SELECT source FROM edges WHERE kind = 'TESTED_BY') AS tested,
  round(least(CASE WHEN coalesce(c.n, 0) > 10 THEN 0.3 WHEN coalesce(c.n, 0) > 3 THEN 0.15 ELSE 0 END + CASE WHEN h.qualified_name IN (SELECT source FROM edges WHERE kind = 'TESTED_BY') THEN 0 ELSE 0.3 END + CASE WHEN regexp_matches(lower(h.name), 'auth|login|password|token|session|crypt|secret|credential|permission|sql|execute') THEN 0.4 ELSE 0 END, 1), 4)::DOUBLE AS risk
  FROM nodes h LEFT JOIN calls c ON c.q = h.qualified_name WHERE h.kind IN ('Function', 'Class', 'Test')""")
def risk_index(spark, sf_dir):
    return summaries.risk_index(graph(spark, sf_dir))


@query(f"""{GRAPH}, {DEGREES}, m AS (SELECT community_id, name, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(degree, 0) DESC, qualified_name) r FROM nodes LEFT JOIN degrees ON q = qualified_name WHERE kind <> 'File')
  SELECT community_id, count(*) AS size, string_agg(name, ',' ORDER BY r) FILTER (r <= 5) AS key_symbols FROM m GROUP BY community_id""")
def community_summaries(spark, sf_dir):
    return summaries.community_summaries(graph(spark, sf_dir)).select("community_id", "size", "key_symbols")


@query(f"{GRAPH} SELECT qualified_name, left(CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || coalesce(CASE WHEN params LIKE '(%' THEN params ELSE '(' || params || ')' END, '()') || coalesce(' -> ' || return_type, '') WHEN kind = 'Class' THEN 'class ' || name ELSE name END, 512) AS signature FROM nodes")
def signatures(spark, sf_dir):
    return summaries.with_signatures(graph(spark, sf_dir).nodes).select("qualified_name", "signature")


# Snapshots and writes: the later graph lacks nation/3 and has brand parts in other communities


def later(g: Graph) -> Graph:
    nodes = g.nodes.where("file_path <> 'nation/3'").withColumn("community_id", F.when(F.col("community_id") == 6, 7).otherwise(F.col("community_id")))
    return Graph(nodes, g.edges.where("file_path <> 'nation/3'"))


@query(f"{GRAPH} SELECT qualified_name FROM nodes WHERE file_path = 'nation/3'")
def snapshot_removed_nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return summaries.diff_snapshots(summaries.take_snapshot(g), summaries.take_snapshot(later(g)))["removed_nodes"].select("qualified_name")


@query(f"{GRAPH} SELECT DISTINCT concat(source, '->', target, ':', kind) AS edge FROM edges EXCEPT SELECT concat(source, '->', target, ':', kind) FROM edges WHERE file_path <> 'nation/3'")
def snapshot_removed_edges(spark, sf_dir):
    g = graph(spark, sf_dir)
    return summaries.diff_snapshots(summaries.take_snapshot(g), summaries.take_snapshot(later(g)))["removed_edges"]


@query(f"{GRAPH} SELECT qualified_name, 6::BIGINT AS community_before, 7::BIGINT AS community_after FROM nodes WHERE community_id = 6")
def snapshot_moves(spark, sf_dir):
    g = graph(spark, sf_dir)
    return summaries.diff_snapshots(summaries.take_snapshot(g), summaries.take_snapshot(later(g)))["moved"].select("qualified_name", "community_before", F.col("community_after").cast("long").alias("community_after"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (TRUE) IS NOT NULL AS seen FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events")
    old, new = events.limit(0), events
    return store.latest(old, new, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", F.lit(True).alias("seen"))


@query(f"{GRAPH}, gone AS (SELECT qualified_name q FROM nodes WHERE file_path = 'nation/3') SELECT kind, count(*) AS n FROM edges WHERE file_path <> 'nation/3' AND source NOT IN (SELECT q FROM gone) AND target NOT IN (SELECT q FROM gone) GROUP BY kind")
def delete_cascade(spark, sf_dir):
    g = graph(spark, sf_dir)
    left, _ = store.remove_files_permanently(g, g.nodes.where("file_path = 'nation/3'").select("file_path").distinct())
    return analytics.stats_by_edge_kind(left)


@query(f"{GRAPH} SELECT kind, count(*) AS n FROM edges WHERE file_path <> 'nation/3' GROUP BY kind")
def delete_files(spark, sf_dir):
    g = graph(spark, sf_dir)
    return analytics.stats_by_edge_kind(store.remove_files(g, g.nodes.where("file_path = 'nation/3'").select("file_path").distinct()))


# Resolution: names of suppliers as bare call targets, brands as modules

BARE = "bare AS (SELECT DISTINCT c_custkey, concat('nation/', c_nationkey) AS f, s_name AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE (l_linenumber = 1 OR l_linenumber > 3))"


def bare_graph(spark, sf_dir) -> Graph:
    g = graph(spark, sf_dir)
    names = g.nodes.select(F.col("qualified_name").alias("target"), "name")
    calls = g.of_kind("CALLS").join(names, "target").select("kind", "source", F.col("name").alias("target"), "file_path", F.lit(0).cast("long").alias("line")).distinct()
    imports = spark.createDataFrame([("IMPORTS_FROM", f"nation/{i}", f"nation/{(i + 1) % 25}", f"nation/{i}", 0) for i in range(25)], "kind string, source string, target string, file_path string, line long")
    return Graph(g.nodes, calls.unionByName(imports))


@query(f"""{GRAPH}, {BARE}, own AS (SELECT name, qualified_name, CAST(split_part(file_path, '/', 2) AS INT) AS k FROM nodes WHERE kind = 'Class'),
  found AS (SELECT c_custkey, b.f, b.name, list(DISTINCT qualified_name) AS q FROM bare b JOIN own o ON o.name = b.name AND (o.k = CAST(split_part(b.f, '/', 2) AS INT) OR o.k = (CAST(split_part(b.f, '/', 2) AS INT) + 1) % 25) GROUP BY ALL)
  SELECT concat(f, '::C', c_custkey) AS source, q[1] AS target FROM found WHERE len(q) = 1""")
def bare_resolution(spark, sf_dir):
    return resolve.resolve_bare_calls(bare_graph(spark, sf_dir)).where("kind = 'CALLS' AND target LIKE '%::%'").select("source", "target")


@query("""WITH files AS (SELECT concat('pkg', p_partkey % 7, '/', replace(lower(p_brand), '#', ''), '/m', p_partkey, '.py') AS f, p_partkey FROM part), parts AS (SELECT f, string_split(regexp_replace(f, '\\.py$', ''), '/') AS p FROM files)
  SELECT array_to_string(p[i:], '.') AS module, count(*) AS n, min(f) AS first FROM parts, (SELECT unnest([1, 2, 3]) AS i) AS k GROUP BY 1""")
def suffix_imports(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part")
    files = part.select(F.concat(F.lit("pkg"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"))
    return resolve.suffix_index(files).groupBy("module").agg(F.count("*").alias("n"), F.min("file_path").alias("first"))


@query(f"{GRAPH} SELECT source, target, target AS target_node FROM edges WHERE kind = 'DEPENDS_ON'")
def linked_targets(spark, sf_dir):
    g = graph(spark, sf_dir)
    return resolve.link_targets(g.with_tables(edges=g.of_kind("DEPENDS_ON"))).select("source", "target", "target_node")


@query("""WITH w AS (SELECT concat('Brand#', k) AS path FROM (SELECT unnest([1, 2, 3, 4]) AS k) AS x) SELECT path, concat('part/', path) AS file_path FROM w WHERE path IN (SELECT p_brand FROM part)""")
def graph_paths(spark, sf_dir):
    return resolve.graph_paths(graph(spark, sf_dir), spark.createDataFrame([(f"Brand#{k}",) for k in range(1, 5)], "path string"))


# Search


@query(f"{GRAPH} SELECT qualified_name, CASE WHEN lower(name) = 'brand#1' THEN 3.0 WHEN lower(name) LIKE 'brand#1%' THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM nodes WHERE lower(name) LIKE '%brand#1%' OR lower(qualified_name) LIKE '%brand#1%'")
def keyword_search(spark, sf_dir):
    return search.keyword_search(graph(spark, sf_dir), "Brand#1", None)


WORDS = "post AS (SELECT doc_id, t.term, t.pos FROM documents, LATERAL (SELECT unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w) AS y) AS t)"


def postings(spark, sf_dir):
    return search.index(tables.read(spark, sf_dir, "documents"), ("text",), "doc_id", stemmed=False)


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, count(*) n FROM post GROUP BY 1), tf AS (SELECT doc_id, term, count(*) tf FROM post WHERE term IN ('thing', 'onble') GROUP BY 1, 2), df AS (SELECT term, count(*) df FROM tf GROUP BY 1)
  SELECT doc_id AS doc, round(sum(ln(1 + ((SELECT count(*) FROM l) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(n) FROM l)))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) GROUP BY 1""")
def bm25_terms(spark, sf_dir):
    return search.bm25(postings(spark, sf_dir), ["thing", "onble"]).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH {WORDS} SELECT DISTINCT a.doc_id AS doc FROM post a JOIN post b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def phrase_match(spark, sf_dir):
    return search.phrase(postings(spark, sf_dir), ["of", "the"])


COSINE = "(SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt((SELECT list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) FROM embeddings WHERE vec_id = 1))), 9) AS score FROM embeddings)"


def vectors(spark, sf_dir):
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return v, v.where("vec_id = 1").first().vector


@query(f"SELECT vec_id, score FROM {COSINE} AS c ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    v, q = vectors(spark, sf_dir)
    return search.vector_search(v, "vec_id", q, 20).select("vec_id", F.round("score", 9).alias("score"))


@query(f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) r FROM {COSINE} AS c ORDER BY r LIMIT 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) r FROM embeddings ORDER BY r LIMIT 20)
  SELECT vec_id, round(sum(1 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) AS u GROUP BY vec_id""")
def rrf_fusion(spark, sf_dir):
    v, q = vectors(spark, sf_dir)
    by_label = tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    return search.rrf(search.vector_search(v, "vec_id", q, 20), by_label, key="vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query("""WITH h AS (SELECT doc_id, source, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM documents) , r AS (SELECT source AS repo, doc_id, hits, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS rank FROM h WHERE source IN ('src1', 'src2') AND hits > 0)
  SELECT repo, rank, doc_id FROM r ORDER BY rank, repo LIMIT 20""")
def cross_repo_merge(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    parts = [(s, search.term_rank(docs.where(F.col("source") == s), "doc_id", F.col("text"), ["the"], None).withColumnRenamed("hits", "score")) for s in ("src1", "src2")]
    return search.cross_repo(parts, "doc_id", 20).select("repo", "rank", "doc_id")


@query("SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'der', ''))) // 3 AS hits FROM documents WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 10")
def term_rank(spark, sf_dir):
    return search.term_rank(tables.read(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["the", "der"], 10)


@query(None)
def hybrid_search(spark, sf_dir):
    g = graph(spark, sf_dir)
    return search.hybrid_search(g, search.index(g.nodes, ("name", "qualified_name"), "qualified_name"), "Brand 2").select("qualified_name", F.round("score", 8).alias("score"))


@query(f"{GRAPH}, hits AS (SELECT qualified_name q FROM nodes WHERE file_path = 'nation/2' AND kind = 'Class'), c AS (SELECT target q, source o, row_number() OVER (PARTITION BY target ORDER BY source) r FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'CALLS') AS d) SELECT hits.q AS qualified_name, string_agg(o, ',' ORDER BY o) AS callers FROM hits LEFT JOIN c ON c.q = hits.q AND r <= 5 GROUP BY hits.q")
def context_cards(spark, sf_dir):
    g = graph(spark, sf_dir)
    hits = g.nodes.where("file_path = 'nation/2' AND kind = 'Class'").select("qualified_name")
    return search.context_cards(g, hits).select("qualified_name", F.array_join("callers", ",").alias("callers"))


# Refactoring


@query(f"{GRAPH} SELECT n.qualified_name FROM nodes n WHERE n.kind IN ('Function', 'Class') AND NOT n.is_test AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind IN ('CALLS', 'IMPORTS_FROM', 'REFERENCES', 'INHERITS', 'IMPLEMENTS') AND e.target = n.qualified_name) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'TESTED_BY' AND e.source = n.qualified_name) AND NOT (n.kind = 'Class' AND n.name IN (SELECT DISTINCT unnest(regexp_extract_all(concat_ws(' ', params, return_type), '\\b[A-Z]\\w*')) FROM nodes))")
def dead_code(spark, sf_dir):
    return refactor.dead_code(graph(spark, sf_dir)).select("qualified_name")


@query(f"{GRAPH}, c AS (SELECT t.qualified_name q, t.community_id, min(s.community_id) lo, max(s.community_id) hi FROM edges e JOIN nodes s ON s.qualified_name = e.source JOIN nodes t ON t.qualified_name = e.target WHERE e.kind = 'CALLS' AND t.kind IN ('Function', 'Class') GROUP BY 1, 2) SELECT q AS qualified_name, community_id, lo AS target_community FROM c WHERE lo = hi AND lo <> community_id")
def move_suggestions(spark, sf_dir):
    return refactor.move_suggestions(graph(spark, sf_dir))


@query(f"{GRAPH}, own AS (SELECT * FROM nodes WHERE name = (SELECT name FROM nodes WHERE qualified_name LIKE '%::S1')) SELECT file_path, line_start AS line, 'definition' AS why FROM own UNION ALL SELECT file_path, line, 'call' FROM edges WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM own)")
def rename_preview(spark, sf_dir):
    g = graph(spark, sf_dir)
    name = g.nodes.where(F.col("qualified_name") == seed(g, "::S1")).first().name
    return refactor.rename_preview(g, name, "renamed").select("file_path", "line", "why")


# Functions, exports, embeddings, measures


@query(f"{GRAPH} SELECT qualified_name, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[_\\-.\\s]+'), lambda x: x <> '')::VARCHAR AS words FROM nodes WHERE kind <> 'Function'")
def split_names(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.nodes.where("kind <> 'Function'").select("qualified_name", F.concat(F.lit("["), F.array_join(T.split_name(F.col("name")), ", "), F.lit("]")).alias("words"))


@query("SELECT source, sum(CASE WHEN length(text) > 0 THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS tokens, sum(greatest(1, length(text) // 4))::BIGINT AS floor_tokens FROM documents GROUP BY source")
def token_estimates(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.sum(T.floor_tokens(F.col("text"))).alias("floor_tokens"))


@query(f"{GRAPH} SELECT qualified_name, split_part(qualified_name, '::', 1) AS file, list_filter(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/'), lambda s: length(s) >= 4)::VARCHAR AS segments FROM nodes WHERE kind = 'Class'")
def path_functions(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.nodes.where("kind = 'Class'").select("qualified_name", T.file_of(F.col("qualified_name")).alias("file"), F.concat(F.lit("["), F.array_join(T.path_segments(F.col("file_path")), ", "), F.lit("]")).alias("segments"))


@query(f"{GRAPH} SELECT 'CREATE (:' || kind || ' {{qualified_name: ''' || replace(replace(qualified_name, '\\', '\\\\'), '''', '\\''') || ''', name: ''' || replace(replace(name, '\\', '\\\\'), '''', '\\''') || '''}});' AS value FROM nodes WHERE kind = 'File'")
def cypher_export(spark, sf_dir):
    g = graph(spark, sf_dir)
    return exports.cypher_rows(g.with_tables(nodes=g.nodes.where("kind = 'File'"))).where("part = 1").select("value")


@query(None)
def graphml_export(spark, sf_dir):
    return exports.graphml_rows(graph(spark, sf_dir))


@query(None)
def node_embeddings(spark, sf_dir):
    g = graph(spark, sf_dir)
    none = spark.createDataFrame([], "qualified_name string, vector array<float>, text_hash string, provider string")
    return embeddings.embed_nodes(g.nodes, none, embeddings.provider("hashing", dimension=32)).select("qualified_name", "text_hash", "provider")


@query("WITH r AS (SELECT user_id AS query, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) SELECT query, coalesce(1 / min(rank) FILTER (item = 'purchase'), 0)::DOUBLE AS rr FROM r GROUP BY query")
def search_mrr(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events")
    ranked = events.select(F.col("user_id").alias("query"), F.col("event_type").alias("item"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))
    return summaries.reciprocal_rank(ranked, ranked.select("query").distinct().withColumn("item", F.lit("purchase")))


@query(f"{GRAPH}, p AS (SELECT DISTINCT file_path f FROM nodes WHERE community_id = 1), a AS (SELECT DISTINCT file_path f FROM edges WHERE kind = 'CALLS'), n AS (SELECT (SELECT count(*) FROM p) p, (SELECT count(*) FROM a) a, (SELECT count(*) FROM p WHERE f IN (SELECT f FROM a)) tp) SELECT round(tp / p, 4) AS precision, round(tp / a, 4) AS recall, round(2 * tp / (p + a), 4) AS f1 FROM n")
def precision_recall(spark, sf_dir):
    g = graph(spark, sf_dir)
    return summaries.precision_recall(g.nodes.where("community_id = 1"), g.of_kind("CALLS"), "file_path")


# The queries above that take one kind of nodes or an empty old state, over everything


def quoted(c: str) -> str:
    return f"replace(replace({c}, '\\', '\\\\'), '''', '\\''')"


@query(f"""{GRAPH} SELECT 1 AS part, 'CREATE (:' || kind || ' {{qualified_name: ''' || {quoted("qualified_name")} || ''', name: ''' || {quoted("name")} || '''}});' AS value FROM nodes
  UNION ALL SELECT 2, 'MATCH (a {{qualified_name: ''' || {quoted("source")} || '''}}), (b {{qualified_name: ''' || {quoted("target")} || '''}}) CREATE (a)-[:' || kind || ']->(b);' FROM edges""")
def cypher_export_all(spark, sf_dir):
    return exports.cypher_rows(graph(spark, sf_dir)).select("part", "value")


@query(f"{GRAPH} SELECT qualified_name, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[_\\-.\\s]+'), lambda x: x <> '')::VARCHAR AS words FROM nodes")
def split_names_all(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.nodes.select("qualified_name", F.concat(F.lit("["), F.array_join(T.split_name(F.col("name")), ", "), F.lit("]")).alias("words"))


@query(f"{GRAPH} SELECT qualified_name, split_part(qualified_name, '::', 1) AS file, list_filter(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/'), lambda s: length(s) >= 4)::VARCHAR AS segments FROM nodes")
def path_functions_all(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.nodes.select("qualified_name", T.file_of(F.col("qualified_name")).alias("file"), F.concat(F.lit("["), F.array_join(T.path_segments(F.col("file_path")), ", "), F.lit("]")).alias("segments"))


@query("SELECT user_id, arg_max(event_type, (event_id % 2, ts, event_id)) AS event_type, bool_or(event_id % 2 = 0) AS known FROM events GROUP BY user_id")
def upsert_latest_halves(spark, sf_dir):
    """The state of the even events, replaced by that of the odd ones where they have one; known tells who had a state before."""
    events = tables.read(spark, sf_dir, "events")
    order = [F.desc("ts"), F.desc("event_id")]
    old = store.latest(events.limit(0), events.where("event_id % 2 = 0"), ["user_id"], order)
    merged = store.latest(old, events.where("event_id % 2 = 1"), ["user_id"], order)
    return merged.join(old.select("user_id", F.lit(True).alias("known")), "user_id", "left").select("user_id", "event_type", F.coalesce("known", F.lit(False)).alias("known"))


# Reads by key, and writes of whole files


@query(f"{GRAPH} SELECT qualified_name, kind, name FROM nodes WHERE qualified_name = 'nation/7'")
def node_by_name(spark, sf_dir):
    return store.get_node(graph(spark, sf_dir), "nation\\7").select("qualified_name", "kind", "name")


@query(f"{GRAPH} SELECT qualified_name, line_start FROM nodes WHERE file_path = 'nation/7'")
def nodes_of_file(spark, sf_dir):
    return store.nodes_by_file(graph(spark, sf_dir), "nation/7").select("qualified_name", "line_start")


@query(f"{GRAPH} SELECT qualified_name, kind FROM nodes WHERE kind <> 'File'")
def nodes_without_files(spark, sf_dir):
    return store.all_nodes(graph(spark, sf_dir)).select("qualified_name", "kind")


@query(f"{GRAPH} SELECT kind, target, line FROM edges WHERE source = (SELECT qualified_name FROM nodes WHERE qualified_name LIKE '%::C10')")
def edges_of_source(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.edges_by_source(g, seed(g, "::C10")).select("kind", "target", "line")


@query(f"{GRAPH} SELECT kind, source, line FROM edges WHERE target = {S1}")
def edges_of_target(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.edges_by_target(g, seed(g, "::S1")).select("kind", "source", "line")


@query(f"{GRAPH}, own AS (SELECT qualified_name q FROM nodes WHERE kind = 'Class' OR language = 'java') SELECT 'node' AS what, q AS a, '' AS b FROM own UNION ALL SELECT kind, source, target FROM edges WHERE source IN (SELECT q FROM own) AND target IN (SELECT q FROM own)")
def subgraph_rows(spark, sf_dir):
    g = graph(spark, sf_dir)
    part = store.subgraph(g, g.nodes.where("kind = 'Class' OR language = 'java'"))
    return part.nodes.select(F.lit("node").alias("what"), F.col("qualified_name").alias("a"), F.lit("").alias("b")).union(part.edges.select("kind", "source", "target"))


@query(f"{GRAPH} SELECT qualified_name FROM nodes WHERE kind <> 'Class'")
def unsigned_nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return store.nodes_without_signature(g.with_tables(nodes=g.nodes.withColumn("signature", F.when(F.col("kind") == "Class", F.col("name"))))).select("qualified_name")


@query(f"{GRAPH} SELECT (SELECT count(*) > 0 FROM nodes WHERE language = 'java') AS java, (SELECT count(*) > 0 FROM nodes WHERE language = 'cobol') AS cobol")
def languages_present(spark, sf_dir):
    g = graph(spark, sf_dir)
    return spark.range(1).select(F.lit(store.has_nodes(g, "java")).alias("java"), F.lit(store.has_nodes(g, "cobol")).alias("cobol"))


@query(f"{GRAPH} SELECT source, target, source AS ambiguous FROM edges WHERE kind = 'DEPENDS_ON'")
def edges_as_shown(spark, sf_dir):
    edges = graph(spark, sf_dir).of_kind("DEPENDS_ON").withColumn("extra", F.to_json(F.struct(F.array("source").alias("ambiguous_targets"))))
    return store.edge_view(edges).select("source", "target", F.array_join("ambiguous_targets", ",").alias("ambiguous"))


@query(f"{GRAPH} SELECT qualified_name, CASE WHEN kind = 'Class' THEN upper(name) || '!' ELSE name END AS name FROM nodes")
def upserted_nodes(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes
    new = nodes.where("kind = 'Class'").withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return store.upsert_nodes(nodes, new).select("qualified_name", "name")


@query(f"{GRAPH} SELECT DISTINCT kind, source, target, line, CASE WHEN kind = 'CONTAINS' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM edges")
def upserted_edges(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    old = store.lift_confidence(edges.withColumn("extra", F.lit(None).cast("string")))
    new = edges.where("kind = 'CONTAINS'").withColumn("extra", F.lit('{"confidence": 0.5}'))
    return store.upsert_edges(old, new).select("kind", "source", "target", "line", "confidence")


@query(f"{GRAPH} SELECT file_path, count(*) AS n FROM (SELECT file_path FROM nodes WHERE file_path NOT IN ('nation/3', 'nation/4') UNION ALL SELECT file_path FROM nodes WHERE file_path = 'nation/3' AND kind = 'Class') AS x GROUP BY 1")
def replaced_files(spark, sf_dir):
    """Two files stored anew: one with its classes alone, one with nothing."""
    g = graph(spark, sf_dir)
    files = spark.createDataFrame([("nation/3",), ("nation/4",)], "file_path string")
    made = store.store_files(g, files, g.nodes.where("file_path = 'nation/3' AND kind = 'Class'"), g.edges.limit(0))
    return made.nodes.groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey = 3 THEN 'new' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation")
def metadata_rows(spark, sf_dir):
    nation = tables.read(spark, sf_dir, "nation")
    key = nation.where("n_nationkey = 3").first().n_name
    return store.set_metadata(nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")), key, "new")


@query(f"{GRAPH}, gone AS (SELECT qualified_name q FROM nodes WHERE file_path LIKE 'part/%') SELECT kind, count(*) AS n FROM edges WHERE file_path NOT LIKE 'part/%' AND source NOT IN (SELECT q FROM gone) AND target NOT IN (SELECT q FROM gone) GROUP BY kind")
def reconciled_edges(spark, sf_dir):
    g = graph(spark, sf_dir)
    return analytics.stats_by_edge_kind(store.reconcile(g, g.nodes.where("file_path LIKE 'nation/%'").select("file_path").distinct()))


@query(f"{GRAPH} SELECT qualified_name FROM nodes WHERE kind = 'Class'")
def kept_vectors(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes
    vectors_ = nodes.select("qualified_name", "kind").union(nodes.select(F.concat("qualified_name", F.lit("?")), "kind")).where("kind = 'Class'")
    return store.purge_orphans(vectors_, nodes).select("qualified_name")


@query(f"{GRAPH} SELECT qualified_name, CASE WHEN kind = 'Class' THEN line_start END AS community_id FROM nodes")
def stored_communities(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes
    members = nodes.where("kind = 'Class'").select("qualified_name", F.col("line_start").alias("community_id"))
    return communities.store_communities(nodes, members).select("qualified_name", "community_id")


@query(f"{GRAPH} SELECT 'nodes' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind")
def published_graph(spark, sf_dir):
    """The graph written as a version and read again."""
    store.publish(graph(spark, sf_dir), root := shared_folder(spark))
    g = store.load(spark, root)
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(g.nodes, "nodes").union(count(g.edges, "edges"))


@query(f"{GRAPH} SELECT qualified_name FROM nodes WHERE name = 'Brand#1' AND (file_path LIKE '%/part.java' OR qualified_name LIKE '%part.Brand#1' OR parent_name = 'part')")
def java_methods(spark, sf_dir):
    return resolve.java_candidates(graph(spark, sf_dir), "com.acme.part.Brand#1").select("qualified_name")


@query(f"""{GRAPH}, t AS (SELECT DISTINCT p.name, e.target, e.file_path FROM edges e JOIN nodes p ON p.qualified_name = e.source WHERE e.kind = 'TESTED_BY'),
  f AS (SELECT t.name, t.target, t.file_path, count(DISTINCT n.qualified_name) AS n, min(n.qualified_name) AS q FROM t JOIN nodes n ON n.name = t.name AND n.file_path = t.file_path AND n.kind IN ('Function', 'Test', 'Class') GROUP BY ALL)
  SELECT CASE WHEN n = 1 THEN q ELSE name END AS source, target FROM f""")
def tested_names(spark, sf_dir):
    """Tests of bare names: resolved where the file of the edge has one node of that name."""
    g = graph(spark, sf_dir)
    names = g.nodes.select(F.col("qualified_name").alias("source"), "name")
    bare = g.of_kind("TESTED_BY").join(large(names), "source").select("kind", F.col("name").alias("source"), "target", "file_path", "line").distinct()
    return resolve.resolve_bare_tests(Graph(g.nodes, bare)).select("source", "target")


@query("""WITH p AS (SELECT concat('src/', p_brand, '.py') AS f, p_partkey % 1000 + 1 AS s, p_size % 4 AS c FROM part) SELECT f AS file_path, CAST(s AS BIGINT) AS line_start, CAST(CASE WHEN c = 0 THEN s ELSE s + c - 1 END AS BIGINT) AS line_end FROM p""")
def diff_hunks(spark, sf_dir):
    """A hunk for each part, below the header of its brand's file; hunks of one line are written without a count."""
    part = tables.read(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 1000 + 1).alias("s"), (F.col("p_size") % 4).alias("c"))
    at = F.concat(F.lit("@@ -1,2 +"), F.col("s").cast("string"), F.when(F.col("c") == 1, "").otherwise(F.concat(F.lit(","), F.col("c").cast("string"))), F.lit(" @@ def f():"))
    head = part.select("p_brand").distinct().select("p_brand", F.lit(-1).cast("long").alias("k"), F.concat(F.lit("+++ b/src/"), "p_brand", F.lit(".py")).alias("line"))
    lines = head.union(part.select("p_brand", F.col("p_partkey").cast("long"), at))
    return changes.parse_unified_diff(lines.select(F.col("p_brand").alias("diff"), F.col("k").alias("n"), "line")).select("file_path", "line_start", "line_end")


# Flows by their nodes


def stored_flows(spark, sf_dir):
    g = chain(spark, sf_dir)
    return flows.flow_rows(g, flows.trace_flows(g))


NEAR = "conv/1/0::t0"


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS} SELECT DISTINCT entry FROM long WHERE node IN (SELECT qualified_name FROM nodes WHERE file_path IN ('conv/1/0', 'conv/2/1'))")
def flows_of_nodes(spark, sf_dir):
    return flows.flows_of_nodes(stored_flows(spark, sf_dir), chain(spark, sf_dir).nodes.where("file_path IN ('conv/1/0', 'conv/2/1')")).select("entry").distinct()


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, {CRITICALITY} SELECT node AS qualified_name, count(*) AS flows, round(sum(criticality), 4) AS worth FROM (SELECT DISTINCT entry, node FROM long) AS l JOIN scored USING (entry) WHERE node IN (SELECT qualified_name FROM nodes WHERE file_path = 'conv/1/0') GROUP BY node")
def flow_worth_of_nodes(spark, sf_dir):
    found = flows.flows_of_nodes(stored_flows(spark, sf_dir), chain(spark, sf_dir).nodes.where("file_path = 'conv/1/0'"))
    return found.groupBy("qualified_name").agg(F.count("*").alias("flows"), F.round(F.sum("criticality"), 4).alias("worth"))


@query(f"{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, w AS (SELECT min(entry) AS e FROM long) SELECT node AS qualified_name, n.name FROM (SELECT node, min(depth) AS d FROM long WHERE entry = (SELECT e FROM w) GROUP BY node) AS l JOIN nodes n ON n.qualified_name = node")
def one_flow(spark, sf_dir):
    g, listed = chain(spark, sf_dir), stored_flows(spark, sf_dir)
    first = listed.orderBy("entry").first()
    return flows.flow_by_id(g, listed, first.flow_id).select("qualified_name", "name")


# Review


@query(f"""{GRAPH}, {ARCS}, {IMPACT}, g AS ({GAPS} AND n.file_path = '{FILE}'), a AS (SELECT count(*) AS n FROM best b JOIN nodes x ON x.qualified_name = b.q WHERE b.q NOT IN (SELECT q FROM seeds))
  SELECT count(*)::VARCHAR || ' changed functions have no tests' AS message FROM g HAVING count(*) > 0 UNION ALL SELECT n::VARCHAR || ' nodes may be affected' FROM a WHERE n > 20""")
def review_guidance_rows(spark, sf_dir):
    return changes.review_guidance(graph(spark, sf_dir), [FILE])


@query(f"{GRAPH} SELECT count(*) > 0 AS needed FROM nodes WHERE file_path IN ('nation/1', 'nowhere') AND community_id IS NOT NULL")
def detection_needed(spark, sf_dir):
    return spark.range(1).select(F.lit(communities.needs_detection(graph(spark, sf_dir), ["nation/1", "nowhere"])).alias("needed"))


# Measures of whole runs


@query(f"""{GRAPH}, g AS ({GAPS.replace("n.qualified_name FROM", "n.file_path, n.name FROM")}), f AS (SELECT file_path, list(name ORDER BY name) AS l, round(least(count(*) / 20, 1), 2) AS r FROM g GROUP BY file_path),
  w AS (SELECT file_path, 1 AS k, 'Test coverage gaps: ' || array_to_string(l[1:5], ', ') AS warning FROM f UNION ALL SELECT file_path, 2, 'High risk score (' || printf('%.2f', r) || ') — review carefully' FROM f WHERE r > 0.7 UNION ALL SELECT file_path, 3, 'large file' FROM f WHERE len(l) > 8)
  SELECT file_path, string_agg(warning, '; ' ORDER BY k) AS warnings FROM w GROUP BY file_path""")
def result_warnings(spark, sf_dir):
    g = graph(spark, sf_dir)
    tested = g.of_kind("TESTED_BY").select(F.col("source").alias("qualified_name"))
    open_ = g.nodes.where("kind = 'Function' AND NOT is_test").join(tested, "qualified_name", "left_anti")
    files = open_.groupBy("file_path").agg(F.sort_array(F.collect_list("name")).alias("gaps"), F.round(F.least(F.count("*") / 20, F.lit(1.0)), 2).alias("risk"))
    notes = F.when(F.size("gaps") > 8, F.array(F.lit("large file")))
    return files.select("file_path", F.array_join(evaluate.warnings(F.col("gaps"), F.col("risk"), notes), "; ").alias("warnings"))


KNOWN = ["0", "1", "nowhere"]


@query(f"""{CHAIN}, {ENTRIES}, {CALLED}, {STEPS}, d AS (SELECT entry, max(depth) AS depth FROM long GROUP BY entry), k AS (SELECT unnest({KNOWN}) AS name),
  h AS (SELECT count(*) AS n FROM k WHERE EXISTS (SELECT 1 FROM d WHERE contains(entry, name)))
  SELECT 3 AS known_entry_points, n::INTEGER AS detected_entry_points, round(n / 3, 3) AS recall, (SELECT count(*) FROM d) AS detected_flows, (SELECT coalesce(round(avg(depth), 1), 0) FROM d) AS avg_flow_depth, (SELECT coalesce(max(depth), 0) FROM d) AS max_flow_depth FROM h""")
def flow_recall(spark, sf_dir):
    listed = flows.trace_flows(chain(spark, sf_dir)).groupBy("entry").agg(F.max("depth").alias("depth"))
    return evaluate.flow_recall(listed, KNOWN)


@query(f"""{GRAPH}, m AS (SELECT file_path AS task, qualified_name, row_number() OVER (PARTITION BY file_path ORDER BY qualified_name) - 1 AS rank FROM nodes WHERE kind <> 'File'),
  t AS (SELECT DISTINCT file_path AS task FROM nodes), f AS (SELECT task, min(rank) AS rank FROM m WHERE qualified_name LIKE '%1' AND rank < 10 GROUP BY task),
  x AS (SELECT m.* FROM m JOIN f USING (task, rank)), near AS (SELECT DISTINCT x.task, e.target, lower(n.name) AS name FROM x JOIN edges e ON e.kind = 'CALLS' AND e.source = x.qualified_name JOIN nodes n ON n.qualified_name = e.target),
  c AS (SELECT t.task, count(near.target) AS n, count(DISTINCT name) FILTER (name IN ('supplier#000000001', 'supplier#000000002')) AS hit FROM t LEFT JOIN near USING (task) GROUP BY t.task)
  SELECT task, x.rank IS NOT NULL AS anchor_found, coalesce(x.rank, -1)::INTEGER AS anchor_rank, n AS neighbor_count, 2 AS expected_count, hit AS matched_count, round(hit / 2, 3) AS neighbor_recall FROM c LEFT JOIN x USING (task)""")
def multi_hop_recall(spark, sf_dir):
    g = graph(spark, sf_dir)
    inside = g.nodes.where("kind <> 'File'")
    ranked = inside.select(F.col("file_path").alias("task"), "qualified_name", (F.row_number().over(Window.partitionBy("file_path").orderBy("qualified_name")) - 1).alias("rank"))
    asked = g.nodes.select(F.col("file_path").alias("task")).distinct().select("task", F.lit("1").alias("suffix"), F.array(F.lit("Supplier#000000001"), F.lit("SUPPLIER#000000002")).alias("expected"))
    return evaluate.multi_hop_recall(g, asked, ranked.where("rank < 10"), incoming=False)


# Communities by modularity: SQL has no iteration like it; the tests hold it against brute force


@query(None)
def modularity_communities(spark, sf_dir):
    return communities.modularity_communities(graph(spark, sf_dir))
