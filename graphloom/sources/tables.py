"""Graphs made of relational tables. The same SQL text runs in Spark and in the DuckDB that checks the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import Graph, shared_folder

NODES = """
SELECT 'File' AS kind, n_name AS name, concat('nation/', n_nationkey) AS qualified_name, concat('nation/', n_nationkey) AS file_path,
       CAST(n_nationkey % 1000 AS BIGINT) AS line_start, CAST(n_nationkey % 1000 AS BIGINT) AS line_end, 'python' AS language,
       CAST(NULL AS STRING) AS parent_name, CAST(NULL AS STRING) AS params, CAST(NULL AS STRING) AS return_type, FALSE AS is_test, CAST(n_nationkey % 5 AS BIGINT) AS community_id
FROM {nation}
UNION ALL
SELECT 'Class', s_name, concat('nation/', s_nationkey, '::S', s_suppkey), concat('nation/', s_nationkey), CAST(s_suppkey % 1000 AS BIGINT),
       CAST(s_suppkey % 1000 + 20 AS BIGINT), 'python', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), FALSE, CAST(s_nationkey % 5 AS BIGINT)
FROM {supplier}
UNION ALL
SELECT 'Function', c_name, concat('nation/', c_nationkey, '::C', c_custkey), concat('nation/', c_nationkey), CAST(c_custkey % 1000 AS BIGINT),
       CAST(c_custkey % 1000 + 5 AS BIGINT), 'python', CAST(NULL AS STRING), concat('(', c_mktsegment, ')'), CAST(NULL AS STRING), c_custkey % 7 = 0, CAST(c_nationkey % 5 AS BIGINT)
FROM {customer}
UNION ALL
SELECT 'Function', p_name, concat('part/', p_brand, '::P', p_partkey), concat('part/', p_brand), CAST(p_partkey % 1000 AS BIGINT),
       CAST(p_partkey % 1000 + p_size AS BIGINT), 'java', CAST(NULL AS STRING), CAST(NULL AS STRING), p_type, FALSE, CAST(5 + p_size % 4 AS BIGINT)
FROM {part}
UNION ALL
SELECT DISTINCT 'File', p_brand, concat('part/', p_brand), concat('part/', p_brand), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'java',
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), FALSE, CAST(5 AS BIGINT)
FROM {part}
"""

EDGES = """
SELECT kind, source, target, split_part(source, '::', 1) AS file_path, line FROM (
SELECT 'CALLS' AS kind, concat('nation/', c_nationkey, '::C', c_custkey) AS source, concat('nation/', s_nationkey, '::S', s_suppkey) AS target, l_orderkey AS line
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
WHERE l_linenumber = 1 OR l_linenumber > 3
UNION ALL
SELECT DISTINCT 'DEPENDS_ON', concat('nation/', s_nationkey, '::S', s_suppkey), concat('part/', p_brand, '::P', p_partkey), CAST(0 AS BIGINT)
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey
WHERE l_linenumber = 2 OR l_linenumber = 3 AND l_returnflag <> 'R'
UNION ALL
SELECT DISTINCT 'TESTED_BY', concat('part/', p_brand, '::P', p_partkey), concat('nation/', c_nationkey, '::C', c_custkey), CAST(0 AS BIGINT)
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
WHERE l_linenumber = 3 AND l_returnflag = 'R'
UNION ALL
SELECT 'CONTAINS', concat('nation/', s_nationkey), concat('nation/', s_nationkey, '::S', s_suppkey), CAST(0 AS BIGINT) FROM {supplier}
UNION ALL
SELECT 'CONTAINS', concat('nation/', c_nationkey), concat('nation/', c_nationkey, '::C', c_custkey), CAST(0 AS BIGINT) FROM {customer}
UNION ALL
SELECT 'CONTAINS', concat('part/', p_brand), concat('part/', p_brand, '::P', p_partkey), CAST(0 AS BIGINT) FROM {part}
) AS made
"""

CHAIN_NODES = """
SELECT 'Function' AS kind, CASE WHEN turn % 3 = 0 THEN concat('handle_token_', conv_id) ELSE concat('step', turn) END AS name,
       concat('conv/', conv_id, '/', turn % 2, '::t', turn) AS qualified_name, concat('conv/', conv_id, '/', turn % 2) AS file_path,
       CAST(turn * 10 AS BIGINT) AS line_start, CAST(turn * 10 + 9 AS BIGINT) AS line_end, 'python' AS language, CAST(NULL AS STRING) AS parent_name,
       CAST(NULL AS STRING) AS params, CAST(NULL AS STRING) AS return_type, FALSE AS is_test, CAST(conv_id % 3 AS BIGINT) AS community_id
FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) AS turns
"""

CHAIN_EDGES = """
SELECT 'CALLS' AS kind, concat('conv/', a.conv_id, '/', a.turn % 2, '::t', a.turn) AS source, concat('conv/', b.conv_id, '/', b.turn % 2, '::t', b.turn) AS target,
       concat('conv/', a.conv_id, '/', a.turn % 2) AS file_path, a.turn AS line
FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) AS a JOIN (SELECT DISTINCT conv_id, turn FROM {conversations}) AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
UNION ALL
SELECT 'CALLS', concat('conv/', conv_id, '/', turn % 2, '::t', turn), 'print', concat('conv/', conv_id, '/', turn % 2), turn
FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) AS t WHERE turn % 4 = 1
UNION ALL
SELECT 'TESTED_BY', concat('conv/', conv_id, '/', turn % 2, '::t', turn), concat('tests/', conv_id, '::test_t', turn), concat('conv/', conv_id, '/', turn % 2), turn
FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) AS t WHERE turn % 5 = 2
"""

RICH_NODES = NODES + """
UNION ALL
SELECT DISTINCT 'Event', event_type, concat('event/', event_type), concat('event/', event_type), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'python',
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), FALSE, CAST(NULL AS BIGINT)
FROM {events}
UNION ALL
SELECT 'Endpoint', r_name, concat('api/', r_regionkey, '::', r_name), concat('api/', r_regionkey), CAST(1 AS BIGINT), CAST(2 AS BIGINT), 'python',
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), FALSE, CAST(NULL AS BIGINT)
FROM {region}
"""

RICH_EDGES = """
SELECT kind, source, target, split_part(source, '::', 1) AS file_path, line FROM (
SELECT 'IMPORTS_FROM' AS kind, concat('nation/', n_nationkey) AS source, concat('nation/', (n_nationkey * 3 + 1) % 25) AS target, CAST(1 AS BIGINT) AS line FROM {nation}
UNION ALL
SELECT 'INHERITS', concat('nation/', a.s_nationkey, '::S', a.s_suppkey), concat('nation/', b.s_nationkey, '::S', b.s_suppkey), CAST(2 AS BIGINT)
FROM {supplier} AS a JOIN {supplier} AS b ON b.s_suppkey = a.s_suppkey % 10 WHERE a.s_suppkey > 10
UNION ALL
SELECT 'REFERENCES', concat('nation/', c_nationkey, '::C', c_custkey), concat('nation/', s_nationkey, '::S', s_suppkey), CAST(3 AS BIGINT)
FROM {customer} JOIN {supplier} ON s_suppkey = c_custkey % 10
UNION ALL
SELECT 'CALLS', concat('nation/', c_nationkey, '::C', c_custkey), s_name, CAST(4 AS BIGINT) FROM {customer} JOIN {supplier} ON s_suppkey = c_custkey % 10
UNION ALL
SELECT DISTINCT 'PUBLISHES', concat('nation/', c_nationkey, '::C', c_custkey), concat('event/', event_type), CAST(5 AS BIGINT) FROM {events} JOIN {customer} ON c_custkey = user_id
UNION ALL
SELECT 'HANDLES', concat('nation/', s_nationkey, '::S', s_suppkey), concat('event/', event_type), CAST(6 AS BIGINT)
FROM {supplier} JOIN (SELECT DISTINCT event_type FROM {events}) AS t ON length(event_type) % 4 = s_suppkey % 4
UNION ALL
SELECT 'HANDLES', concat('nation/', s_nationkey, '::S', s_suppkey), concat('api/', r_regionkey, '::', r_name), CAST(7 AS BIGINT) FROM {supplier} JOIN {region} ON r_regionkey = s_suppkey % 5
UNION ALL
SELECT 'TRIGGERS', concat('nation/', s_nationkey, '::S', s_suppkey), concat('nation/', c_nationkey, '::C', c_custkey), CAST(8 AS BIGINT) FROM {supplier} JOIN {customer} ON c_custkey % 10 = s_suppkey
UNION ALL
SELECT 'DEPENDS_ON_CONFIG', concat('nation/', s_nationkey, '::S', s_suppkey), CASE s_suppkey % 3 WHEN 0 THEN 'config:app.db.url' WHEN 1 THEN 'config:app.db.*' ELSE 'config:app.cache.size' END, CAST(9 AS BIGINT) FROM {supplier}
) AS made
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL with the tables in braces."""
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


#: Where each session's graphs are stored, by application, tables and name.
_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, nodes: str, edges: str) -> Graph:
    """A graph that is made once a session and read from the shared folder by all its queries, with the edges of a kind
    in a folder of their own, so that operators on one kind read that alone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = shared_folder(spark)
        run(spark, sf_dir, nodes).write.parquet(f"{path}/nodes")
        run(spark, sf_dir, edges).write.partitionBy("kind").parquet(f"{path}/edges")
        _STORED[key] = path
    return Graph(spark.read.parquet(f"{_STORED[key]}/nodes"), spark.read.parquet(f"{_STORED[key]}/edges").select("kind", "source", "target", "file_path", "line"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and brands as files, suppliers as classes, customers and parts as functions; lines of orders as edges."""
    return stored(spark, sf_dir, "graph", NODES, EDGES)


def rich_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The same nodes with events and endpoints, and the kinds of edges that the first graph lacks."""
    return stored(spark, sf_dir, "rich", RICH_NODES, RICH_EDGES)


def chain_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations as functions that call the next turn."""
    return stored(spark, sf_dir, "chain", CHAIN_NODES, CHAIN_EDGES)


def plain(sql: str) -> str:
    """The same SQL for an engine where the tables have their own names."""
    return sql.format(**{t: t for t in TABLES})
