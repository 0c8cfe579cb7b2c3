"""Table schemas and the fixed policy values of the graph."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(columns: str) -> T.StructType:
    """`name type` pairs, without the session that Spark's own parser needs."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


NODE = _struct(
    "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, "
    "params string, return_type string, modifiers string, is_test boolean, extra string, file_hash string, signature string, community_id long, updated_at timestamp"
)
EDGE = _struct("kind string, source string, target string, file_path string, line long, extra string, confidence double, confidence_tier string, updated_at timestamp")
NODE_KEY, EDGE_KEY = ["qualified_name"], ["kind", "source", "target", "file_path", "line"]
FLOW = _struct("flow_id long, name string, entry string, depth int, node_count long, file_count long, criticality double, path array<string>")

# Impact weights and directions of edge kinds, decay and floor.
IMPACT_WEIGHT = {"CALLS": 1.0, "INHERITS": 0.9, "OVERRIDES": 0.9, "IMPLEMENTS": 0.9, "TESTED_BY": 0.7, "REFERENCES": 0.6, "DEPENDS_ON": 0.6, "IMPORTS_FROM": 0.5, "CONTAINS": 0.3}
IMPACT_DEFAULT_WEIGHT, IMPACT_DECAY, IMPACT_FLOOR = 0.5, 0.6, 0.05
IMPACT_OUTGOING, IMPACT_NONE = ("TESTED_BY",), ("CONTAINS",)
IMPACT_DEPTH, IMPACT_NODES = 2, 500
# Weights for community detection.
COMMUNITY_WEIGHT = {"CALLS": 1.0, "INHERITS": 0.8, "IMPLEMENTS": 0.7, "DEPENDS_ON": 0.6, "IMPORTS_FROM": 0.5, "TESTED_BY": 0.4, "CONTAINS": 0.3}
COMMUNITY_DEFAULT_WEIGHT = 0.5
