"""A property graph as two DataFrames, and what all operators need of a session."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """nodes and edges in the shapes of graphloom.schema (columns that an operator doesn't read may be missing)."""

    nodes: DataFrame
    edges: DataFrame

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def with_tables(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        return replace(self, nodes=self.nodes if nodes is None else nodes, edges=self.edges if edges is None else edges)


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where a local session has none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df written below the checkpoint folder and read again: iterations grow neither lineage nor the plan's estimate of
    sizes, which a checkpoint keeps and each join multiplies."""
    df.write.parquet(path := shared_folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of joins that grows with the graph: merged by its key, never sent whole through the driver, as the plan would
    do by the size of compressed files."""
    return df.hint("merge")


def lookup(values: dict, key: Column, default) -> Column:
    """A small fixed table as an expression, so no join is needed."""
    found = F.lit(default)
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def rounded(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)


