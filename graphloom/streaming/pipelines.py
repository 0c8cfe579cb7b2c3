"""Structured Streaming: batches of file events kept in step with a graph, and state by session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.graph import Graph
from graphloom.operators import store

#: Tool names of an intent (fixed values).
INTENTS = {"review": ("detect_changes", "get_review_context", "get_impact_radius"), "debug": ("query_graph", "semantic_search", "traverse_graph"), "explore": ("list_communities", "get_architecture_overview", "list_flows"), "refactor": ("refactor", "apply_refactor", "find_large_functions")}


def debounce(events: DataFrame, key: str = "path", gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, first, last, n): events of a key less than a gap apart become one, when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 seconds") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(changes: DataFrame, state_root: str, keys: list[str], order: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch merged into the newest version below state_root, which CURRENT names; a batch that comes again finds
    its version there and is skipped, so the result is that of one batch over all changes."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = current_version(spark, state_root)
        if done is not None and done >= number:
            return
        new = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        old = spark.read.parquet(f"{state_root}/v={done}") if done is not None else new.limit(0)
        store.latest(old, new, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{state_root}/v={number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").json(f"{state_root}/CURRENT")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_version(spark: SparkSession, state_root: str) -> int | None:
    try:
        return spark.read.schema("version long").json(f"{state_root}/CURRENT").agg(F.max("version")).first()[0]
    except Exception as e:  # the folder comes with the first batch
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def watch_graph(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """File events in batches of a second: apply gets the distinct paths of each; a failure ends the query."""
    return events.writeStream.foreachBatch(lambda b, n: apply(b.select("path").distinct(), n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def incremental_update(graph: Graph, changed: DataFrame, parse: Callable[[DataFrame], Graph], hashes: DataFrame) -> Graph:
    """graph after changed(path, content, sha): files with a known sha are skipped, the others replaced; an empty
    content means that the file is gone. Equal to a build of all files."""
    fresh = changed.join(hashes.select("path", "sha"), ["path", "sha"], "left_anti")
    gone, kept = fresh.where("content IS NULL"), fresh.where("content IS NOT NULL")
    left, _ = store.remove_files_permanently(graph, gone.select(F.col("path").alias("file_path")))
    new = parse(kept)
    return store.store_files(left, kept.select(F.col("path").alias("file_path")), new.nodes, new.edges)


SESSION = "session string, calls long, last_tools array<string>, intent string"


def session_state(events: DataFrame, keep: int = 10) -> DataFrame:
    """events(session, tool, ts) to the number of calls, the last tools and the intent of each session, as it changes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, tools = state.get if state.exists else (0, [])
        seen = pd.concat(list(batches)).sort_values(["ts", "tool"])
        calls, tools = calls + len(seen), [*tools, *seen["tool"].tolist()][-keep:]
        state.update((calls, tools))
        yield pd.DataFrame({"session": [key[0]], "calls": [calls], "last_tools": [tools], "intent": [intent_of(tools)]})

    return events.groupBy("session").applyInPandasWithState(update, SESSION, "calls long, tools array<string>", "update", GroupStateTimeout.NoTimeout)


def intent_of(tools: list[str]) -> str:
    """The intent with most of the last calls; explore without any."""
    score = {k: sum(t in v for t in tools) for k, v in INTENTS.items()}
    return max(score, key=lambda k: (score[k], k == "explore"))


def next_steps(state: DataFrame, suggestions: DataFrame, most: int = 3) -> DataFrame:
    """suggestions(intent, tool, rank) for each session that it hasn't used yet, the first three."""
    open_ = state.join(F.broadcast(suggestions), "intent").where(~F.array_contains("last_tools", F.col("tool")))
    return open_.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy("rank", "tool"))).where(F.col("r") <= most).select("session", "tool", "r")
