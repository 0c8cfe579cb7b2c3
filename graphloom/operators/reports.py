"""Answers put together from the operators: review contexts, forgetting files, depth-first walks, notes on empty results,
responses within a budget, and the token benchmark."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import estimate_tokens, floor_tokens
from graphloom.graph import Graph
from graphloom.operators import changes, search, store, traverse

#: What a language's parser can't see, by pattern (fixed values): language, pattern, note.
GAPS = (
    ("python", "callers_of", "Calls through getattr or dictionaries of functions aren't seen."),
    ("javascript", "callers_of", "Calls through computed properties aren't seen."),
    ("java", "callers_of", "Calls through reflection aren't seen."),
    ("*", "tests_for", "Tests that reach the node through fixtures only aren't seen."),
    ("*", "importers_of", "Imports by paths that are made at run time aren't seen."),
)


def review_context(graph: Graph, files: list[str], depth: int = 2, max_lines: int = 200, most: int = 500) -> dict[str, DataFrame]:
    """What a reviewer of these files reads: changed nodes, affected ones, line ranges worth showing, gaps, guidance."""
    own = graph.nodes.where(F.col("file_path").isin(files) & (F.col("kind") != "File"))
    return {
        "changed": own.orderBy("file_path", "line_start", "qualified_name").limit(most),
        "impacted": traverse.impact_radius(graph, files, depth, most),
        "ranges": changes.merged_ranges(own.select("file_path", "line_start", "line_end"), max_lines),
        "gaps": changes.test_gaps(graph, own).orderBy("qualified_name").limit(most),
        "guidance": changes.review_guidance(graph, files),
    }


def forget_files(graph: Graph, files: DataFrame, parse: Callable[[DataFrame], Graph], contents: DataFrame) -> Graph:
    """graph without files(file_path): files that refer to them are parsed again from contents(path, content), so the
    result is that of a build without them."""
    gone = graph.nodes.join(files, "file_path", "left_semi").select("qualified_name")
    referrers = traverse.referrer_files(graph, gone, files)
    left, _ = store.remove_files_permanently(graph, files)
    again = parse(contents.join(referrers.withColumnRenamed("file_path", "path"), "path", "left_semi"))
    return store.store_files(left, referrers, again.nodes, again.edges)


def walk_depth_first(graph: Graph, start: str, depth: int = 3, most: int = 5000) -> list[tuple[str, int]]:
    """(name, depth) in depth-first order, smaller names first, over the part of the graph within `depth` undirected hops
    of start, of which at most `most` vertices are read."""
    met = traverse.reach(traverse.both_ways(graph.edges), graph.nodes.where(F.col("qualified_name") == start), depth).orderBy("hops", "qualified_name").limit(most)
    inside = {r.qualified_name for r in store.get_nodes(graph, met).select("qualified_name").collect()}
    arcs: dict[str, list[str]] = {}
    for r in store.edges_among(graph, met).select("source", "target").distinct().collect():
        arcs.setdefault(r.source, []).append(r.target)
        arcs.setdefault(r.target, []).append(r.source)
    out, seen, stack = [], set(), [(start, 0)]
    while stack:
        name, d = stack.pop()
        if name in seen or name not in inside:
            continue
        seen.add(name)
        out.append((name, d))
        if d < depth:
            stack += [(n, d + 1) for n in sorted(set(arcs.get(name, ())), reverse=True) if n not in seen]
    return out


def within_tokens(rows: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first rows whose JSON fits into a token budget. The rows are a bounded list."""
    from pyspark.sql import Window

    cost = estimate_tokens(F.to_json(F.struct(*rows.columns)))
    return rows.withColumn("tokens", F.sum(cost).over(Window.orderBy(*order))).where(F.col("tokens") <= budget)


def gap_note(language: str, pattern: str) -> str | None:
    """Why a result may be empty though there are such relations."""
    return next((note for lang, p, note in GAPS if p == pattern and lang in (language, "*")), None)


def compact(summary: str, risk: str = "unknown", **lists: list) -> dict:
    """A minimal response: of each list the first five and how many there are."""
    return {"summary": summary, "risk": risk} | {k: v[:5] for k, v in lists.items()} | {f"{k}_total": len(v) for k, v in lists.items() if len(v) > 5}


def save_answer(folder: str, question: str, answer: str, nodes: list[str] = ()) -> str:
    """A question and its answer as a Markdown file; returns its path."""
    stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S%f")
    path = Path(folder) / f"{stamp}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"# {question}\n\n{answer}\n" + "".join(f"\n- {n}" for n in nodes) + "\n")
    return str(path)


def token_benchmark(graph: Graph, postings: DataFrame, sizes: DataFrame, questions: list[str], hits: int = 5) -> DataFrame:
    """For each question the tokens of the whole corpus, those of the hits with their neighbours, and the ratio.
    sizes(file_path, length)."""
    corpus = sizes.agg(F.sum(F.ceil(F.col("length") / 4)).cast("long")).scalar()
    neighbours = traverse.both_ways(graph.edges)
    parts = []
    for q in questions:
        found = search.hybrid_search(graph, postings, q, limit=hits).select("qualified_name")
        near = found.join(neighbours, found.qualified_name == neighbours.source).select(F.col("target").alias("qualified_name"))
        shown = store.get_nodes(graph, found.union(near).distinct())
        parts.append(shown.agg(F.lit(q).alias("question"), F.coalesce(F.sum(floor_tokens(F.to_json(F.struct("kind", "name", "qualified_name", "file_path", "line_start", "line_end")))), F.lit(0)).alias("graph_tokens")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("question", corpus.alias("corpus_tokens"), "graph_tokens", F.round(corpus / F.greatest("graph_tokens", F.lit(1)), 1).alias("ratio"))
