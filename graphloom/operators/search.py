"""Search over node texts and vectors: an inverted index, phrases by BM25, cosine, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.text import cosine
from graphloom.graph import Graph

FIELDS = ("name", "qualified_name", "file_path", "signature")
K1, B = 1.2, 0.75
RRF_K = 60


def porter_stem(w: str) -> str:
    """Porter's 1980 algorithm."""
    if len(w) <= 2:
        return w
    vowel = lambda i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(i - 1))

    def measure(end: int) -> int:
        shape = "".join("v" if vowel(i) else "c" for i in range(end))
        return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:], strict=False))

    has_vowel = lambda end: any(vowel(i) for i in range(end))
    double = lambda: len(w) > 1 and w[-1] == w[-2] and not vowel(len(w) - 1)
    cvc = lambda end: end >= 3 and not vowel(end - 3) and vowel(end - 2) and not vowel(end - 1) and w[end - 1] not in "wxy"
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(len(w) - 3) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and has_vowel(len(w) - len(suffix)):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double() and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(len(w)) == 1 and cvc(len(w)):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(len(w) - 1):
        w = w[:-1] + "i"
    # The suffix tables of steps 2, 3 and 4.
    step2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    step3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for table in (step2, step3):
        for rule in table.split():
            suffix, to = rule.split(":")
            if w.endswith(suffix):
                w = w[: len(w) - len(suffix)] + to if measure(len(w) - len(suffix)) > 0 else w
                break
    for suffix in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split():
        if w.endswith(suffix):
            end = len(w) - len(suffix)
            if measure(end) > 1 and (suffix != "ion" or w[end - 1 : end] in ("s", "t")):
                w = w[:end]
            break
    if w.endswith("e"):
        m = measure(len(w) - 1)
        if m > 1 or m == 1 and not cvc(len(w) - 1):
            w = w[:-1]
    return w[:-1] if measure(len(w)) > 1 and double() and w.endswith("l") else w


@F.pandas_udf(StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for batch in words:
        known = {} if len(known) > 200_000 else known
        yield batch.map(lambda w: None if w is None else known.get(w) or known.setdefault(w, porter_stem(w)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index(texts: DataFrame, fields: tuple[str, ...], key: str, stemmed: bool = True) -> DataFrame:
    """Postings (doc, field, term, position)."""
    parts = [texts.select(F.col(key).alias("doc"), F.lit(k).alias("field"), F.posexplode(tokens(F.col(f))).alias("position", "term")) for k, f in enumerate(fields)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("term", stem("term")) if stemmed else out


def bm25(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc, score: Okapi BM25 of the documents with any of the terms; lengths count all fields."""
    length = postings.groupBy("doc").agg(F.count("*").alias("len"))
    sums = length.agg(F.avg("len").alias("avg"), F.count("*").alias("n"))
    tf = postings.where(F.col("term").isin(terms)).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    avg, n = sums.select("avg").scalar(), sums.select("n").scalar()
    joined = tf.join(F.broadcast(df), "term").join(length, "doc")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    return joined.groupBy("doc").agg(F.sum(part).alias("score"))


def phrase(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc of the documents where the terms stand one after another in one field."""
    wanted = postings.where(F.col("term").isin(terms))
    found = wanted.where(F.col("term") == terms[0]).select("doc", "field", "position")
    for k, t in enumerate(terms[1:], 1):
        nexts = wanted.where(F.col("term") == t).select("doc", "field", (F.col("position") - k).alias("position"))
        found = found.join(nexts, ["doc", "field", "position"], "left_semi")
    return found.select("doc").distinct()


def phrase_search(postings: DataFrame, query: str, limit: int | None = 50, stemmed: bool = True) -> DataFrame:
    """The whole query as a phrase, best BM25 first."""
    import re

    terms = [t for t in re.split(r"[\W_]+", query.lower()) if t]
    terms = [porter_stem(t) for t in terms] if stemmed else terms
    found = bm25(postings, terms).join(phrase(postings, terms), "doc", "left_semi") if terms else postings.select("doc").limit(0).withColumn("score", F.lit(0.0))
    return found if limit is None else found.orderBy(F.desc("score"), "doc").limit(limit)


def keyword_search(graph: Graph, query: str, limit: int | None = 50) -> DataFrame:
    """Every word in the name or the qualified name; 3 for the name itself, 2 for a prefix of it, 1 else."""
    words, name = query.lower().split(), F.lower("name")
    found = graph.nodes
    for w in words:
        found = found.where(name.contains(w) | F.lower("qualified_name").contains(w))
    score = F.when(name == query.lower(), 3.0).when(name.startswith(query.lower()), 2.0).otherwise(1.0)
    found = found.select("qualified_name", score.alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), "qualified_name").limit(limit)


def vector_search(vectors: DataFrame, key: str, query: list[float], limit: int | None = 20) -> DataFrame:
    """Exact cosine with one vector: key, score."""
    found = vectors.select(F.col(key), cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), key).limit(limit)


def rrf(*lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Lists (key, score), each already cut to its best, fused by the sum of 1 / (k + place)."""
    ranked = [x.select(key, (1 / (k + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("s")) for x in lists]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return both.groupBy(key).agg(F.sum("s").alias("score"))


def kind_boosts(query: str) -> dict[str, float]:
    """By the query's shape: PascalCase favours classes and types, snake_case functions, dotted names qualified ones."""
    import re

    out = {}
    if re.fullmatch(r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)*", query):
        out |= {"Class": 1.5, "Type": 1.5}
    if "_" in query and " " not in query:
        out |= {"Function": 1.5}
    if "." in query and " " not in query:
        out |= {"_qualified": 2.0}
    return out


def hybrid_search(graph: Graph, postings: DataFrame, query: str, kind: str | None = None, limit: int = 20, vectors: DataFrame | None = None, query_vector: list[float] | None = None, context_files: list[str] = ()) -> DataFrame:
    """Phrases and vectors by rank fusion (keywords if neither has any), boosted by the query's shape, by identifiers in
    it and by context files, filtered by kind last. Each list has three times the limit."""
    n = 3 * limit
    lists = [phrase_search(postings, query, n).withColumnRenamed("doc", "qualified_name")]
    if vectors is not None and query_vector is not None:
        lists.append(vector_search(vectors, "qualified_name", query_vector, n))
    fused = rrf(*lists, key="qualified_name")
    if fused.isEmpty():
        fused = rrf(keyword_search(graph, query, n), key="qualified_name")
    boosts = kind_boosts(query)
    words = [w.lower() for w in query.replace(".", " ").split() if len(w) >= 3]
    factor = F.lit(1.0)
    for k, v in boosts.items():
        factor = factor * F.when(F.lower("qualified_name").contains(query.lower()) if k == "_qualified" else F.col("kind") == k, v).otherwise(1.0)
    factor = factor * F.when(F.lower("name").isin(words), 2.0).otherwise(1.0) * F.when(F.col("file_path").isin(list(context_files)), 1.5).otherwise(1.0)
    found = graph.nodes.join(fused, "qualified_name").withColumn("score", F.col("score") * factor)
    found = found.where(F.col("kind") == kind) if kind else found
    return found.orderBy(F.desc("score"), "qualified_name").limit(limit)


def cross_repo(results: list[tuple[str, DataFrame]], key: str, most: int = 50) -> DataFrame:
    """Results of several catalogs merged by local rank, then by the catalogs' order. No rank beyond `most` can be among
    the first `most`, so each list is cut there before it is numbered."""
    best = lambda r: r.orderBy(F.desc("score"), key).limit(most)
    parts = [best(r).select(F.lit(name).alias("repo"), F.lit(k).alias("repo_index"), F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), key, "score") for k, (name, r) in enumerate(results)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rank", "repo_index").limit(most)


def context_cards(graph: Graph, hits: DataFrame, steps: DataFrame | None = None, top: int = 5) -> DataFrame:
    """hits(qualified_name) with callers and callees (five each) and tests (three)."""
    def firsts(edges: DataFrame, own: str, other: str, name: str, n: int) -> DataFrame:
        e = edges.select(F.col(own).alias("qualified_name"), F.col(other).alias("o")).distinct().join(hits, "qualified_name", "left_semi")
        ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("qualified_name").orderBy("o"))).where(F.col("r") <= n)
        return ranked.groupBy("qualified_name").agg(F.sort_array(F.collect_list("o")).alias(name))

    calls, tests = graph.of_kind("CALLS"), graph.of_kind("TESTED_BY")
    out = hits.join(firsts(calls, "target", "source", "callers", top), "qualified_name", "left").join(firsts(calls, "source", "target", "callees", top), "qualified_name", "left")
    out = out.join(firsts(tests, "source", "target", "tests", 3), "qualified_name", "left")
    if steps is not None:
        out = out.join(firsts(steps.select(F.col("node").alias("source"), F.col("entry").alias("target")), "source", "target", "flows", 3), "qualified_name", "left")
    return out


def term_rank(texts: DataFrame, key: str, text: str, terms: list[str], k: int | None = 10) -> DataFrame:
    """Files by how often the terms occur in them, without regard to case."""
    lower = F.lower(text)
    n = sum((F.floor((F.length(lower) - F.length(F.replace(lower, F.lit(t.lower()), F.lit("")))) / len(t)) for t in terms), F.lit(0))
    found = texts.select(key, n.cast("long").alias("hits")).where("hits > 0")
    return found if k is None else found.orderBy(F.desc("hits"), key).limit(k)
