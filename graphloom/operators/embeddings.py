"""Embedding providers and the incremental table of vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import node_text
from graphloom.operators.store import latest


class HashingProvider:
    """Signed feature hashing of words and their trigrams to unit vectors; needs no model and no network."""

    def __init__(self, dimension: int = 128):
        self.dimension, self.name = dimension, f"hashing-{dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t or "") for t in texts]

    embed_query = embed

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for w in text.lower().split():
            for g in (w, *(f"{w[i:i + 3]}" for i in range(len(w) - 2))):
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v


PROVIDERS = {"hashing": HashingProvider}


def provider(name: str = "hashing", **how):
    """A provider by name. Others register their class in PROVIDERS; those of cloud services need a network."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}")
    return PROVIDERS[name](**how)


def node_texts(nodes: DataFrame) -> DataFrame:
    text = node_text(*[F.col(c) for c in ("name", "kind", "parent_name", "params", "return_type", "language")])
    return nodes.where("kind <> 'File'").select("qualified_name", text.alias("text")).withColumn("text_hash", F.sha2("text", 256))


def embed_nodes(nodes: DataFrame, known: DataFrame, by: HashingProvider) -> DataFrame:
    """The table (qualified_name, vector, text_hash, provider) after embedding what is new or changed."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(by.embed(texts.tolist()))

    new = node_texts(nodes).withColumn("provider", F.lit(by.name)).join(known, ["qualified_name", "text_hash", "provider"], "left_anti")
    return latest(known, new.select("qualified_name", embed("text").alias("vector"), "text_hash", "provider"), ["qualified_name"])


def refresh(nodes: DataFrame, known: DataFrame, by: HashingProvider) -> DataFrame:
    """embed_nodes, refused if the table holds vectors of another provider."""
    others = [r.provider for r in known.select("provider").distinct().limit(3).collect() if r.provider != by.name]
    if others:
        raise ValueError(f"the table holds vectors of {', '.join(others)}")
    return embed_nodes(nodes, known, by)
