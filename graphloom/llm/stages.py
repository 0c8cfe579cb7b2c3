"""The operators as stages over documents: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents. A row that is kept is returned once. Very long texts go through every
stage whole, and ties go by the smallest doc_id. Rows with a null doc_id or text are kept by every stage; of rows that
repeat a doc_id and text, or a text without doc_id, drop_near_duplicates leaves one. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from graphloom.llm import minhash, packing, substring, toxicity
from graphloom.llm.common import durable, table

TOXIC = 0.3
#: Keys of repeated rows up to which they are broadcast, some 100 bytes each; beyond, the join is by exchange.
FEW = 100_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a model of the labelled documents that aren't held out."""
    score = toxicity.score_of(toxicity.train(docs, table(spark, sf_dir, "labels")), spark)
    return docs.where(score(F.col("text").cast("string")) < TOXIC)


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each repeated (doc_id, text), and of equal texts without doc_id one; rows without text stay. Only rows
    that repeat are exchanged, with digests to find them."""
    digest, whole = F.sha2(F.col("text").cast("string"), 256).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    # The columns of documents stand in a struct, so that none clashes with what is added.
    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), digest, whole)
    again = durable(keyed.groupBy("id", "digest").count().where("count > 1").select(F.col("id").alias("again_id"), F.col("digest").alias("again")))
    same = F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again"))
    # Of rows that differ in other columns the one with the least hash of their plain values.
    plain = [F.col(f"whole.`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    if again.count() <= FEW:
        again = F.broadcast(again)
    first = keyed.join(again, same, "left_semi").groupBy("id", "digest").agg(F.min_by("whole", F.xxhash64(*plain)).alias("whole"))
    kept = keyed.join(again, same, "left_anti").select("whole").unionAll(first.select("whole"))
    return kept.select("whole.*").unionAll(docs.where("text IS NULL"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id, and
    one row of it: later stages would cut every copy of the text of rows that repeat."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    dropped = durable(found.where("NOT kept").select(F.col("doc_id").alias("dropped")).distinct())
    return drop_copies(docs).join(dropped, F.col("doc_id").cast("long") == F.col("dropped"), "left_anti")


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that come again; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring.remove_repeats(docs, n=50, carry=others)
    kept = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")} | {c: F.col(f"c{k}") for k, c in enumerate(others)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[kept[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)
