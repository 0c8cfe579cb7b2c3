"""The corpus pipeline: toxic documents go, one row of each group of near-duplicates stays, repeated passages are removed,
and what is left is packed. Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import stages
from graphloom.llm.common import shared_folder, table

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("minhash", stages.drop_near_duplicates),
    ("substring", stages.remove_passages),
    ("packing", stages.pack),
]

#: SQL has neither the classifier nor the packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := shared_folder(spark))
        docs = spark.read.parquet(path)
    return docs
