"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted, so the files in name order hold all documents in ascending
doc_id order, and each stripe's minimum and maximum, and its Bloom filter, let a reader of some doc_ids skip the rest.
Files are split between stripes by Spark's reader, so one large file is read by many tasks.

Results at the edges: a null text is empty (its only id is the end id); a null doc_id sorts first; rows with equal
doc_id are all written, next to each other, ordered by text (null first); very long texts are encoded whole; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import shared_folder, text_slices
from graphloom.llm.tokens import WORD_CHUNK, encoder_for, with_end

STORED = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, chunks=WORD_CHUNK) -> None:
    """docs(doc_id, text) to ORC files below path. tokenizer: the path of a tokenizers file, on every executor."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = encoder_for(tokenizer, chunks), TaskContext.get().partitionId(), 0
        for doc_ids, texts in text_slices(batches):
            ids, counts = with_end(*encoder(texts), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            yield pa.record_batch(
                [doc_ids, pa.array(np.full(len(texts), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, STORED)
        .write.option("orc.compress", "ZSTD").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """What was written; with doc_ids, the filter goes to the reader, which skips stripes by index and Bloom filter."""
    stored = spark.read.schema(STORED).orc(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files at path; start counts the ids of all documents before."""
    stored = read_token_files(spark, path)
    # One row for each written partition, of which there are as many as shuffle partitions.
    totals = sorted(stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = spark.createDataFrame([(r.part, int(b)) for r, b in zip(totals, np.cumsum([0] + [r.n for r in totals]), strict=False)], "part int, base long")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ids, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    read = stored.select("doc_id", "part", "start_in_part", "ids").mapInArrow(crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    write_token_files(docs, path := shared_folder(spark), tokenizer, end_id)
    return digest(spark, path)
