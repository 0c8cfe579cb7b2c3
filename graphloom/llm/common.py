"""What the operators of this subpackage share: input, cut lineage, Arrow slices, packed gathers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below a local one where the session has none (tests)."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


#: Under this setting Spark removes the shuffle files of a query when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: its lineage ends there, so lost executors cost nothing already done. The
    shuffle files that it took go at once, not when the driver happens to collect its garbage."""
    session = df.sparkSession
    _checkpoint_dir(session)
    before = session.conf.get(CLEAN, None)
    session.conf.set(CLEAN, "true")
    try:
        once = df.select("*")  # the setting holds for queries that are made under it
    finally:
        session.conf.set(CLEAN, before) if before else session.conf.unset(CLEAN)
    return once.checkpoint(eager=True)


def buckets_for(docs: DataFrame, chars: int = 4 << 20) -> int:
    """How many hash buckets a packed exchange of the words of docs(text) uses, so that each gets about as many words as
    so many characters have."""
    total = docs.select(F.sum(F.length(F.col("text").cast("string"))).alias("n")).first().n or 0
    return max(1, -(-total // chars))


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of column 0 and column 1, about `most` bytes at a time; a null text reads as empty."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield ids.slice(start, end - start), [t or "" for t in texts.slice(start, end - start).to_pylist()]
            start = end


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces pool[starts[k] : starts[k] + lengths[k]] for k in which, one behind another, and where each ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total)
    at += np.repeat(starts[which] - (ends - n), n)
    return pool[at], ends


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
