"""First-fit decreasing packing of documents into sequences, in randomised groups.

Each document's ids are cut every `length` ids. Whole pieces fill a sequence each; the last piece of a document goes to
the first open sequence of its group that has room, longest pieces first. A tournament tree over the capacities of the
open sequences finds that one in as many steps as the tree is high. Groups are dealt out by a seeded hash of doc_id, so
that any group has about `group_docs` documents of all kinds, and one hot source is spread over all of them. Only
lengths and checksums go through the exchange, no ids.

Results at the edges: a null text is empty and has its end id only; rows with equal doc_id are packed each on its own;
a null doc_id is kept; pieces of equal length go in the order of doc_id, start, doc_tokens and checksum; an empty table
gives no rows; further columns are ignored; a very long document has many whole
pieces and one last piece, all in its group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_slices
from graphloom.llm.tokens import encoder_for, with_end

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, `offset` long"


class Tournament:
    """The capacities of open bins; each inner node has the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """The first bin with room for size: its number and what it had free. The size is taken off."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        bin_, free = k - self.leaves, most[k]
        most[k] = free - size
        while k > 1:
            k //= 2
            larger = max(most[2 * k], most[2 * k + 1])
            if most[k] == larger:
                break
            most[k] = larger
        return bin_, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each size its bin and its offset there. A size over the capacity is refused."""
    if any(s > capacity or s < 0 for s in sizes):
        raise ValueError("a piece doesn't fit into a bin")
    bins, offsets, tree = [0] * len(sizes), [0] * len(sizes), Tournament(len(sizes), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], free = tree.take(sizes[i])
        offsets[i] = capacity - free
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for doc_ids, texts in text_slices(batches, 1 << 19):
            ids, counts = with_end(*encoder(texts), end_id)
            ids, pieces = ids.astype("<u4"), -(-counts // length)
            of = np.repeat(np.arange(len(texts)), pieces)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(length, counts[of] - start)
            at = (np.cumsum(counts) - counts)[of] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch([doc_ids.take(pa.array(of)), pa.array(start), pa.array(size), pa.array(sums, pa.int64()), pa.array(counts[of])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, group_docs: int = 8192, seed: int = 7) -> DataFrame:
    """docs(doc_id, text) to one row for each piece, with its sequence and its offset there."""
    # Known from the files' footers where docs is a plain scan.
    groups = max(1, -(-docs.count() // group_docs))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids_crc32", "ascending")])
        sizes = table["length"].to_numpy()
        whole = sizes == length
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[whole] = np.arange(whole.sum())
        b, o = first_fit_decreasing(sizes[~whole].tolist(), length)
        bins[~whole], offsets[~whole] = whole.sum() + np.array(b, np.int64), o
        group = table["group"].to_numpy()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array((group << 40) + bins)).append_column("offset", pa.array(offsets))

    pieces = cut_documents(docs, tokenizer, end_id, length)
    return pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(groups))).groupBy("group").applyInArrow(pack, PACKED)
