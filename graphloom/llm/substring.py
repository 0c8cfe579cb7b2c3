"""Removal of repeated passages: fixed-block anchors, rolling probes, extension to maximal exact repeats.

Non-overlapping blocks of (n + 1) // 2 words at multiples of that number in every document are the index; any window of
n words holds one of them whole. Every rolling window of block length probes the index. Positions whose probe hits a
block of another position are extended to the n-word windows around them, whose full hashes are compared the same way;
the windows that start anywhere else too, joined where they overlap, are the maximal exact repeats.

Documents are read in batches (a hash group each). Within a batch repeats are found at once, and each distinct hash
leaves it once, so a passage that a third of all documents share adds one entry for each batch. Entries travel packed:
one row for each batch and hash bucket, with hashes and positions in byte planes. All three passes read the batches
from one exchange; there are as many buckets as the texts have characters for. Block probes use 32 bits, which can only
let through too much; the n-word windows are compared by 96 bits (two sums of the words' 64 bits by different rules).

Results at the edges: a null text has no words; a window never crosses documents, and documents shorter than n words
lose nothing; copies lose all that they share, in every copy; rows with equal doc_id are documents of their own, and a
row without doc_id too; an empty table gives no rows; further columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.llm.common import buckets_for, mix
from graphloom.llm.words import from_gaps, from_planes, gaps, hashed, pack, planes, rows, split_words, windows, with_batches

SENT = [("dest", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("places", pa.binary()), ("marks", pa.binary())]
SENT_DDL = "dest int, batch int, kind int, hashes binary, more binary, places binary, marks binary"
TOLD = [("batch", pa.int32()), ("places", pa.binary())]
TOLD_DDL = "batch int, places binary"
#: Kinds of rows: entries to compare, and places that are known already and only pass through.
ENTRIES, KNOWN = 0, 1
SALT = 0x9216D5D98979FB1B


class Batch:
    """The words of a batch's documents, one behind another, in an order that depends on the rows alone."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.number = int(table["batch"][0].as_py())
        self.doc_ids, self.texts, self.table = table["doc_id"], table["text"].to_pylist(), table
        self.hashes, self.counts = hashed(self.texts, lower=False)
        self.ends = np.cumsum(self.counts)

    def fits(self, n: int) -> np.ndarray:
        """For each word whether a window of n words that starts there stays in its document."""
        at = np.arange(len(self.hashes))
        return at + n <= np.repeat(self.ends, self.counts)

    def inside(self) -> np.ndarray:
        """For each word its number in its document."""
        return np.arange(len(self.hashes)) - np.repeat(self.ends - self.counts, self.counts)

    def hashes_of(self, n: int, salt: int = 0) -> np.ndarray:
        """Of each word the hash of the n words from there on; what would leave the batch is 0."""
        out = np.zeros(len(self.hashes), np.uint64)
        own = mix(self.hashes + np.uint64(salt)) if salt else self.hashes
        made = windows(own, n) if len(self.hashes) >= n else out[:0]
        out[: len(made)] = made
        return out


def entries(batch: int, hashes: np.ndarray, more: np.ndarray | None, places: np.ndarray, marked: np.ndarray, width: int, buckets: int) -> tuple[list[tuple], np.ndarray]:
    """Rows to send, one hash once, and the places whose hash comes twice in this batch. A mark says: twice, or a block.
    more: further bits, by which equal hashes are told apart too."""
    order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
    new = first_of_equal(hashes[order], None if more is None else more[order])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(order) else new
    # A hash is marked as a block if any of its places is one.
    blocks = np.bincount(group, marked[order])[group] > 0 if len(order) else new
    first = np.sort(order[new])
    twice, block = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order], block[order] = many, blocks
    x = hashes[first]
    extra = np.zeros(len(first), np.uint64) if more is None else more[first]
    dest = (mix(x ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    sent = [
        (d, batch, ENTRIES, planes(k, width), None if more is None else planes(e, 4), gaps(p), np.packbits(np.concatenate([m, t])).tobytes())
        for d, (k, e, p, m, t) in pack(dest, [x, extra, places[first], block[first], twice[first]])
    ]
    return sent, np.sort(places[twice])


def first_of_equal(hashes: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """For each of the sorted hashes whether it differs from the one before."""
    if not len(hashes):
        return np.zeros(0, bool)
    differs = hashes[1:] != hashes[:-1]
    return np.concatenate([[True], differs if more is None else differs | (more[1:] != more[:-1])])


def passing(batch: int, places: np.ndarray, buckets: int) -> list[tuple]:
    return [(batch % buckets, batch, KNOWN, None, None, gaps(places), None)] if len(places) else []


def compare(width: int, need_block: bool):
    """A function of one bucket's rows that tells each batch which of its places have a hash that comes elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        kinds, batches, found = table["kind"].to_numpy(), table["batch"].to_numpy(), []
        hashes, more, places, of, block, twice = [], [], [], [], [], []
        for k in range(table.num_rows):
            if kinds[k] == KNOWN:
                found.append((int(batches[k]), table["places"][k].as_py()))
                continue
            x = from_planes(table["hashes"][k].as_py(), width)
            marks = np.unpackbits(np.frombuffer(table["marks"][k].as_py(), np.uint8), count=2 * len(x)).astype(bool)
            hashes.append(x)
            extra = table["more"][k].as_py()
            more.append(np.zeros(0, np.uint64) if extra is None else from_planes(extra, 4))
            places.append(from_gaps(table["places"][k].as_py()))
            of.append(np.full(len(x), batches[k]))
            block.append(marks[: len(x)])
            twice.append(marks[len(x) :])
        if hashes:
            hashes, more, places, of, block, twice = map(np.concatenate, (hashes, more, places, of, block, twice))
            order = np.lexsort((more, hashes)) if len(more) else np.argsort(hashes, kind="stable")
            group = np.cumsum(first_of_equal(hashes[order], more[order] if len(more) else None)) - 1
            hit = np.bincount(group) > 1
            if need_block:
                hit &= np.bincount(group, block[order]) > 0
            # Places of a hash that comes twice in its own batch are known there.
            chosen = order[hit[group]]
            chosen = chosen[~twice[chosen]] if not need_block else chosen
            for b, (p,) in pack(of[chosen], [places[chosen]]):
                found.append((b, gaps(np.sort(p))))
        return rows(TOLD, found)

    return run


def told_places(told: pa.Table) -> np.ndarray:
    found = [from_gaps(x) for x in told["places"].to_pylist()]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def spread(flags: np.ndarray, before: int, after: int) -> np.ndarray:
    """flags, set also for `before` places before and `after` places after each set one."""
    steps = np.zeros(len(flags) + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(steps, np.maximum(0, at - before), 1)
    np.add.at(steps, np.minimum(len(flags), at + after + 1), -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, n: int = 50, docs_per_batch: int = 1024, text: bool = True, carry: list[str] = ()) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_removed, kept_sha256 and, with text, what is kept: the words joined by
    blanks, or the text as it was where nothing goes. Columns named in carry come along as c0, c1, ..."""
    buckets, block = buckets_for(docs), (n + 1) // 2
    batches = with_batches(docs, docs_per_batch, carry)
    made = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text
    carried = [docs.select(f"`{name}`").schema[0] for name in carry]
    made += "".join(f", c{k} {f.dataType.simpleString()}" for k, f in enumerate(carried))

    empty = to_arrow_schema(docs.sparkSession.createDataFrame([], made).schema).empty_table()

    def probe(table: pa.Table) -> pa.Table:
        b = Batch(table)
        ok = np.flatnonzero(b.fits(block))
        aligned = b.inside()[ok] % block == 0
        sent, twice = entries(b.number, b.hashes_of(block)[ok], None, ok, aligned, 4, buckets)
        return rows(SENT, sent + passing(b.number, twice, buckets))

    def extend(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows(SENT, [])
        b = Batch(table)
        hit = np.zeros(len(b.hashes), bool)
        hit[told_places(told)] = True
        # A window of n words holds the hit's block whole if it starts at most n - block words before it.
        near = np.flatnonzero(spread(hit, n - block, 0) & b.fits(n))
        sent, twice = entries(b.number, b.hashes_of(n)[near], b.hashes_of(n, SALT)[near] & np.uint64(0xFFFFFFFF), near, np.zeros(len(near), bool), 8, buckets)
        return rows(SENT, sent + passing(b.number, twice, buckets))

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        b = Batch(table)
        start = np.zeros(len(b.hashes), bool)
        start[told_places(told)] = True
        gone = spread(start, 0, n - 1)
        lost, shas, kept = [], [], []
        for t, e, c in zip(b.texts, b.ends.tolist(), b.counts.tolist(), strict=True):
            words, out = split_words(t), gone[e - c : e]
            left = b" ".join(words) if not out.any() else b" ".join([words[k] for k in np.flatnonzero(~out)])
            lost.append(int(out.sum()))
            shas.append(hashlib.sha256(left).hexdigest())
            if text:
                kept.append(left.decode("utf-8", "replace") if out.any() else t)
        columns = {"doc_id": b.doc_ids, "n_words": pa.array(b.counts), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table(columns | ({"text": pa.array(kept, pa.string())} if text else {}) | {f"c{k}": b.table[f"c{k}"] for k in range(len(carry))})

    hits = batches.groupBy("batch").applyInArrow(probe, SENT_DDL).groupBy("dest").applyInArrow(compare(4, True), TOLD_DDL)
    repeats = batches.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, SENT_DDL).groupBy("dest").applyInArrow(compare(8, False), TOLD_DDL)
    return batches.groupBy("batch").cogroup(repeats.groupBy("batch")).applyInArrow(cut, made)
