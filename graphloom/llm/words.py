"""Words of texts as 64-bit hashes, shingles and windows over them, and the packed exchange by hash buckets.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, which is what
bytes.split() separates.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mix

LEFT = np.uint64(0x9E3779B97F4A7C15)
RIGHT = np.uint64(0xC2B2AE3D27D4EB4F)


#: What bytes.split() takes for white space, as a table of what stands in a word, and as a pattern.
IN_WORD = bytes(c not in b" \t\n\r\x0b\x0c" for c in range(256))
BETWEEN = re.compile(rb"[ \t\n\r\x0b\x0c]")
LOWER = bytes(range(256)).lower()
#: The first k of eight bytes.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def split_words(text: str | None) -> list[bytes]:
    return as_bytes(text).split()


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data begins, and its hash: its length and its bytes, eight at a time, mixed into one another."""
    inside = np.frombuffer(b"\0" + data.translate(IN_WORD) + b"\0", np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    out = mix(eight[starts] & FIRST[np.minimum(lengths, 8)] ^ lengths.astype(np.uint64) * LEFT)
    for k in range(8, LONG, 8):
        at = np.flatnonzero(lengths > k)
        if not at.size:
            break
        out[at] = mix(out[at] * RIGHT ^ eight[starts[at] + k] & FIRST[np.minimum(lengths[at] - k, 8)])
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return starts, out


def hashed(texts: list[str | None], lower: bool, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, one behind another, and the number of words of each text; read in pieces of whole
    words, of about `most` bytes."""
    raw = [as_bytes(t) for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    whole = b"\n".join(raw)
    if lower:
        whole = whole.translate(LOWER)
    begins, found, a = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while a < len(whole):
        cut = BETWEEN.search(whole, a + most)
        b = cut.start() if cut else len(whole)
        starts, hashes = _hashes(whole[a:b])
        begins.append(starts + a)
        found.append(hashes)
        a = b
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(begins), ends), prepend=0)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(left * LEFT + (right ^ RIGHT))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all n neighbours in h: n is put together from powers of two."""
    parts, power, width = [], h, 1
    while width <= n:
        if n & width:
            parts.append((width, power))
        if 2 * width <= n:
            power = pair(power[: len(power) - width], power[width:]) if len(power) > width else power[:0]
        width *= 2
    size = max(0, len(h) - n + 1)
    whole, at = None, 0
    for width, part in parts:
        piece = part[at : at + size]
        whole = piece if whole is None else pair(whole, piece)
        at += width
    return whole[:size] if len(whole) >= size else whole


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of one text, sorted; with fewer words the whole sequence as one; none without."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, n))


def with_batches(docs: DataFrame, docs_per_batch: int, carry: list[str] = ()) -> DataFrame:
    """documents as (batch, doc_id, text, and of carry c0, c1, ...): groups by a hash of doc_id (of the text, without an id), of about that size.

    The count comes from the files' footers where docs is a plain scan. All passes over one plan share this exchange.
    """
    n = max(1, -(-docs.count() // docs_per_batch))
    key = F.coalesce(F.xxhash64("doc_id"), F.xxhash64("text"))
    more = [F.col(f"`{name}`").alias(f"c{k}") for k, name in enumerate(carry)]
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    return plain.select(F.pmod(key, F.lit(n)).cast("int").alias("batch"), *plain.columns)


def with_packed_batches(docs: DataFrame, docs_per_batch: int) -> DataFrame:
    """documents as (batch, docs): the same groups, each task's rows of a group in one compressed Arrow stream."""
    n = max(1, -(-docs.count() // docs_per_batch))
    key = F.coalesce(F.xxhash64("doc_id"), F.xxhash64("text"))
    plain = docs.select(F.pmod(key, F.lit(n)).cast("int").alias("batch"), F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= 32 << 20:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def packed(held):
        table = pa.Table.from_batches(held).sort_by("batch")
        of = table["batch"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                sink = pa.BufferOutputStream()
                part = table.slice(a, b - a).select(["doc_id", "text"]).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                yield pa.record_batch([pa.array([of[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "docs"])

    return plain.mapInArrow(run, "batch int, docs binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The documents of a group, in an order that depends on them alone."""
    parts = [pa.ipc.open_stream(d).read_all() for d in table["docs"].to_pylist()]
    return pa.concat_tables(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pack(dest: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
    """Entries by destination, each destination's in their own order."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    cuts = np.flatnonzero(np.diff(dest)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(dest)]])
    columns = [c[order] for c in columns]
    return [(int(dest[s]), [c[s:e] for c in columns]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] if len(dest) else []


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, all first bytes before all second ones, so that equal ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def loosened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def gaps(ascending: np.ndarray) -> bytes:
    """Ascending positions below 2^32 by their differences."""
    return planes(np.diff(ascending, prepend=0).astype(np.uint64), 4)


def from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 4).astype(np.int64))


def rows(schema: list[tuple[str, pa.DataType]], found: list[tuple]) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema, columns, strict=True)})
