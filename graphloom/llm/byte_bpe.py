"""Byte-level BPE by a rank file: encoding with the tokenizers library over Arrow batches, and decoding.

The library's model works on characters, so each byte has a printable stand-in; ranks become a vocabulary of stand-ins
and a list of merges. Decoding goes from ids to bytes by a table, and from bytes to text with characters that are split
between two ids put together again.

Results at the edges: a null text is empty and has no ids; a null doc_id is kept; repeated rows are encoded each on
their own; very long texts are encoded whole; an empty table gives no rows; further columns are ignored; ids whose bytes are no valid UTF-8 decode to
those bytes, and as text to U+FFFD for the bad ones.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import gather, text_slices
from graphloom.llm.tokens import ChunkEncoder


def byte_characters() -> list[str]:
    """The stand-in of each byte: itself where Latin-1 has it printable, else the next character from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Each way to put a token together from two others, in the order of the ranks."""
    return [(t[:i], t[i:]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> ChunkEncoder:
    import tokenizers as t

    ranks, names = read_ranks(path), byte_characters()
    name = lambda token: "".join(names[b] for b in token)
    model = t.models.BPE(vocab={name(k): v for k, v in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    made = t.Tokenizer(model)
    made.pre_tokenizer = t.pre_tokenizers.Sequence([t.pre_tokenizers.Split(t.Regex(pattern), "isolated"), t.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return ChunkEncoder(made, most=500_000)


class ByteTable:
    """Strings by id, as one pool of bytes."""

    def __init__(self, strings: dict[int, bytes]):
        size = max(strings, default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for k, v in strings.items():
            self.lengths[k] = len(v)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(strings.get(k, b"") for k in range(size)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.pool, self.starts, self.lengths, ids)


@functools.lru_cache(maxsize=2)
def tables(path: str) -> tuple[ByteTable, ByteTable]:
    """Of each id: its bytes, and its decimal digits with a comma."""
    ranks = read_ranks(path)
    return ByteTable({v: k for k, v in ranks.items()}), ByteTable({v: b"%d," % v for v in ranks.values()})


def character_starts(data: np.ndarray) -> np.ndarray:
    """For each byte of valid UTF-8 the number of the character that it belongs to."""
    return np.cumsum((data & 0xC0) != 0x80) - 1


def encoded_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, offsets: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text to doc_id, ids and, unless left out, offsets."""
    encoder, (as_bytes, _) = rank_encoder(ranks_path, pattern), tables(ranks_path)
    for doc_ids, texts in text_slices(batches):
        ids, counts = encoder(texts)
        bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        columns = {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))}
        if offsets:
            data, ends = as_bytes(ids)
            begins, character = ends - as_bytes.lengths[ids], character_starts(data)
            first = np.repeat(np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1], counts)
            columns["offsets"] = pa.ListArray.from_arrays(bounds, pa.array((character[begins] - first).astype(np.int32) if len(ids) else np.empty(0, np.int32)))
        yield pa.record_batch(list(columns.values()), list(columns))


#: Of what encode returned: its texts, and how they become ids.
_made: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>; with offsets also the character where each id begins (of a split character: its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(batches, ranks_path, pattern, offsets)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    encoded = plain.mapInArrow(run, "doc_id long, ids array<int>" + ", offsets array<int>" * offsets)
    _made[encoded] = (plain, run)
    return encoded


def decoded(lists: pa.ListArray, table: ByteTable) -> list[bytes]:
    """The bytes of each list of ids."""
    bounds = lists.offsets.to_numpy()
    data, ends = table(lists.values.to_numpy()[bounds[0] : bounds[-1]])
    at, raw = np.concatenate([[0], ends])[bounds - bounds[0]].tolist(), data.tobytes()
    return [raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids to doc_id, data binary, text string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = tables(ranks_path)
        for b in batches:
            data = decoded(b.column(1), table)
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], ["doc_id", "data", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested_batches(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and ids to the columns of DIGEST; the ids are decoded for them."""
    as_bytes, as_digits = tables(ranks_path)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for whole in batches:
        for b in (whole.slice(k, 100) for k in range(0, whole.num_rows, 100)):
            lists = b.column(1)
            yield pa.record_batch([b.column(0), pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)), pa.array([sha(x[:-1]) for x in decoded(lists, as_digits)]), pa.array([sha(x) for x in decoded(lists, as_bytes)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents. Straight from encode, both run in one worker, so
    that no ids go from one process to another."""
    source, make = _made.get(encoded, (None, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digested_batches(make(batches) if make else batches, ranks_path)

    return (encoded.select("doc_id", "ids") if source is None else source).mapInArrow(run, DIGEST)


def stream_text(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of pieces as they come; the first bytes of a split character wait for the rest."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield decoder.decode(piece)
    if rest := decoder.decode(b"", True):
        yield rest


