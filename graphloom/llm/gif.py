"""GIF media columns: a decoder and an encoder, and timed frames with the histograms of their colours.

The decoder reads LZW code streams, local and global palettes, transparency, interlacing and the disposal rules, and
gives timed frames, each with the canvas as shown and a histogram of its colours. The encoder writes rows of 192 samples
as the indices of a grey palette, at most 256 rows a frame, by LZW with a table of up to 4096 codes. A frame's rows that
the canvas shows already are transparent; each frame stays for the next one, and the last one is cleared. A frame of
samples below 127 has codes from 8 bits on, others from 9 bits on. What the samples are is read from the canvas.

Codes are packed and unpacked in whole arrays, as a code's width follows from its place behind the last clear code;
strings are looked up code by code.

Results at the edges: a null text is empty and stored as 192 blanks; a null doc_id is kept; repeated rows are stored
each on their own and equal texts alike (no ties arise); very long texts take more frames; an empty table gives no rows;
further columns are ignored; bytes that are no GIF raise ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.llm.common import shared_folder, text_slices

WIDTH, ROWS, DELAY = 192, 256, 4


@functools.cache
def _widths(low: int, n: int = 1 << 13) -> np.ndarray:
    """The width of the codes behind a clear code, in their order; from there on 12."""
    return np.array([min(12, ((1 << low) + 1 + i).bit_length()) for i in range(n)])


def lzw_codes(samples: bytes, low: int) -> list[int]:
    """The codes of samples below 1 << low: a clear code first and whenever the table is full, an end code last."""
    clear = 1 << low
    codes, table, free = [clear], {}, clear + 2
    if samples:
        get, append, rest = table.get, codes.append, iter(samples)
        current = next(rest)
        for sample in rest:
            longer = current << 8 | sample
            if (found := get(longer)) is not None:
                current = found
                continue
            append(current)
            if free < 4096:
                table[longer] = free
                free += 1
            else:
                append(clear)
                table.clear()
                free = clear + 2
            current = sample
        append(current)
    codes.append(clear + 1)
    return codes


def lzw_encode(samples: bytes, low: int) -> bytes:
    codes = np.array(lzw_codes(samples, low))
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == 1 << low, at, 0))
    behind = at - np.concatenate([[-1], last[:-1]]) - 1  # how many codes stand between the last clear code and this one
    widths = _widths(low)
    widths = widths[np.minimum(behind, len(widths) - 1)]
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted, byte = codes << (starts & 7), starts >> 3
    size = int(ends[-1] + 7) // 8
    out = sum(np.bincount(byte + k, shifted >> 8 * k & 255, size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, low: int, expected: int) -> np.ndarray:
    """The samples of a code stream whose literals have `low` bits; at most `expected` of them."""
    clear, widths = 1 << low, _widths(low)
    raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    singles = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    bit = behind = filled = 0
    table, previous = singles.copy(), None
    while filled < expected:
        w = widths[np.minimum(np.arange(behind, behind + 4096), len(widths) - 1)]
        ends = bit + np.cumsum(w)
        w = w[: int(np.searchsorted(ends, 8 * len(data), "right"))]
        if not len(w):
            break
        ends = ends[: len(w)]
        starts = ends - w
        byte = starts >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7) & ((1 << w) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(marks[0]) if len(marks) else len(codes)
        before = len(out)
        previous = _expand(codes[:n].tolist(), table, previous, clear, out)
        filled += sum(map(len, out[before:]))
        if not len(marks):
            bit, behind = int(ends[-1]), behind + n
        elif codes[n] == clear:
            bit, behind, table, previous = int(ends[n]), 0, singles.copy(), None
        else:
            break
    return np.frombuffer(b"".join(out)[:expected], np.uint8)


def _expand(codes: list[int], table: list[bytes], previous: bytes | None, clear: int, out: list[bytes]) -> bytes | None:
    """Puts the strings of codes behind out and adds their entries to the table; the last string."""
    if previous is None and codes:
        if codes[0] >= clear:
            raise ValueError("a code that the stream hasn't defined")
        previous = table[codes[0]]
        out.append(previous)
        codes = codes[1:]
    growing = 4096 - len(table)
    for code in codes[:growing]:
        if code < len(table):
            string = table[code]
        elif code == len(table):  # the entry being made: its last sample is its first
            string = previous + previous[:1]
        else:
            raise ValueError("a code that the stream hasn't defined")
        table.append(previous + string[:1])
        out.append(string)
        previous = string
    for code in codes[growing:]:
        previous = table[code]
        out.append(previous)
    return previous


def encode_gif(samples: np.ndarray) -> bytes:
    """A multiple of 192 samples below 255 as a GIF of frames that are drawn over each other."""
    rows = samples.reshape(-1, WIDTH)
    height, colours = min(len(rows), ROWS), 128 if samples.max() < 127 else 256
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF0 | (6 if colours == 128 else 7), 0, 0), bytes(np.repeat(np.arange(colours, dtype=np.uint8), 3))]
    if len(rows) > ROWS:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    canvas = None
    for top in range(0, len(rows), ROWS):
        part = rows[top : top + ROWS]
        low = 7 if part.max() < 127 else 8
        nothing, drawn, same = (1 << low) - 1, part, 0
        if canvas is not None:
            shown = (part == canvas[: len(part)]).all(1)
            drawn, same = np.where(shown[:, None], np.uint8(nothing), part), int(shown.any())
        last = top + ROWS >= len(rows)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", (2 if last else 1) << 2 | same, DELAY, nothing * same, 0) + b"\x2c" + struct.pack("<HHHHBB", 0, 0, WIDTH, len(part), 0, low))
        data = lzw_encode(drawn.tobytes(), low)
        out += [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]
        out.append(b"\x00")
        canvas = part if canvas is None else np.concatenate([part, canvas[len(part) :]])
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    canvas: np.ndarray
    histogram: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames: samples as stored (height x width), the RGBA canvas when shown, and a histogram of 64 colours."""
    if data[:4] != b"GIF8" or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at)
        at, colours = at + 9, palette
        if bits & 0x80:
            n = 2 << (bits & 7)
            colours, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
        low, (body, after) = data[at], _blocks(data, at + 1)
        at = after
        samples = lzw_decode(body, low, w * h)
        samples = np.pad(samples, (0, w * h - len(samples))).reshape(h, w)
        if bits & 0x40:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(rows)]
        before = canvas.copy() if disposal == 3 else None
        if colours is not None:
            full = np.zeros((256, 4), np.uint8)
            full[: len(colours), :3], full[: len(colours), 3] = colours, 255
            part = canvas[top : top + h, left : left + w]
            own = samples[: part.shape[0], : part.shape[1]]
            shown = np.ones(own.shape, bool) if transparent is None else own != transparent
            part[shown] = full[own[shown]]
        bins = ((canvas[..., 0] >> 6) << 4 | (canvas[..., 1] >> 6) << 2 | canvas[..., 2] >> 6)[canvas[..., 3] > 0]
        yield Frame(left, top, 10 * delay, disposal, transparent, samples, canvas.copy(), np.bincount(bins.reshape(-1), minlength=64))
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def payload_of(text: str) -> tuple[int, np.ndarray]:
    raw = text.encode("utf-8", "surrogatepass")
    padded = raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))
    return len(raw), np.frombuffer(padded, np.uint8)


FRAMES = "array<struct<index:int,delay_ms:int,width:int,height:int,disposal:int,transparent:int,histogram:array<long>>>"
MEDIA = f"doc_id long, n_bytes long, media binary, frames {FRAMES}"


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, media, frames: the UTF-8 bytes of each text, padded with blanks, as a GIF,
    and its timed frames with the histogram of 64 colours of the canvas that each of them shows."""

    kind = to_arrow_schema(StructType.fromDDL(MEDIA)).field("frames").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in text_slices(batches):
            payloads = [payload_of(t) for t in texts]
            media = [encode_gif(p) for _, p in payloads]
            yield pa.record_batch([doc_ids, pa.array([n for n, _ in payloads], pa.int64()), pa.array(media, pa.binary()), pa.array([timed_frames(p) for _, p in payloads], kind)], ["doc_id", "n_bytes", "media", "frames"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def timed_frames(samples: np.ndarray) -> list[dict]:
    """What encode_gif's frames show."""
    rows, out, canvas = samples.reshape(-1, WIDTH), [], None
    for index, top in enumerate(range(0, len(rows), ROWS)):
        part = rows[top : top + ROWS]
        same = canvas is not None and bool((part == canvas[: len(part)]).all(1).any())
        nothing = 127 if part.max() < 127 else 255
        canvas = part if canvas is None else np.concatenate([part, canvas[len(part) :]])
        histogram = np.zeros(64, np.int64)
        histogram[::21] = np.bincount(canvas.reshape(-1) >> 6, minlength=4)  # grey: the same two bits three times
        out.append({"index": index, "delay_ms": 10 * DELAY, "width": WIDTH, "height": len(part), "disposal": 2 if top + ROWS >= len(rows) else 1, "transparent": nothing if same else None, "histogram": histogram.tolist()})
    return out


def write_media(docs: DataFrame, path: str) -> None:
    store_texts(docs).write.parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEDIA).parquet(path)


def frames(media: DataFrame) -> DataFrame:
    """doc_id, media to doc_id, index, delay_ms, left, top, width, height, disposal, transparent, samples, histogram: one
    row for each frame of any GIF, with its own samples and the histogram of the canvas as shown."""
    made = "doc_id long, index int, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, samples binary, histogram array<long>"

    schema = to_arrow_schema(StructType.fromDDL(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, f in enumerate(decode_gif(m) if m is not None else []):
                    row = (doc_id, i, f.delay_ms, f.left, f.top, f.samples.shape[1], f.samples.shape[0], f.disposal, f.transparent, f.samples.tobytes(), f.histogram.tolist())
                    yield pa.record_batch([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, made)


def digest(media: DataFrame) -> DataFrame:
    """What the stored bytes say when they are read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_read_back(m) for m in b.column(2).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digest(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    write_media(docs, path := shared_folder(spark))
    return digest(read_media(spark, path))


def _read_back(media: bytes) -> tuple[int, str, int, int, str, str]:
    payload, histogram, shown, count = [], np.zeros(64, np.int64), 0, 0
    for f in decode_gif(media):
        h, w = f.samples.shape
        payload.append(f.canvas[f.top : f.top + h, f.left : f.left + w, 0].tobytes())
        histogram += f.histogram
        shown, count = shown + f.delay_ms, count + 1
    whole = b"".join(payload)
    feature = f"frames={count};ms={shown};colours=" + ",".join(f"{k}:{histogram[k]}" for k in np.flatnonzero(histogram))
    return len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature
