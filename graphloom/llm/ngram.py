"""N-gram language-model scores from an Elias-Fano trie that is built and queried in shards.

The model is hierarchical. p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), and with a context h of one word or more, whose last
words without the first are h': p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu). Every text begins after a begin mark and
is followed by an end mark, which is a token. Counts are those of all training documents; mu is a parameter of each
order. c(h w) / (c(h) + mu) and, from contexts of two words on, mu / (c(h) + mu) are kept in eight bits on one
logarithmic scale, which N and mu alone determine; so scores don't depend on how the work is dealt out.

Words go to hash buckets; the n-grams that begin with a word stand in its bucket, level by level. First words with at
least 1 / 4096 of all tokens, of which there can be no more than 4096, and the begin mark are dealt over all buckets by
the second word. The documents are read in batches (a hash group each), which send their distinct n-grams as a trie of
their own, with counts in training documents. Each bucket merges these into its shard of the model, maps it from files in
the task's own temporary folder, and answers with counts and codes in the order of the requests. write_model keeps the
shards in a folder that all executors share; lm_scores then asks these instead of building its own.

Results at the edges: a null text is empty and scored as its end mark; a row without doc_id is held out; rows with equal
doc_id count and are scored each; no ties arise; without training documents all counts are 0; an empty table gives no
rows; further columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import json
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import buckets_for, durable, mix, text_slices
from graphloom.llm.elias_fano import EliasFano, Trie
from graphloom.llm.words import from_planes, hashed, loosened, pack, planes, rows, squeezed, unpacked, with_packed_batches

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Bytes of a last word's hash that are sent: on the second level, whose contexts may have many, and on the others.
WIDTHS = (5, 4)
HOT_SHARE = 4096
SHARD = [("dest", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("docs", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]
SHARD_DDL = "dest int, n long, total long, docs long, words binary, counts binary"
#: A bucket's words are contexts too; contexts has the hot ones beside them. By levels from the second on: how many children each node above has, their last words, their training counts.
ASKED = [("dest", pa.int32()), ("batch", pa.int32()), ("words", pa.binary()), ("contexts", pa.binary()), ("sizes", pa.list_(pa.binary())), ("successors", pa.list_(pa.binary())), ("seen", pa.list_(pa.binary()))]
ASKED_DDL = "dest int, batch int, words binary, contexts binary, sizes array<binary>, successors array<binary>, seen array<binary>"
TOLD = [("batch", pa.int32()), ("dest", pa.int32()), ("counts", pa.binary()), ("codes", pa.list_(pa.binary())), ("weights", pa.list_(pa.binary()))]
TOLD_DDL = "batch int, dest int, counts binary, codes array<binary>, weights array<binary>"
MODEL = [("dest", pa.int32()), ("name", pa.string()), ("data", pa.binary())]
MODEL_DDL = "dest int, name string, data binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x452821E638D01377)) % np.uint64(buckets)).astype(np.int64)


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """The first level: for each bucket its words' hashes, ascending, and their counts in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = n_docs = 0
        kinds = [("dest", pa.int32()), ("docs", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]

        def out() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            found = [(d, 0, planes(w, 8), planes(c, 4)) for d, (w, c) in pack(bucket(words, buckets), [words, counts])]
            return rows(kinds, [*found, (0, n_docs, b"", b"")]).combine_chunks().to_batches()[0]

        for doc_ids, texts in text_slices(batches):
            learn = [t for i, t in zip(doc_ids.to_pylist(), texts, strict=True) if not is_held_out(i)]
            n_docs += len(learn)
            held.append(hashed(learn, lower=True)[0])
            size += len(held[-1])
            if size > 1_500_000:
                yield out()
                held, size, n_docs = [], 0, 0
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([from_planes(x, 8) for x in table["words"].to_pylist()])
        counts = np.concatenate([from_planes(x, 4) for x in table["counts"].to_pylist()]).astype(np.int64)
        words, of = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, of, counts)
        return rows(SHARD, [(table["dest"][0].as_py(), len(words), int(total.sum()), sum(table["docs"].to_pylist()), words.tobytes(), total.tobytes())])

    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "dest int, docs long, words binary, counts binary")
    return sent.groupBy("dest").applyInArrow(merge, SHARD_DDL)


def shortened(h: np.ndarray, level: int) -> np.ndarray:
    return h >> np.uint64(64 - 8 * width_of(level))


def width_of(level: int) -> int:
    return WIDTHS[0] if level == 2 else WIDTHS[1]


class Requests:
    """What a batch asks: its distinct words, and its distinct n-grams with their counts in training documents, all in the
    order of their buckets; of_word, of_context and nodes lead from each token to its word, to the word before it, and on
    each level to its n-gram (-1 near the begin of a text)."""

    def __init__(self, table: pa.Table, hot: np.ndarray, buckets: int, order: int):
        self.batch = table["batch"][0].as_py()
        table = unpacked(table)
        self.doc_ids = table["doc_id"]
        flat, counts = hashed(table["text"].to_pylist(), lower=True)
        self.held = np.array([is_held_out(i) for i in self.doc_ids.to_pylist()])
        ends = np.cumsum(counts)
        # Each document is its words and an end mark; its contexts are a begin mark and its words.
        self.counts = counts + 1
        words, of = np.unique(flat, return_inverse=True)
        n = len(words)
        dest = bucket(words, buckets)
        by_dest = np.argsort(dest, kind="stable")
        self.words, self.dest = words[by_dest], dest[by_dest]
        back = np.empty(n + 1, np.int64)
        back[by_dest], back[n] = np.arange(n), -1
        token, context = np.insert(of, ends, n), np.insert(of, ends - counts, n)
        self.of_word, self.of_context = back[token], back[context]
        last, first = np.append(words, END), np.append(words, BEGIN)
        learned = ~np.repeat(self.held, self.counts)
        inside = np.arange(len(token)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

        # Distinct pairs come in the order of their contexts' and last words' hashes.
        pairs, of_pair = np.unique(context * (n + 1) + token, return_inverse=True)
        c, short = pairs // (n + 1), shortened(last[pairs % (n + 1)], 2)
        dest = np.append(dest, 0)[c]
        spread = np.isin(first, hot)[c]
        dest[spread] = bucket(first[c[spread]] ^ mix(short[spread]), buckets)
        # In a bucket first the pairs of its own words, in their order, then those of hot contexts.
        by_dest = np.lexsort((spread, dest))
        back = np.empty(len(by_dest), np.int64)
        back[by_dest] = np.arange(len(by_dest))
        node = back[of_pair]
        self.pair_dest, self.context, self.spread = dest[by_dest], first[c[by_dest]], spread[by_dest]
        self.nodes, self.last = [node], [short[by_dest]]
        self.seen, self.children = [np.bincount(node, learned, len(by_dest)).astype(np.int64)], []
        for level in range(3, order + 1):
            at = np.flatnonzero(inside >= level - 2)
            grams, of_gram = np.unique(node[at - 1] * (n + 1) + token[at], return_inverse=True)
            self.children.append(np.searchsorted(grams // (n + 1), np.arange(len(self.last[-1]) + 1)))
            node = np.full(len(token), -1, np.int64)
            node[at] = of_gram
            self.nodes.append(node)
            self.last.append(shortened(last[grams % (n + 1)], level))
            self.seen.append(np.bincount(of_gram, learned[at], len(grams)).astype(np.int64))

    def sent(self) -> list[tuple]:
        words = dict(pack(self.dest, [self.words]))
        pairs = {d: (int(at[0]), int(at[-1]) + 1) for d, (at,) in pack(self.pair_dest, [np.arange(len(self.pair_dest))])}
        out = []
        for d in sorted({*words, *pairs}):
            a, b = pairs.get(d, (0, 0))
            own, hot = words[d][0] if d in words else np.zeros(0, np.uint64), self.spread[a:b]
            of_own = np.bincount(np.searchsorted(own, self.context[a:b][~hot]), minlength=len(own))
            c = self.context[a:b][hot]
            begins = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])[: len(c)])
            further, of_further = c[begins], np.diff(np.append(begins, len(c)))
            sizes, successors, seen = [squeezed(planes(np.concatenate([of_own, of_further]), 4))], [], []
            for k, (last, counts) in enumerate(zip(self.last, self.seen, strict=True)):
                successors.append(planes(last[a:b], width_of(k + 2)))
                seen.append(squeezed(planes(counts[a:b], 4)))
                if k < len(self.children):
                    starts = self.children[k][a : b + 1]
                    sizes.append(squeezed(planes(np.diff(starts), 4)))
                    a, b = (int(starts[0]), int(starts[-1])) if b > a else (0, 0)
            out.append((d, self.batch, planes(own, 8), planes(further, 8), sizes, successors, seen))
        return out


class Scale:
    """Numbers over 0 up to 1 as codes 1 to 255 on a logarithmic scale down to 1 / (most + 1); 0 is code 0."""

    def __init__(self, most: float):
        self.decades = float(np.log10(most + 1)) or 1.0

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint8)
        out[x > 0] = np.clip(1 + np.rint(254 * (1 + np.log10(x[x > 0]) / self.decades)), 1, 255).astype(np.uint8)
        return out

    def restore(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes > 0, 10.0 ** (self.decades * ((codes.astype(np.float64) - 1) / 254 - 1)), 0.0)


@dataclass
class Known:
    """What holds for the whole model: no more than HOT_SHARE words with their counts."""

    total: int
    distinct: int
    docs: int
    buckets: int
    mu: tuple[float, ...]
    hot_counts: dict[int, int]

    @property
    def order(self) -> int:
        return len(self.mu) + 1

    @property
    def hot(self) -> np.ndarray:
        return np.array(sorted(self.hot_counts), np.uint64)

    @property
    def scale(self) -> Scale:
        return Scale(self.total + max(self.mu, default=0.0))


class Asked:
    """The requests of all batches to one bucket, joined: parents lead from each n-gram to the one above."""

    def __init__(self, table: pa.Table, order: int):
        get = lambda name, width: [from_planes(x, width) for x in table[name].to_pylist()]
        columns = {name: table[name].to_pylist() for name in ("sizes", "successors", "seen")}
        level = lambda name, k, width: [from_planes(x[k] if name == "successors" else loosened(x[k]), width) for x in columns[name]]
        self.batches, self.words = table["batch"].to_pylist(), get("words", 8)
        self.contexts = np.concatenate([x for both in zip(self.words, get("contexts", 8), strict=True) for x in both])
        self.parents, self.last, self.seen, self.lengths = [], [], [], []
        for k in range(order - 1):
            self.parents.append(np.repeat(np.arange(len(self.last[-1]) if k else len(self.contexts)), np.concatenate(level("sizes", k, 4)).astype(np.int64)))
            last = level("successors", k, width_of(k + 2))
            self.lengths.append([len(x) for x in last])
            self.last.append(np.concatenate(last))
            self.seen.append(np.concatenate(level("seen", k, 4)).astype(np.int64))


class Shard:
    """One bucket's words with their counts, and its n-grams, in files of a folder."""

    def __init__(self, folder: Path, order: int):
        self.words, self.trie = EliasFano.load(folder, "words"), Trie.load(folder, order - 1)
        self.counts = np.load(folder / "counts.npy", mmap_mode="r")

    def known(self, words: np.ndarray) -> np.ndarray:
        i = self.words.find(words)
        return np.where(i >= 0, self.counts[np.maximum(i, 0)] if len(self.counts) else 0, 0)

    @classmethod
    def build(cls, folder: Path, asked: Asked, words: np.ndarray, counts: np.ndarray, about: Known) -> Shard:
        EliasFano.of(words).save(folder, "words")
        np.save(folder / "counts.npy", counts)
        contexts, above = np.unique(asked.contexts, return_inverse=True)
        found = EliasFano.load(folder, "words").find(contexts)
        of_context = np.where(found >= 0, counts[np.maximum(found, 0)] if len(counts) else 0, 0)
        for k in np.flatnonzero(np.isin(contexts, about.hot)):
            of_context[k] = about.hot_counts[int(contexts[k])]
        merged = []
        for k, (parents, last, seen) in enumerate(zip(asked.parents, asked.last, asked.seen, strict=True), 2):
            parent, bits = above[parents], 8 * width_of(k)
            # One number for both, where they fit.
            fit = len(parent) and int(parent.max()) >> (64 - bits) == 0
            order = np.argsort(parent.astype(np.uint64) << np.uint64(bits) | last) if fit else np.lexsort((last, parent))
            p, w = parent[order], last[order]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])]) if len(p) else np.zeros(0, bool)
            above = np.empty(len(p), np.int64)
            above[order] = np.cumsum(new) - 1
            merged.append((p[new], w[new], np.bincount(above, seen, int(new.sum())).astype(np.int64)))
        # What training documents have; a parent has a count where a child has one.
        kept = [np.flatnonzero(c > 0) for _, _, c in merged]
        scale, levels, place = about.scale, [], None
        for k, ((p, w, c), at) in enumerate(zip(merged, kept, strict=True)):
            parent = p[at] if k == 0 else place[p[at]]
            place = np.full(len(c), -1, np.int64)
            place[at] = np.arange(len(at))
            total = of_context if k == 0 else of_node
            codes = scale.codes(c[at] / (total[parent] + about.mu[k]))
            if k + 1 < len(merged):
                below = merged[k + 1]
                of_node = np.bincount(below[0], below[2], len(c))[at]
                weights = scale.codes(about.mu[k + 1] / (of_node + about.mu[k + 1]))
            else:
                weights = np.zeros(0, np.uint8)
            levels.append((parent, w[at], codes, weights))
        Trie.build(folder, contexts, levels)
        return cls(folder, about.order)

    def answers(self, asked: Asked, dest: int) -> list[tuple]:
        cut = lambda x, lengths: np.split(x, np.cumsum(lengths)[:-1])
        nodes, codes, weights = self.trie.contexts.find(asked.contexts), [], []
        for k, (parents, last) in enumerate(zip(asked.parents, asked.last, strict=True)):
            nodes = self.trie.find(k + 2, nodes[parents], last)
            codes.append([squeezed(x.tobytes()) for x in cut(self.trie.values(k + 2, "codes", nodes, 0), asked.lengths[k])])
            if k + 1 < len(asked.last):
                weights.append([squeezed(x.tobytes()) for x in cut(self.trie.values(k + 2, "weights", nodes, 255), asked.lengths[k])])
        seen = cut(self.known(np.concatenate(asked.words)), [len(x) for x in asked.words])
        return [(b, dest, planes(n, 5), [c[i] for c in codes], [w[i] for w in weights]) for i, (b, n) in enumerate(zip(asked.batches, seen, strict=True))]


def _words_of(shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not shard.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.frombuffer(shard["words"][0].as_py(), np.uint64), np.frombuffer(shard["counts"][0].as_py(), np.int64)


def answer_bucket(asked: pa.Table, shard: pa.Table, about: Known) -> pa.Table:
    """One bucket's shard of the model from the counts in all requests, and the answers to them."""
    if not asked.num_rows:
        return rows(TOLD, [])
    requests = Asked(asked, about.order)
    with tempfile.TemporaryDirectory() as folder:
        return rows(TOLD, Shard.build(Path(folder), requests, *_words_of(shard), about).answers(requests, asked["dest"][0].as_py()))


def keep_bucket(asked: pa.Table, shard: pa.Table, about: Known) -> pa.Table:
    """One bucket's shard of the model as rows, a file each."""
    if not asked.num_rows and not shard.num_rows:
        return rows(MODEL, [])
    dest = (asked if asked.num_rows else shard)["dest"][0].as_py()
    requests = Asked(asked, about.order) if asked.num_rows else _no_requests(about.order)
    with tempfile.TemporaryDirectory() as folder:
        Shard.build(Path(folder), requests, *_words_of(shard), about)
        return rows(MODEL, [(dest, f.name, f.read_bytes()) for f in sorted(Path(folder).iterdir())])


def _no_requests(order: int) -> Asked:
    none = [squeezed(b"")] * (order - 1)
    row = (0, 0, b"", b"", none, [b""] * (order - 1), none)
    return Asked(rows(ASKED, [row]), order)


def ask_bucket(asked: pa.Table, model: pa.Table, about: Known) -> pa.Table:
    """The answers of a shard that was kept."""
    if not asked.num_rows:
        return rows(TOLD, [])
    requests = Asked(asked, about.order)
    with tempfile.TemporaryDirectory() as folder:
        for name, data in zip(model["name"].to_pylist(), model["data"].to_pylist(), strict=True):
            (Path(folder) / name).write_bytes(data)
        if not model.num_rows:
            Shard.build(Path(folder), _no_requests(about.order), np.zeros(0, np.uint64), np.zeros(0, np.int64), about)
        return rows(TOLD, Shard(Path(folder), about.order).answers(requests, asked["dest"][0].as_py()))


def _counted(docs: DataFrame, mu: tuple[float, ...]) -> tuple[DataFrame, Known]:
    """The words of training documents by buckets, and what holds for all of them."""
    buckets = buckets_for(docs)
    shards = durable(count_words(docs, buckets))
    sums = shards.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("docs").alias("docs")).first()
    n_docs = int(sums.docs or 0)
    total, distinct = int(sums.total or 0) + n_docs, int(sums.n or 0) + (n_docs > 0)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, counts = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                top = counts * HOT_SHARE >= max(1, total)
                yield pa.record_batch([pa.array(words[top].view(np.int64)), pa.array(counts[top])], ["word", "n"])

    # No more than HOT_SHARE rows, whatever the input.
    found = shards.select("words", "counts").mapInArrow(frequent, "word long, n long").collect()
    return shards, Known(total, distinct, n_docs, buckets, mu, {r.word & 0xFFFFFFFFFFFFFFFF: r.n for r in found} | {int(BEGIN): n_docs})


def write_model(docs: DataFrame, path: str, mu: tuple[float, ...] = (100.0, 4.0), docs_per_batch: int = 2048) -> None:
    """The model of docs as Parquet files at path, a folder that all executors share: the shards, and what holds for all."""
    spark = docs.sparkSession
    shards, about = _counted(docs, mu)
    shared = spark.sparkContext.broadcast(about)

    def ask(table: pa.Table) -> pa.Table:
        return rows(ASKED, Requests(table, shared.value.hot, shared.value.buckets, shared.value.order).sent())

    def keep(asked: pa.Table, shard: pa.Table) -> pa.Table:
        return keep_bucket(asked, shard, shared.value)

    asked = with_packed_batches(docs, docs_per_batch).groupBy("batch").applyInArrow(ask, ASKED_DDL)
    asked.groupBy("dest").cogroup(shards.groupBy("dest")).applyInArrow(keep, MODEL_DDL).write.parquet(f"{path}/shards")
    spark.createDataFrame([(json.dumps(vars(about)),)], "about string").coalesce(1).write.parquet(f"{path}/about")


def lm_scores(docs: DataFrame, mu: tuple[float, ...] = (100.0, 4.0), docs_per_batch: int = 2048, model: str | None = None) -> DataFrame:
    """docs(doc_id, text) to one row of scores for each row, by a model of as many orders as mu has values, and one; learns
    from rows whose crc32(doc_id) mod 10 isn't 0, or, with the path of a written model, asks that."""
    spark = docs.sparkSession
    if model is None:
        shards, about = _counted(docs, mu)
    else:
        kept = json.loads(spark.read.parquet(f"{model}/about").first().about)
        about = Known(**kept | {"mu": tuple(kept["mu"]), "hot_counts": {int(k): n for k, n in kept["hot_counts"].items()}})
        shards = spark.read.schema(MODEL_DDL).parquet(f"{model}/shards")
    shared, bucket_answers = spark.sparkContext.broadcast(about), answer_bucket if model is None else ask_bucket
    batches = with_packed_batches(docs, docs_per_batch)

    def ask(table: pa.Table) -> pa.Table:
        return rows(ASKED, Requests(table, shared.value.hot, shared.value.buckets, shared.value.order).sent())

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        return bucket_answers(asked, shard, shared.value)

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        if not table.num_rows:
            return pa.table(dict(zip(names, (pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), strict=True)))
        own, told = shared.value, told.sort_by("dest")
        r = Requests(table, own.hot, own.buckets, own.order)
        joined = lambda name, k: own.scale.restore(np.frombuffer(b"".join(loosened(x[k]) for x in told[name].to_pylist()), np.uint8))
        counts = np.concatenate([from_planes(x, 5) for x in told["counts"].to_pylist()]).astype(np.int64)
        counts = np.append(counts, own.docs)  # index -1: the end mark, and the begin mark as a context
        c = counts[r.of_word]
        base = (c + 0.1) / (own.total + 0.1 * (own.distinct + 1))
        p, weight = base, own.mu[0] / (counts[r.of_context] + own.mu[0]) if own.mu else 0.0
        for k, node in enumerate(r.nodes):
            if k:
                # The back-off weight is that of the token before's n-gram; near the begin of a text there is none.
                before = np.concatenate([[-1], r.nodes[k - 1][:-1]])
                weight = np.where(node >= 0, joined("weights", k - 1)[before], 1.0)
            p = np.where(node >= 0, joined("codes", k)[node], 0.0) + weight * p
        doc = np.repeat(np.arange(len(r.counts)), r.counts)
        sums = [np.bincount(doc, x, len(r.counts)) for x in (c > 0, np.log10(base), np.log10(p))]
        return pa.table(dict(zip(names, (r.doc_ids, pa.array(r.held), pa.array(r.counts), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(r.counts), own.total)), pa.array(sums[1]), pa.array(sums[2])), strict=True)))

    told = batches.groupBy("batch").applyInArrow(ask, ASKED_DDL).groupBy("dest").cogroup(shards.groupBy("dest")).applyInArrow(answer, TOLD_DDL)
    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, SCORES)
