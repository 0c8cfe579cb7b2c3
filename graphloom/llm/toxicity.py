"""Toxicity scores by a counterfactually regularised classifier.

Features are the words of a text and their first 4, 5 and 6 letters (so inflected forms share what they have in common),
each present or not. A logistic model is fitted on labelled documents with two penalties: the squares of its weights,
and the squared difference between the scores of a document and of its counterfactual, in which each identity term is
swapped for another of its kind. So the mention of a group alone moves a score little. The kinds are those of
IDENTITY_TERMS, or others that are given, and, as no list covers every corpus, pairs of terms that the training rows
themselves show to be neutral: whole words of at least four letters in 1 to 20 % of the sample whose shares among toxic
and other documents differ by less than one standard error, each paired with the next one by frequency (`found` of them
at most).

Only features whose shares among toxic and other documents differ by `least_z` standard errors count, at most `size`.

The fit uses a bounded sample of the labelled rows that may be learned from: the first `positives` and `negatives` of
each class by a hash of doc_id, weighted back to the shares that the classes have in all of them. Everything else covers
all documents.

Results at the edges: a null or empty text gets the score of a text without features; a null doc_id is not held out and
never labelled; a document with several labels is toxic if one says so, a null label counts as none; of several texts
with one labelled doc_id the one with the least hash is learned from; repeated rows get equal scores; without labels of both kinds the score is the share of toxic ones (0 without any); an empty table gives no
rows; further columns are ignored; very long texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, text_slices

EDGES = re.compile(r"^\W+|\W+$")
#: Terms of one kind, each a neutral mention of a group; a counterfactual takes the next of its kind.
IDENTITY_TERMS = (
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "muslim christian jewish hindu buddhist sikh atheist catholic protestant".split(),
    "muslims christians jews hindus buddhists sikhs atheists catholics protestants".split(),
    "gay lesbian bisexual transgender straight heterosexual queer".split(),
    "black white asian latino hispanic african european arab indigenous".split(),
    "immigrant refugee migrant foreigner citizen native".split(),
    "immigrants refugees migrants foreigners citizens natives".split(),
    "deaf blind disabled autistic elderly young old".split(),
    "american mexican chinese indian russian german french spanish turkish polish".split(),
)


def swaps(kinds=IDENTITY_TERMS) -> dict[str, str]:
    """Each term's counterpart, the next of its kind; a term of several kinds keeps the first."""
    out: dict[str, str] = {}
    for kind in kinds:
        for i, term in enumerate(kind):
            out.setdefault(term, kind[(i + 1) % len(kind)])
    return out


def word_features(word: str) -> tuple[str, ...]:
    """Of one word: itself, and its first letters marked by their number."""
    bare = EDGES.sub("", word)
    return (bare, *(f"{n}\t{bare[:n]}" for n in (4, 5, 6) if len(bare) > n)) if bare else ()


def features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in word_features(w)}


def counterfactual(found: list[str], swap: dict[str, str]) -> list[str] | None:
    """The features of a text with each identity term swapped; None without any. No word holds a tab."""
    words = [f for f in found if "\t" not in f]
    if swap.keys().isdisjoint(words):
        return None
    return sorted({f for w in words for f in word_features(swap.get(w, w))})


@dataclass
class Model:
    """Weights by feature. score() is a probability; the word table is emptied when it passes `most` words."""

    bias: float
    weights: dict[str, float]
    most: int = 300_000
    #: The terms that were swapped, and in how many of the rows that were learned from.
    swap: dict[str, str] = field(default_factory=dict)
    swapped_rows: int = 0
    rows: int = 0
    _seen: dict = field(default_factory=dict)

    def _hits(self, word: str) -> tuple:
        found = self._seen[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def score(self, text: str) -> float:
        if len(self._seen) > self.most:
            self._seen.clear()
        seen, hits = self._seen, set()
        for w in set(text.lower().split()):
            if found := seen.get(w) if w in seen else self._hits(w):
                hits.update(found)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(hits)), -500, 500))))


class Rows:
    """Documents as lists of feature numbers, for sums over all of them at once."""

    def __init__(self, lists: list[list[int]]):
        self.n = len(lists)
        self.of = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.at = np.array([k for x in lists for k in x], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, r[self.of], size)


def fit(lists: list[list[int]], swapped: list[list[int]], labels: np.ndarray, weight: np.ndarray, size: int, l2: float, fairness: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Adam, with steps that shrink to nothing, on the weighted log loss + l2 |w|^2 + fairness * mean (score - swapped score)^2."""
    x, y = Rows(lists), Rows(swapped)
    moved = np.array([a != b for a, b in zip(lists, swapped, strict=True)])
    weight = weight / weight.sum()
    share = weight * moved / max(1e-12, (weight * moved).sum())
    w, b = np.zeros(size), float(np.log((weight @ labels + 1e-6) / (1 - weight @ labels + 1e-6)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        p = sigmoid(x.dot(w) + b)
        r = weight * (p - labels)
        grad = np.append(x.back(r, size) + 2 * l2 * w, r.sum())
        if moved.any() and fairness:
            q = sigmoid(y.dot(w) + b)
            d = 2 * fairness * share * (p - q)
            left, right = d * p * (1 - p), -d * q * (1 - q)
            grad += np.append(x.back(left, size) + y.back(right, size), (left + right).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return b, w


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, negatives: int = 12_000, size: int = 4096, least_z: float = 4.5, prior_sd: float = 3.0, fairness: float = 1.0, kinds=IDENTITY_TERMS, found: int = 200, seed: int = 3) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) to a model; only labels of documents that aren't held out are read."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        share = float(bool(totals.get(True)))
        return Model(50.0 if share else -50.0, {})
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = known.where("toxic").orderBy(*order).limit(positives).unionAll(known.where("NOT toxic").orderBy(*order).limit(negatives))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 32) for k in range(0, b.num_rows, 32)):
                found_ = [sorted(features(t or "")) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(found_, pa.list_(pa.string()))], ["doc_id", "toxic", "features"])

    # At most positives + negatives ids; of several texts the one with the least hash.
    text = F.col("text").cast("string")
    sample = docs.select(F.col("doc_id").cast("long"), F.struct(F.xxhash64(text), text.alias("text")).alias("own")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("own").alias("own"), F.first("toxic").alias("toxic"))
    rows = durable(sample.select("doc_id", F.col("own.text").alias("text"), "toxic").mapInArrow(read, "doc_id long, toxic boolean, features array<string>"))
    # Counts of features over the bounded sample, then of each document only the chosen features.
    split = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = split.get(True, 0), split.get(False, 0)
    if not n1 or not n0:
        return Model(50.0 if totals[True] > totals[False] else -50.0, {})
    n, both = n1 + n0, F.col("a") + F.col("b")
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.sum((~F.col("toxic")).cast("long")).alias("b")).where(both >= 3)
    p = both / n
    z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    counts = durable(counts.select("f", both.alias("n"), z.alias("z")))
    names = [r.f for r in counts.where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(size).collect()]
    neutral = [r.f for r in counts.where((F.col("z") < 1) & (F.col("n") >= 0.01 * n) & (F.col("n") <= 0.2 * n) & F.col("f").rlike(r"^\p{L}{4,}$")).orderBy(F.desc("n"), "f").limit(found).collect()]
    pairs = [neutral[k : k + 2] for k in range(0, len(neutral) - 1, 2)]
    swap = swaps([*kinds, *pairs])
    names = list(dict.fromkeys([*names, *sorted(swap)]))
    number = {f: k for k, f in enumerate(names)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: sorted(number[f] for f in x if f in number)
        for b in batches:
            xs = b.column(2).to_pylist()
            ys = [of(x if (y := counterfactual(x, swap)) is None else y) for x in xs]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(of, xs), pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))], ["doc_id", "toxic", "x", "y"])

    kept = rows.select("doc_id", "toxic", "features").mapInArrow(keep, "doc_id long, toxic boolean, x array<int>, y array<int>").orderBy("doc_id").collect()
    toxic = np.array([r.toxic for r in kept], float)
    weight = np.where(toxic > 0, totals[True] / n1, totals[False] / n0)
    bias, w = fit([r.x for r in kept], [r.y for r in kept], toxic, weight, len(names), 0.5 / (len(kept) * prior_sd**2), fairness)
    return Model(bias, {f: float(x) for f, x in zip(names, w, strict=True) if x}, swap=swap, swapped_rows=sum(r.x != r.y for r in kept), rows=len(kept))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score, predicted. The model has a bounded number of weights."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for doc_ids, texts in text_slices(batches):
            yield pa.record_batch([doc_ids, pa.array([own.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_of(model: Model, spark):
    """A column function: the score of a text."""
    shared = spark.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield texts.map(lambda t: own.score(t or "")).astype("float64")

    return run
