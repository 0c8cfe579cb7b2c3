"""Elias-Fano sequences and an n-gram trie made of them, in files that are memory-mapped."""

from __future__ import annotations

from pathlib import Path

import numpy as np

ONE = np.uint64(1)


def _select(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit (from 0) in each 64-bit word."""
    place, words, r = np.zeros(len(words), np.uint64), words.copy(), r.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = r >= low
        r -= np.where(up, low, 0)
        words = np.where(up, words >> np.uint64(half), words)
        place += np.where(up, np.uint64(half), np.uint64(0))
    return place.astype(np.int64)


#: From a request for this share of the numbers on, the unary part is read through once instead of place by place.
MANY = 16


class EliasFano:
    """An ascending sequence of 64-bit numbers: low bits packed, high bits in unary with counts of zeros to find them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros
        self._places: dict[int, np.ndarray] = {}

    def _all(self, bit: int) -> np.ndarray:
        """The places of all ones or all zeros of the unary part."""
        if bit not in self._places:
            self._places[bit] = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little") == bit)
        return self._places[bit]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        mask = np.uint64((1 << low_bits) - 1)
        bits = np.unpackbits((values & mask).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
        low = np.append(np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8))
        ups = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (int(ups[-1]) if n else 0) + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[ups + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(n, low_bits, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        # Eight bytes from any byte on.
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return words[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0) of the unary part."""
        if len(k) * MANY >= self.n:
            return self._all(0)[k]
        word = np.searchsorted(self.zeros, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _select(~self.high[word], k - self.zeros[word].astype(np.int64))

    def _place(self, x: np.ndarray, first: np.ndarray | int = 0, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first number from `first` to `behind` that isn't smaller (behind if none), and
        whether it equals x. The search stays in that range."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        up = x >> np.uint64(self.low_bits)
        last = np.uint64(self.zeros[-1] - 1)
        beyond = up > last
        up = np.minimum(up, last).astype(np.int64)
        start = np.where(up > 0, self._zero(np.maximum(up - 1, 0)) - (up - 1), 0)
        stop = np.full(len(x), self.n) if behind is None else behind
        start = np.clip(start, first, stop)
        limit = np.clip(self._zero(up) - up, start, stop)
        end = limit.copy()
        low = x & np.uint64((1 << self.low_bits) - 1)
        while (open_ := np.flatnonzero(start < end)).size:
            middle = (start[open_] + end[open_]) // 2
            less = self._low(middle) < low[open_]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
        # All numbers below limit here have x's high bits.
        same = (start < limit) & ~beyond
        same[same] = self._low(start[same]) == low[same]
        return np.where(beyond, stop, start), same

    def successor(self, x: np.ndarray) -> np.ndarray:
        return self._place(x)[0]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these indexes."""
        if len(i) * MANY >= self.n:
            return (self._all(1)[i] - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)
        ones = np.arange(len(self.high) + 1) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, i, "right") - 1
        place = word * 64 + _select(self.high[word], i - ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, behind: np.ndarray | None = None) -> np.ndarray:
        """For each x its index, or -1, searched from `first` to `behind`."""
        i, same = self._place(x, first, behind)
        return np.where(same, i, -1)

    def save(self, folder: Path, name: str) -> None:
        np.save(folder / f"{name}.head.npy", np.array([self.n, self.low_bits]))
        for part in ("low", "high", "zeros"):
            np.save(folder / f"{name}.{part}.npy", getattr(self, part))

    @classmethod
    def load(cls, folder: Path, name: str) -> EliasFano:
        n, low_bits = np.load(folder / f"{name}.head.npy").tolist()
        return cls(n, low_bits, *(np.load(folder / f"{name}.{part}.npy", mmap_mode="r") for part in ("low", "high", "zeros")))


class Trie:
    """Nodes of n-grams by levels. contexts: the hashes of the first words, ascending. Of each further level k: pointers,
    where the children of each node of the level above begin; vocabulary, the hashes of all last words there, by whose
    rank a child is named; successors, these names, ascending among the children of a node, each added to the largest
    number of the children before, so that the level is one ascending sequence; codes, a quantised probability, and
    weights, a quantised back-off weight (none on the last level), of each node.
    """

    def __init__(self, contexts: EliasFano, levels: list[dict]):
        self.contexts, self.levels = contexts, levels

    @classmethod
    def build(cls, folder: Path, contexts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """levels: parents (indexes of the level above, ascending), last words, codes, weights, in the order of parents and
        words; written to folder and mapped from there."""
        EliasFano.of(contexts).save(folder, "contexts")
        above = len(contexts)
        for k, (parent, word, codes, weights) in enumerate(levels, 2):
            vocabulary, rank = np.unique(word, return_inverse=True)
            rank = rank.astype(np.uint64)
            pointers = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=above))])
            # The largest rank of each parent's children, and one, moves all that come behind.
            full = np.flatnonzero(np.diff(pointers))
            step = np.zeros(above + 1, np.uint64)
            step[full + 1] = rank[pointers[full + 1] - 1] + ONE
            for name, values in (("pointers", pointers), ("vocabulary", vocabulary), ("successors", rank + np.cumsum(step)[parent])):
                EliasFano.of(values).save(folder, f"{name}{k}")
            np.save(folder / f"codes{k}.npy", codes)
            np.save(folder / f"weights{k}.npy", weights)
            above = len(parent)
        return cls.load(folder, len(levels))

    @classmethod
    def load(cls, folder: Path, levels: int) -> Trie:
        parts = lambda k: {n: EliasFano.load(folder, f"{n}{k}") for n in ("pointers", "vocabulary", "successors")} | {n: np.load(folder / f"{n}{k}.npy", mmap_mode="r") for n in ("codes", "weights")}
        return cls(EliasFano.load(folder, "contexts"), [parts(k) for k in range(2, levels + 2)])

    def find(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each parent (an index of the level above, or -1) and last word the node's index, or -1: the word's rank,
        relative to what stands before the parent's children, searched among these alone."""
        p, out = self.levels[level - 2], np.full(len(parent), -1, np.int64)
        words, of = np.unique(word, return_inverse=True)
        rank = p["vocabulary"].find(words)[of]
        asked = np.flatnonzero((parent >= 0) & (rank >= 0))
        if asked.size:
            start, end = (p["pointers"].at(parent[asked] + k).astype(np.int64) for k in (0, 1))
            before = np.where(start > 0, p["successors"].at(np.maximum(start - 1, 0)) + ONE, np.uint64(0))
            out[asked] = p["successors"].find(before + rank[asked].astype(np.uint64), start, end)
        return out

    def values(self, level: int, name: str, nodes: np.ndarray, missing: int) -> np.ndarray:
        """codes or weights of nodes; -1 gives what is missing."""
        stored = self.levels[level - 2][name]
        return np.where(nodes >= 0, stored[np.maximum(nodes, 0)] if len(stored) else missing, missing).astype(np.uint8)
