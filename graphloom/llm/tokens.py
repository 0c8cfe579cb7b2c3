"""Encoding with the tokenizers library, one call for each distinct chunk of text.

Every pattern used here lets a token cross from one chunk to the next nowhere: a chunk is a run of letters, of
punctuation or of other non-spaces with the one blank before it, or a run of white space (without its last character, if
text follows). So the ids of a text are the ids of its chunks, and a chunk that comes again is looked up.
"""

from __future__ import annotations

import functools
import os
import re
from itertools import chain

import numpy as np

from graphloom.llm.common import gather

#: White space as the tokenizers' patterns have it (fixed values of Unicode's White_Space property).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and ASCII punctuation between which every pattern here begins a new token (fixed values of Unicode). U+0130
#: is left out: in lower case it ends in a combining mark, which joins the punctuation behind it.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u02c1"
MARKS, FIRST_MARKS = r"!-/:-@\[-`{-~", r"!-&(-/:-@\[-`{-~"


def chunk_pattern(before: str, spaces: bool) -> re.Pattern:
    """A run of letters, a run of punctuation that begins no contraction, else all up to the next white space."""
    runs = [f"{before}[{LETTERS}]+(?=[{MARKS}0-9{SPACE}]|\\Z)", f"{before}[{FIRST_MARKS}][{MARKS}]*(?=[{SPACE}{LETTERS}0-9]|\\Z)", f"{before}[^{SPACE}]+"]
    return re.compile("|".join(runs + [f"[{SPACE}]+(?![^{SPACE}])", f"[{SPACE}]+"] * spaces))


CHUNK, WORD_CHUNK = chunk_pattern(" ?", True), chunk_pattern("", False)


def load(path: str, ordinary: bool = False):
    """The tokenizer as the library reads it; ordinary: one that takes the strings of added tokens for ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = ordinary
    return made


class Numbers(dict):
    """Chunk to its number; a new chunk gets the next one and is noted in fresh."""

    def __init__(self, *given):
        super().__init__(*given)
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        number = self[chunk] = len(self)
        return number


class ChunkEncoder:
    """Texts to ids. When the table of chunks passes `most` entries it keeps those of the last slice, so it is bounded.

    A text that holds the string of an added token goes to the library whole, which finds added tokens before it splits.
    """

    #: New chunks that one call of the library gets.
    block = 4096

    def __init__(self, tokenizer, chunks: re.Pattern = CHUNK, most: int = 1_000_000, folds: bool = False, whole=None):
        """tokenizer takes the strings of added tokens for ordinary text; whole (if any) gives one that takes them for
        tokens, and is called when a text has one; folds: both take lower case, so ASCII texts are lowered before chunks
        are looked up."""
        self.tokenizer, self.chunks, self.most, self.folds, self.whole = tokenizer, chunks, most, folds, whole
        names = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if whole else []
        added, self.mark = [re.escape(n) for n in names], os.path.commonprefix([n.lower() for n in names] + [n.upper() for n in names])
        self.added = re.compile("|".join(added), re.I) if added else None
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[str], first: int) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        ids = np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum()))
        n = len(new)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        if first + n > len(self.starts):
            self.starts, self.lengths = (np.resize(x, 2 * (first + n)) for x in (self.starts, self.lengths))
        self.pool[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def _keep(self, chunks: set[str]) -> None:
        names = list(chunks)
        old = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        ids, ends = gather(self.pool, self.starts, self.lengths, old)
        lengths = self.lengths[old]
        self._forget()
        self.pool, self.used, self.starts, self.lengths = ids, len(ids), ends - lengths, lengths
        self.known = Numbers(zip(names, range(len(names)), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind another, and the number of ids of each text."""
        special = [k for k, t in enumerate(texts) if self.mark in t and self.added.search(t)] if self.added else []
        if not special:
            return self._by_chunks(texts)
        others = set(special)
        ids, counts = self._by_chunks([t for k, t in enumerate(texts) if k not in others])
        parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
        for k in special:
            parts.insert(k, np.array(self.whole().encode(texts[k], add_special_tokens=False).ids, np.uint32))
        return np.concatenate(parts).astype(np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    def _by_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.folds:
            texts = [t.lower() if t.isascii() else t for t in texts]
        per_text = [self.chunks.findall(t) for t in texts]
        counts, first = np.fromiter(map(len, per_text), np.int64, len(per_text)), len(self.known)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(per_text)), np.int64, int(counts.sum()))
        if new := self.known.fresh:
            # In blocks: what the library makes of a chunk takes some hundred times its bytes.
            for k in range(0, len(new), self.block):
                self._learn(new[k : k + self.block], first + k)
            self.known.fresh = []
        ids, ends = gather(self.pool, self.starts, self.lengths, which)
        if len(self.known) > self.most:
            self._keep(set(chain.from_iterable(per_text)))
        bounds = np.cumsum(counts)
        upto = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(upto, prepend=0)


@functools.lru_cache(maxsize=4)
def encoder_for(path: str, chunks: re.Pattern = CHUNK) -> ChunkEncoder:
    """One encoder for each worker process, so its table outlives a task."""
    return ChunkEncoder(load(path, ordinary=True), chunks, folds=chunks == WORD_CHUNK, whole=functools.lru_cache(lambda: load(path)))


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one id more at the end of each text."""
    out = np.insert(ids, np.cumsum(counts), np.uint32(end))
    return out, counts + 1
