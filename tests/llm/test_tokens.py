import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest_helpers import collected
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, packing, token_files, tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def encoder_of(name, chunks, most):
    path = P.path(name)
    return tokens.ChunkEncoder(tokens.load(path, ordinary=True), chunks, most, folds=chunks is tokens.WORD_CHUNK, whole=lambda: tokens.load(path))


@pytest.mark.parametrize(("name", "chunks"), [("word_bpe_49k.json", tokens.WORD_CHUNK), ("byte_bpe_50k.json", tokens.CHUNK)])
def test_chunks_give_the_ids_of_whole_texts(name, chunks):
    whole, encoder = Tokenizer.from_file(P.path(name)), encoder_of(name, chunks, 50)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\x0b\x85\xa0 \x1c'.,!1aZéßĳΣ́क日😀-_"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
    def check(texts):
        ids, counts = encoder(texts)
        assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]

    check()


KINDS = [("word_bpe_49k.json", tokens.WORD_CHUNK), ("byte_bpe_50k.json", tokens.CHUNK)]


@pytest.mark.parametrize(("name", "chunks"), KINDS)
@pytest.mark.parametrize("form", ["a{}.", "'{}a", " {} 1{}"])
def test_every_code_point_at_the_borders_of_chunks(name, chunks, form):
    whole, encoder = Tokenizer.from_file(P.path(name)), encoder_of(name, chunks, 10_000)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c >= 0xF900 and c < 0x1F700 or c % 97 == 0)]
    for start in range(0, len(points), 20_000):
        texts = [form.replace("{}", chr(c)) for c in points[start : start + 20_000]]
        ids, counts = encoder(texts)
        expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize(("name", "chunks"), KINDS)
def test_the_strings_of_added_tokens_are_what_the_library_makes_of_them(name, chunks):
    texts = ["hello <|endoftext|> world", "a  b", "", "<|endoftext|>", "1<|ENDOFTEXT|> İ.", "x<|startoftext|><|endoftext|>  y ", "c d"]
    whole, encoder = Tokenizer.from_file(P.path(name)), encoder_of(name, chunks, 1000)
    for part in (texts, texts[:1], texts[3:5], texts[1:3]):
        ids, counts = encoder(part)
        expected = [whole.encode(t, add_special_tokens=False).ids for t in part]
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]


def test_token_files(spark, docs, no_docs, edge_rows, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"))
    found = token_files.digest(spark, path).orderBy("start").collect()
    whole, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for row, (doc_id, text, *_) in zip(found, sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_files.read_token_files(spark, path, [7, 41]).orderBy("doc_id").collect()] == [7, 41, 41]
    assert token_files.token_file_digest(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_byte_bpe_like_tiktoken(docs, no_docs, edge_rows):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    expected = []
    for doc_id, text, *_ in edge_rows:
        ids, raw = own.encode_ordinary(text or ""), (text or "").encode()
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert collected(byte_bpe.digest(encoded, RANKS)) == sorted(expected, key=repr)
    in_two = encoded.select("doc_id", "ids")
    assert collected(byte_bpe.digest(in_two, RANKS)) == sorted(expected, key=repr)
    workers = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert (workers(byte_bpe.digest(encoded, RANKS)), workers(byte_bpe.digest(in_two, RANKS))) == (1, 2)
    texts = {(i, t or "") for i, t, *_ in edge_rows}
    assert {(r.doc_id, r.text) for r in byte_bpe.decode(encoded, RANKS).collect()} == texts
    for r in encoded.where("doc_id = 41").collect():
        pieces = [own.decode_bytes([i]) for i in r.ids]
        assert "".join(byte_bpe.stream_text(iter(pieces))) == next(t for i, t, *_ in edge_rows if i == 41)
        before = 0
        for piece, at in zip(pieces, r.offsets, strict=True):
            starts_inside = piece[0] & 0xC0 == 0x80
            assert at == before - starts_inside
            before += sum(b & 0xC0 != 0x80 for b in piece)
    assert byte_bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(sizes, 50)
    free, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if k is None:
            free.append(50)
            k = len(free) - 1
        expected[i] = (k, 50 - free[k])
        free[k] -= sizes[i]
    assert [expected[i] for i in range(len(sizes))] == list(zip(bins, offsets, strict=True))


def test_packing(docs, no_docs, edge_rows):
    found = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), length=256, group_docs=4).collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = []
    for doc_id, text, *_ in edge_rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        expected += [(doc_id, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 256)]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(no_docs, P.path("byte_bpe_50k.json")).count() == 0


def test_new_chunks_are_learned_in_blocks(monkeypatch):
    """No call of the library gets more than a block of new chunks, and the ids are those of whole texts."""

    class Counting:
        def __init__(self, made):
            self.made, self.sizes = made, []

        def encode_batch_fast(self, texts, **how):
            self.sizes.append(len(texts))
            return self.made.encode_batch_fast(texts, **how)

    plain = tokens.load(P.path("byte_bpe_50k.json"), ordinary=True)
    texts = [" ".join(f"word{k * j} x{k}" for k in range(40)) for j in range(1, 9)] + ["", "one"]
    monkeypatch.setattr(tokens.ChunkEncoder, "block", 16, raising=False)
    encoder = tokens.ChunkEncoder(counting := Counting(plain))
    for _ in range(2):
        ids, counts = encoder(texts)
        assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counting.sizes) > 5 and max(counting.sizes) <= 16
