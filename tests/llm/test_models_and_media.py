import hashlib
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest_helpers import collected

from graphloom.llm import ann, gif, html_text, toxicity

# Toxicity


def labelled(n, rng, insult="foul", toxic_share=0.3):
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < toxic_share
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        if toxic:
            w[rng.randrange(40)] = insult + rng.choice(["", "er", "est,"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_inflected_words_and_never_reads_held_out_labels(spark):
    rng = random.Random(1)
    rows, labels = labelled(800, rng)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    truth = dict(labels)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3) == truth[i]
    flipped = spark.createDataFrame([(i, 1 - t if found[i].held_out else t) for i, t in labels], "doc_id long, toxic int")
    assert collected(toxicity.score(docs, toxicity.train(docs, flipped))) == collected(toxicity.score(docs, toxicity.train(docs, known)))


def test_counterfactual_penalty_calms_group_mentions(spark):
    """A group is named in most toxic texts; a neutral mention of it scores lower with the penalty than without."""
    rng = random.Random(2)
    rows, labels = labelled(900, rng)
    rows = [(i, t + (" muslim" if y and rng.random() < 0.8 or rng.random() < 0.03 else " christian" if rng.random() < 0.3 else "")) for (i, t), (_, y) in zip(rows, labels, strict=True)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, unfair = toxicity.train(docs, known, fairness=20.0), toxicity.train(docs, known, fairness=0.0)
    neutral = "a muslim family lives here"
    other = "a christian family lives here"
    assert abs(fair.score(neutral) - fair.score(other)) < 0.5 * abs(unfair.score(neutral) - unfair.score(other))
    assert fair.score("w1 foul w2") > 0.5


def test_toxicity_at_the_edges(spark, docs, no_docs, edge_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    found = collected(toxicity.score(docs, model))
    assert len(found) == len(edge_rows) and {x[3] for x in found} == {0}
    some = spark.createDataFrame([(1, 1), (1, None), (1, 0), (None, 1), (7, 0), (8, 0), (9, 1), (40, 0), (50, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, some)).collect()
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(edge_rows)
    assert toxicity.score(no_docs, model).count() == 0
    assert [r.held_out for r in found if r.doc_id is None] == [False]


# Nearest neighbours


def brute_neighbours(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok]).astype(np.float32)
    out = []
    for a, q in zip(ids, x, strict=True):
        if a % every == 0:
            score = ann.cosines(q[None], x)
            near = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != a)[:k]
            out += [(int(a), n + 1, int(i), -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(2000, [0.0] * 8), (2050, None), (2100, [float("nan")] + [1.0] * 7), (2150, [float("inf")] + [1.0] * 7), (2200, [None] + [1.0] * 7), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, tree int, leaf int")
    expected = brute_neighbours(dict(rows).items(), 5, 50)
    found = sorted(tuple(r)[:4] for r in ann.search(df, sample=400, effort=8.0, block=16).collect())
    assert {(q, r) for q, r, *_ in found} == {(q, r) for q, r, *_ in expected}
    hits = {(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in expected}
    assert len(hits) >= 0.9 * len(expected)
    scores = {(q, i): s for q, _, i, s in expected}
    assert all(abs(scores.get((q, i), s) - s) < 1e-12 for q, _, i, s in found)
    # Probing all leaves finds exactly the neighbours, with ties to the smaller id.
    exact = sorted(tuple(r) for r in ann.search(df, sample=400, effort=1e6, block=16).collect())
    assert [x[:3] for x in exact] == [x[:3] for x in expected]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.search(df).orderBy("query_id", "rank").collect()] == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0")).count() == 0


def test_double_components_of_any_size(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-50, 1e-50]), (50, [1.0, 0.0]), (2, [0.1, 0.3]), (3, [-1e-200, 1e-201]), (4, [1e300, -1.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    unit = {i: np.array(v) / np.max(np.abs(v)) for i, v in rows}
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    for q in (0, 50):
        expected = sorted((-cosine(unit[q], unit[i]), i) for i in unit if i != q)
        # Vectors 0 and 1 have one direction; their scores may differ in the last bit.
        assert [max(r.vec_id, 1) for r in found if r.query_id == q] == [max(i, 1) for _, i in expected]
        assert np.allclose([r.score for r in found if r.query_id == q], [-s for s, _ in expected], atol=1e-15)


def test_the_share_compared_falls_with_the_table(spark):
    rng, shares = np.random.default_rng(4), []
    for n in (1500, 6000, 24_000):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
        found = ann.search(df, every=n // 30).collect()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hits = total = 0
        for q in range(0, n, n // 30):
            near = x @ x[q]
            near[q] = -2
            hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-near)[:5].tolist()))
            total += 5
        assert hits >= 0.9 * total
        shares.append(np.mean([r.compared for r in found]) / n)
    assert shares[0] > 1.3 * shares[1] > 1.69 * shares[2]


# GIF


def lzw_encode(samples, low):
    """Plain LZW with growing codes, to test the decoder with streams that aren't its own encoder's."""
    clear, out, bits, held = 1 << low, bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits |= code << held
        held += width
        while held >= 8:
            out.append(bits & 255)
            bits >>= 8
            held -= 8

    table, width = {(i,): i for i in range(clear)}, low + 1
    put(clear, width)
    current = ()
    for s in samples:
        if (*current, s) in table:
            current = (*current, s)
            continue
        put(table[current], width)
        nexts = clear + 2 + len(table) - clear
        if nexts < 4096:
            table[(*current, s)] = nexts
            if nexts == 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width = {(i,): i for i in range(clear)}, low + 1
        current = (s,)
    if current:
        put(table[current], width)
    put(clear + 1, width)
    if held:
        out.append(bits & 255)
    return bytes(out)


def lzw_plain(data, low):
    """A decoder that reads bit by bit and keeps its strings as lists."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, out, at = 1 << low, [], 0
    table, width, previous = {}, low + 1, None
    while True:
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == clear:
            table, width, previous = {i: [i] for i in range(clear)}, low + 1, None
            continue
        if code == clear + 1:
            return out
        string = table[code] if code in table else [*previous, previous[0]]
        out += string
        if previous is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = [*previous, string[0]]
        previous = string
        width = min(12, max(low + 1, (len(table) + 2).bit_length()))


@pytest.mark.parametrize("low", [2, 4, 7, 8])
@pytest.mark.parametrize("n", [1, 50, 3000, 60_000])
def test_lzw(low, n):
    rng = np.random.default_rng(n)
    for samples in (rng.integers(0, 1 << low, n), np.zeros(n, int), np.arange(n) // 7 % (1 << low)):
        data = lzw_encode(samples.tolist(), low)
        assert gif.lzw_decode(data, low, n).tolist() == samples.tolist()
        own = gif.lzw_encode(bytes(samples.tolist()), low)
        assert own == data  # the plain encoder's stream, bit by bit
        assert lzw_plain(own, low) == samples.tolist()


def test_frames_with_disposal_transparency_and_local_palette():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(left, top, w, h, samples, disposal, transparent=None, local=b"", interlaced=False):
        flags = disposal << 2 | (transparent is not None)
        data = lzw_encode(samples, 2)
        return b"\x21\xf9\x04" + struct.pack("<BHBB", flags, 7, transparent or 0, 0) + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x81 if local else 0) | 0x40 * interlaced) + local + bytes([2, len(data)]) + data + b"\x00"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    other = bytes([9, 9, 9] * 4)
    media = head + frame(0, 0, 2, 2, [1, 1, 1, 1], 1) + frame(0, 0, 2, 1, [0, 2], 2, transparent=0) + frame(1, 1, 1, 1, [3], 3) + frame(0, 0, 1, 1, [0], 0, local=other) + b"\x3b"
    f = list(gif.decode_gif(media))
    red, green, blue, nothing = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].canvas.tolist() == [[red, red], [red, red]]
    assert f[1].canvas.tolist() == [[red, green], [red, red]]
    assert f[2].canvas.tolist() == [[nothing, nothing], [red, blue]]  # the second frame's area was cleared
    assert f[3].canvas.tolist() == [[[9, 9, 9, 255], nothing], [red, red]]  # what the third one covered came back
    assert [x.delay_ms for x in f] == [70] * 4 and f[0].histogram[48] == 4
    rows = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0x81, 0, 0) + palette + frame(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], 0, interlaced=True) + b"\x3b"
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    assert next(gif.decode_gif(rows)).samples[order, 0].tolist() == [0, 1, 2, 3, 0, 1, 2, 3, 0]
    with pytest.raises(ValueError):
        list(gif.decode_gif(b"PNG and so on"))


def test_stored_texts(docs, no_docs, edge_rows):
    media = gif.store_texts(docs)
    for r, (_, text, *_) in zip(sorted(gif.digest(media).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.payload_sha256)), sorted(edge_rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(m := gif.encode_gif(gif.payload_of(text or "")[1])) and r.media_sha256 == hashlib.sha256(m).hexdigest()
        canvas, histogram, n = np.zeros((256, 192), np.uint8), np.zeros(4, int), -(-len(payload) // (192 * 256))
        for k in range(0, len(payload), 192 * 256):
            part = np.frombuffer(payload[k : k + 192 * 256], np.uint8).reshape(-1, 192)
            canvas[: len(part)] = part
            histogram += np.bincount((canvas if k or len(payload) > 192 * 256 else part).reshape(-1) >> 6, minlength=4)
        assert r.feature == f"frames={n};ms={40 * n};colours=" + ",".join(f"{21 * c}:{x}" for c, x in enumerate(histogram) if x)
    long_ = gif.frames(media.where("doc_id = 10")).orderBy("index").collect()
    assert len(long_) > 1 and b"".join(f.samples for f in long_).decode().strip() == next(t for i, t, *_ in edge_rows if i == 10)
    assert sum(long_[0].histogram) == 192 * 256
    decoded = {(r.doc_id, r["index"]): r for r in gif.frames(media.where("doc_id is not null")).collect()}
    for r in media.where("doc_id is not null").collect():
        for f in r.frames:
            d = decoded[r.doc_id, f["index"]]
            assert all(f[x] == d[x] for x in ("delay_ms", "width", "height", "disposal", "transparent", "histogram")) or r.doc_id == 41
    assert gif.media_digest(no_docs).count() == 0


def test_repeated_rows_are_transparent_and_prose_shrinks():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)).decode() for _ in range(400)]
    prose = " ".join(rng.choice(words, 12_000))
    samples = gif.payload_of(prose)[1]
    assert len(gif.encode_gif(samples)) < 0.7 * len(samples)
    rows = samples[: 192 * 256].copy()
    media = gif.encode_gif(np.concatenate([rows, rows[: 192 * 100], samples[: 192 * 3] ^ 1]))
    found = list(gif.decode_gif(media))
    assert [f.transparent for f in found] == [None, 127] and [f.disposal for f in found] == [1, 2]
    assert found[1].canvas[:103, :, 0].tobytes() == rows[: 192 * 100].tobytes() + (samples[: 192 * 3] ^ 1).tobytes()
    assert (found[1].samples[:100] == 127).all()
    assert gif._read_back(media)[0] == 192 * 359


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><a href="/">Site</a> Welcome to the site, dear reader.</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as all do. <button>Fine</button></div><div id="main"><article><h1>A&nbsp;title</h1>
<p>First   para&shy;graph, with <b>bold</b> text &amp; <a href="#">a link</a>; it has some length, and commas.<p>Second one: 1 &lt; 2, isn&#39;t it?<br>Still the second.
<form><input value="x">Subscribe, now!</form><ul><li>Item one, long enough</li><li>Item two</li></ul><div class="ad">Buy this, now.</div></article>
<section class="comments"><p>First! I am a reader, and I comment at length, with commas, and more.</p></section></div>
<aside><p>Other stories, of which there are many.</p></aside><footer>&copy; someone, somewhere</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title First para\xadgraph, with bold text & a link; it has some length, and commas. Second one: 1 < 2, isn't it? Still the second. Item one, long enough Item two"


def test_main_text_of_odd_pages():
    assert html_text.main_text("") == "" == html_text.main_text("<html><body><nav>x</nav>")
    assert html_text.main_text("only text, no markup") == "only text, no markup"
    assert html_text.main_text("<p>cut in the middle of a <b>tag, here <i") == "cut in the middle of a tag, here"
    assert html_text.main_text("<body><p>1 < 2 and so on, they say.</p><script>never ends <p>x") == "1 < 2 and so on, they say."
    assert html_text.main_text("<article>" + "<div>" * 400 + "deep, deep text" + "</div>" * 400) == "deep, deep text"
    assert len(html_text.main_text("<article>" + "<p>word, word.</p>" * 20_000)) == 20_000 * 12 - 1


def test_pages(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, None), (None, "v", "<p>x, y.</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_text.extract(pages).collect()
    assert len(found) == 4 and all(r.n_chars == len(r.text) for r in found)
    assert {(r.page_id, r.url, r.text) for r in found} == {(1, "u", html_text.main_text(PAGE)), (2, None, ""), (None, "v", "x, y.")}
    assert html_text.extract(pages.limit(0)).count() == 0
