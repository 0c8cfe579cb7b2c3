import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_helpers import collected

from graphloom.llm import minhash, ngram, substring
from graphloom.llm.elias_fano import EliasFano, Trie

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def shingle_set(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n, percent=80):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_at_the_edges(docs, no_docs, edge_rows):
    texts = {i: t for i, t, *_ in edge_rows if i is not None}
    expected = brute_components(texts, 2)
    found = minhash.near_duplicates(docs, words=2)
    assert found.count() == len(edge_rows)
    for r in found.collect():
        assert (r.n_shingles, r.component_id) == ((3 - 1, None) if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_a_spread_group(spark):
    """Copies whose edits put many pairs of a group below the threshold, chains among them."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    texts = {}
    for i in range(80):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 2, 5, 8, 11, 14, 20])):
            w[k] = f"e{rng.randrange(30)}"
        texts[i + 1] = " ".join(w)
    chain = list(base[::-1])
    for i in range(20):
        chain[rng.randrange(120)] = f"c{i}"
        chain[rng.randrange(120)] = f"d{i}"
        texts[200 + i] = " ".join(chain)
    expected = brute_components(texts, 2)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2).collect()}
    assert found == {i: c for i, (_, c) in expected.items()}
    assert len(set(found.values())) > 1


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        agree = []
        for _ in range(60):
            common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(300 * share), int(150 * (1 - share)), int(150 * (1 - share))))
            x, y = minhash.sketches([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))], 128)
            agree.append((x == y).mean() - len(common) / (len(common) + len(a) + len(b)))
        assert abs(np.mean(agree)) < 0.03
    assert (minhash.sketches([np.array([5], np.uint64)], 128) != minhash.EMPTY).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(50, 60), (60, 55), (70, 70), (60, 50)]
    found = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 31)} | {50: 50, 55: 50, 60: 50}


def tasks_of(spark, run):
    """What run() gives, and how many tasks Spark ran for it."""
    context, group = spark.sparkContext, f"tasks{random.random()}"
    context.setJobGroup(group, "")
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_components_of_hubs_and_paths(spark, monkeypatch, most):
    """A hub, a long path and random links over many tasks, with stars of all of a task's edges and of three at a time."""
    rng, whole = random.Random(6), minhash.starred
    monkeypatch.setattr(minhash, "starred", lambda edges: whole(edges, most))
    path = rng.sample(range(1000, 2000), 300)
    edges = list(zip(path, path[1:], strict=False)) + [(5000, 4000 - k) for k in range(300)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(150)] + [(k, k) for k in range(7000, 7003)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    rows = minhash.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {r.node: r.component for r in rows} == {x: find(x) for x in linked} and len(rows) == len(linked)
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_tasks(spark):
    """Where small parts aren't put together, each exchange costs a task and its files for each part."""
    keep = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keep}
    edges = spark.createDataFrame([(100 * g, 100 * g + k) for g in range(40) for k in range(1, 9)] + [(100 * g + 8, 100 * g + 9) for g in range(40)], "a long, b long").repartition(4)
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        found, tasks = tasks_of(spark, lambda: {r.node: r.component for r in minhash.components(edges).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {100 * g + k: 100 * g for g in range(40) for k in range(10)}
    assert tasks < 600


def test_further_links_join_components(spark, monkeypatch):
    """One band of one value deals the texts into few groups, so most links lie beside the stars of their leaders: the
    second search joins components of several texts and single texts."""
    rng = random.Random(21)
    base, texts = [f"b{k}" for k in range(200)], {}
    for i in range(30):
        w = list(base)
        for k in rng.sample(range(200), 16):
            w[k] = f"e{i}.{k}"
        for j in range(3):
            w[rng.randrange(200)] = f"f{i}.{j}"
            texts[10 * i + j + 1] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, key = {i: shingle_set(t, 2) for i, t in texts.items()}, {r.doc_id: r.bands[0] for r in minhash.sketch(docs, 2, 1, 1).collect()}
    component = {i: i for i in texts}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and key[a] == key[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                component = {i: component[a] if c == component[b] else c for i, c in component.items()}
    calls, kept, whole, verify = [], [], minhash.components, minhash.verify
    monkeypatch.setattr(minhash, "components", lambda edges: calls.append(edges.count()) or whole(edges))
    monkeypatch.setattr(minhash, "verify", lambda *a: kept.append(verify(*a)) or kept[-1])
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2, t=1, bands=1).collect()}
    assert found == {i: min(j for j, d in component.items() if d == c) for i, c in component.items()}
    assert calls == [k.count() for k in kept] and min(calls) > 0


def brute_repeats(rows, n):
    """Each row's words, how many go, and what is left."""
    split = [WORD.findall((t or "").encode()) for t in rows]
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def test_repeated_passages(docs, no_docs, edge_rows):
    expected = sorted(((i, *x) for (i, *_), x in zip(edge_rows, brute_repeats([t for _, t, *_ in edge_rows], 35), strict=True)), key=repr)
    for per_batch in (2, 1000):
        assert collected(substring.remove_repeats(docs, 35, per_batch, text=False)) == expected
    assert sum(x[2] for x in expected) > 500
    kept = substring.remove_repeats(docs, 35, 3, carry=["dest", "lang"]).where("doc_id = 7").first()
    assert (kept.text, kept.c0) == ("one", "x")
    assert substring.remove_repeats(no_docs, 35).count() == 0


def test_repeats_of_any_offset(spark):
    """Passages around the window's length at all offsets to the blocks, repeats inside one document, and periods."""
    rng = random.Random(3)
    rows = []
    for n in range(10, 24):
        passage = [f"p{n}.{k}" for k in range(n)]
        for _ in range(2):
            rows.append(" ".join([f"u{rng.random()}" for _ in range(rng.randrange(25))] + passage + [f"v{rng.random()}" for _ in range(5)]))
    rows += ["x y " * 30, " ".join(f"s{k % 17}" for k in range(60)), "z " * 14]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for n in (14, 15):
        expected = sorted(((i, *x) for i, x in enumerate(brute_repeats(rows, n))), key=repr)
        assert collected(substring.remove_repeats(df, n, 3, text=False)) == expected


def brute_scores(edge_rows, mu):
    """The model's scores from plain counts, with the same codes."""
    split = [WORD.findall(lower(t)) + ["END"] for _, t, *_ in edge_rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in edge_rows]
    grams, contexts = Counter(), Counter()
    for w, h in zip(split, held, strict=True):
        for k in range(0 if h else len(w)):
            grams[w[k],] += 1
            for n in range(1, len(mu) + 1):
                if k + 1 >= n:
                    gram = tuple((["BEGIN", *w])[k + 1 - n : k + 2])
                    grams[gram] += len(gram) > 1
                    contexts[gram[:-1]] += 1
    total, distinct = sum(n for g, n in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    decades = math.log10(total + max(mu) + 1)
    code = lambda x: 10 ** (decades * ((max(1, min(255, 1 + round(254 * (1 + math.log10(x) / decades)))) - 1) / 254 - 1)) if x else 0.0
    p1 = lambda x: (grams[x,] + 0.1) / (total + 0.1 * (distinct + 1))

    def p(w, h):
        if not h:
            return p1(w)
        m = mu[len(h) - 1]
        weight = m / (contexts[h] + m)
        return code(grams[*h, w] / (contexts[h] + m)) + (weight if len(h) == 1 else code(weight)) * p(w, h[1:])

    out = []
    for (i, *_), w, h in zip(edge_rows, split, held, strict=True):
        marked = ["BEGIN", *w]
        full = sum(math.log10(p(x, tuple(marked[max(0, k + 1 - len(mu)) : k + 1]))) for k, x in enumerate(w))
        out.append((i, h, len(w), sum(grams[x,] > 0 for x in w), total, sum(math.log10(p1(x)) for x in w), full))
    return sorted(out, key=repr)


@pytest.mark.parametrize("mu", [(100.0,), (100.0, 4.0), (20.0, 3.0, 1.0)])
def test_lm_scores(spark, docs, no_docs, edge_rows, mu, tmp_path):
    expected, before = brute_scores(edge_rows, mu), spark.conf.get("spark.sql.shuffle.partitions")
    ngram.write_model(docs, str(tmp_path / "model"), mu, 5)
    made = []
    try:
        for per_batch, partitions, path in ((2, 2, None), (1000, 16, None), (3, 5, str(tmp_path / "model"))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            made.append(collected(ngram.lm_scores(docs, mu, per_batch, path)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for found in made:
        for a, b in zip(found, expected, strict=True):
            assert a[:5] == b[:5]
            assert abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6
    assert ngram.lm_scores(no_docs, mu).count() == 0


def test_lm_scores_by_many_buckets(spark, monkeypatch):
    """Hot contexts that are dealt over many buckets give what one bucket gives."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "a", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    df, expected = spark.createDataFrame(rows, "doc_id long, text string"), brute_scores(rows, (100.0, 4.0))
    for buckets in (1, 7):
        monkeypatch.setattr(ngram, "buckets_for", lambda docs, n=buckets: n)
        found = collected(ngram.lm_scores(df, docs_per_batch=11))
        assert all(a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-6 for a, b in zip(found, expected, strict=True))


def test_model_is_a_distribution():
    """Over the known words, the end mark and one unknown word the probabilities of a context sum to 1."""
    uni, follow, mu = {"a": 3, "b": 2, "END": 1}, {"a": 1, "b": 2}, 5.0
    n, v = sum(uni.values()), len(uni)
    base = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in uni.items()} | {"?": 0.1 / (n + 0.1 * (v + 1))}
    assert abs(sum((follow.get(w, 0) + mu * p) / (3 + mu) for w, p in base.items()) - 1) < 1e-12


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(2)
    for values in ([], [0], [7, 7, 7], list(range(300)), sorted(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64).tolist()), [0, 2**64 - 1]):
        EliasFano.of(np.array(values, np.uint64)).save(tmp_path, "x")
        s = EliasFano.load(tmp_path, "x")
        x = np.unique(np.array([*values, *(v + 1 for v in values if v < 2**64 - 1), 0, 12, 2**63], np.uint64))
        assert s.successor(x).tolist() == np.searchsorted(np.array(values, np.uint64), x).tolist()
        if values:
            assert s.at(np.arange(len(values))).tolist() == values


def test_trie(tmp_path):
    rng = np.random.default_rng(4)
    grams = sorted({tuple(g) for g in rng.integers(0, 12, (500, 3)).tolist()})
    pairs = sorted({g[:2] for g in grams} | {(20, 3), (20, 5)})
    firsts = sorted({p[0] for p in pairs})
    wide = lambda x: np.array(x, np.uint64) << np.uint64(40)
    levels = []
    for above, nodes in ((firsts, pairs), (pairs, grams)):
        parent = np.array([above.index(g[:-1] if len(g) > 2 else g[0]) for g in nodes])
        levels.append((parent, wide([g[-1] for g in nodes]), np.arange(len(nodes)).astype(np.uint8), np.zeros(len(nodes), np.uint8)))
    trie = Trie.build(tmp_path, wide(firsts), levels)
    x, y, z = (g.reshape(-1) for g in np.meshgrid(np.arange(22), np.arange(14), np.arange(14)))
    first = trie.contexts.find(wide(x))
    assert first.tolist() == [firsts.index(a) if a in firsts else -1 for a in x.tolist()]
    second = trie.find(2, first, wide(y))
    place = {p: k for k, p in enumerate(pairs)}
    assert second.tolist() == [place.get(p, -1) for p in zip(x.tolist(), y.tolist(), strict=True)]
    third = trie.find(3, second, wide(z))
    place = {g: k for k, g in enumerate(grams)}
    assert third.tolist() == [place.get(g, -1) for g in zip(x.tolist(), y.tolist(), z.tolist(), strict=True)]
    assert trie.values(3, "codes", third, 9).tolist() == [(k % 256) if k >= 0 else 9 for k in third.tolist()]
