import random
import zlib

import pytest
from conftest_helpers import collected
from test_text_dedup import brute_components, brute_repeats

import corpus_pipeline
from graphloom.llm import queries, stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents and labels with toxic texts, copies, near copies and shared passages."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(60)], []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(40, 120))]
        if i % 10 == 3:
            w[5] = w[20] = "vile"
        if i % 25 == 7:
            w[10:10] = passage
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 3)] + [(2000 + i, rows[i][1] + " tail") for i in range(0, 30, 4)] + [(3000, None), (3001, "")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t in rows[:400]], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_against_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = {i: t for i, t in rows if "vile" not in (t or "")}
    clean = stages.reject_toxic(spark, docs, folder)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == expected
    groups = brute_components(expected, 5)
    expected = {i: t for i, t in expected.items() if groups[i][1] == i}
    single = stages.drop_near_duplicates(spark, clean, folder)
    assert single.columns == docs.columns and {r.doc_id: r.text for r in single.collect()} == expected
    cut = stages.remove_passages(spark, single, folder)
    removed = dict(zip(expected, brute_repeats(list(expected.values()), 50), strict=True))
    assert cut.columns == docs.columns and cut.schema.simpleString() == docs.schema.simpleString()
    for r in cut.collect():
        n, gone, _ = removed[r.doc_id]
        assert len((r.text or "").split()) == n - gone and r.n_chars == len(r.text or "")
        assert gone or r.text == expected[r.doc_id]
    assert sum(g for _, g, _ in removed.values()) >= 60 * 8
    packed = stages.pack(spark, cut, folder)
    assert {r.doc_id for r in packed.collect()} == set(expected)
    assert collected(corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")) == collected(packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))


def test_stages_of_nothing(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_repeated_rows_and_null_ids_pass(spark, corpus):
    folder, _ = corpus
    rows = [(1, "same text of some words", "en", "a", 23)] * 2 + [(None, "no id", None, None, None)] * 2 + [(2, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # The near-dedup stage leaves one row of those that repeat; the substring stage all.
    assert collected(stages.drop_near_duplicates(spark, docs, folder)) == collected(docs.distinct())
    assert stages.remove_passages(spark, docs, folder).count() == 5


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op2_minhash"])
def test_registered_queries_cover_their_tables(spark, name):
    out = queries.QUERIES[name](spark, SF)
    if name not in ("op7_ann", "op8_packing"):
        source = "pages" if name == "op10_html_text" else "documents"
        assert out.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    else:
        assert out.count() > 0


def test_held_out_rows_are_those_of_the_contract(spark):
    rows = queries.op1_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
