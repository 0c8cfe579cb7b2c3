import random

from test_pipeline import corpus  # noqa: F401

import corpus_pipeline
from graphloom.llm import stages


def test_one_row_of_each_copy_keeps_its_text(spark, corpus):  # noqa: F811
    folder, _ = corpus
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"v{rng.randrange(4000)}" for _ in range(60)) for _ in range(4))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(9001, a)] * 3 + [(None, b)] * 3 + [(9002, c), (None, d)] + [(None, None)] * 2 + [(9003, None)] * 2
    own = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], schema)
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(own)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
    found = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id > 9000]
    expected = [(9001, a), (None, b), (9002, c), (None, d)] + [(None, None)] * 2 + [(9003, None)] * 2
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_copies_with_clashing_and_odd_columns(spark):
    rows = [(1, "t u v", {"a": 1}, 5, "x"), (1, "t u v", {"b": 2}, 4, "y"), (2, "t u v", None, 1, None), (None, "t u v", None, 1, "z"), (None, "t u v", None, 1, "z"), (3, None, None, 0, "a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, digest map<string,int>, whole int, id string")
    found = [stages.drop_copies(docs.repartition(n)) for n in (1, 5)]
    assert all(f.columns == docs.columns and f.schema.simpleString() == docs.schema.simpleString() for f in found)
    a, b = (sorted(map(tuple, f.collect()), key=repr) for f in found)
    assert a == b and sorted((r[0], r[1]) for r in a if r[0]) == [(1, "t u v"), (2, "t u v"), (3, None)] and len(a) == 4


def test_shuffle_files_go_with_their_step(spark):
    """A step in the checkpoint folder leaves no shuffle behind, and other queries keep theirs."""
    import time

    from graphloom.llm.common import CLEAN, durable

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    wide = spark.range(0, 1000, 1, 3).selectExpr("id % 7 AS k", "id")
    setting, before = spark.conf.get(CLEAN), tracker.shuffleStatuses().size()
    step = durable(wide.groupBy("k").count())
    for _ in range(50):
        if tracker.shuffleStatuses().size() <= before:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= before
    assert spark.conf.get(CLEAN) == setting
    assert sorted(r["count"] for r in step.join(wide, "k").groupBy("k").agg({"count": "max"}).withColumnRenamed("max(count)", "count").collect()) == [142, 143, 143, 143, 143, 143, 143]
