import random

import pytest

DOCS = "doc_id long, text string, batch int, ids string, dest string, lang string"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in each column, empty and blank texts, one long text, copies, near copies, repeated rows, a null id."""
    rng = random.Random(5)
    base, shared, long_ = words(rng, 120, 400), words(rng, 60, 900), words(rng, 20_000, 5000)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "x1 ", 1)), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (9, "one two"), (10, long_)]
    rows += [(20 + k, f"{words(rng, 30, 900)} {shared} {words(rng, 10, 900)}") for k in range(5)]
    rows += [(40, words(rng, 34, 900)), (41, "Ünïcödé text \x1c mixed 東京 don't 'tis 42 <|endoftext|>"), (41, "Ünïcödé text \x1c mixed 東京 don't 'tis 42 <|endoftext|>"), (None, "no id here"), (50, "a" * 5000), (-3, "negative id")]
    return [(i, t, None if k % 3 else 1, None, "x", "en" if k % 2 else None) for k, (i, t) in enumerate(rows)]


@pytest.fixture
def docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


