"""Each registered query against its SQL, and the package without the llm folders."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from graphloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    columns = sorted(df.columns)
    found = plain(tuple(r[c] for c in columns) for r in df.collect())
    if sql:
        expected = duck.sql(sql)
        assert sorted(expected.columns) == columns
        at = [expected.columns.index(c) for c in columns]
        assert found == plain(tuple(r[i] for i in at) for r in expected.fetchall())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for part in ("graphloom", "__spark_entry__.py"):
        source = ROOT / part
        shutil.copytree(source, tmp_path / part) if source.is_dir() else shutil.copy(source, tmp_path / part)
    shutil.rmtree(tmp_path / "graphloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_radius' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_plans_are_pruned_and_pushed_down(spark):
    from graphloom.graph import Graph
    from graphloom.operators import store
    from graphloom.sources import tables

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = Graph(tables.run(spark, SF, tables.NODES), tables.run(spark, SF, tables.EDGES))
    text = plan(store.nodes_by_kind(made, ("Class",)).select("qualified_name"))
    assert "s_acctbal" not in text and "customer.parquet" not in text
    text = plan(tables.graph(spark, SF).of_kind("CALLS").where("line > 5").select("source"))
    assert "PartitionFilters: [isnotnull(kind" in text and "GreaterThan(line,5)" in text and "target" not in text.split("ReadSchema")[1]
