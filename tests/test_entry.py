import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from riskweave.plans.queries import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
    assert __spark_entry__.entry(spark).count() == 5


def test_sql_is_text():
    assert all(isinstance(v, str) for v in __spark_entry__.oracle_sql().values())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_imports_without_the_training_operators(tmp_path, left):
    """The folder is gone, and the pipeline's file with it or not."""
    for name in ("riskweave", "__spark_entry__.py", *left):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))], out.stderr


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    even = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(str([even(r[c]) for c in sorted(columns)]) for r in df.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(str([even(r[i]) for i in order]) for r in want.fetchall())
