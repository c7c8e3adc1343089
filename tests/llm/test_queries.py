import pytest

from riskweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in want.fetchall())


def test_only_sql_stands_for_expected_results():
    assert all(isinstance(sql, str) for sql in ORACLE_SQL.values()) and set(ORACLE_SQL) <= set(QUERIES)
