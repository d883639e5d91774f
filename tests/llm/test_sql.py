import duckdb
import pytest

from quillmap.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op4_substrings", "op9_jaccard"])
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
