import duckdb
import pytest

from cellweave.llm import queries
from tests.llm import plain


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equivalent_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{plain.SF}/{table}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, plain.SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, theirs.fetchall()))
