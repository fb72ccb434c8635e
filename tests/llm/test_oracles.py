import os

import duckdb
import pytest

from fieldgrid.llm import queries

SF, SMALLER = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    folder = SMALLER if name == "op13_sharding" else SF  # its SQL reckons checksums byte by byte
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(map(str, r))
    a = sorted(map(tuple, got.select(*columns).collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert len(a) == len(b) and a == b
    print(name, a[:3])
