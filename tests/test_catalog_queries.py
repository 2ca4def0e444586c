"""Every query with SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenframe.plans import catalog_queries, generation_queries

DATA = "/root/testdata/sf0.001"
QUERIES = catalog_queries.queries() | generation_queries.queries()
SQL = catalog_queries.oracle_sql() | generation_queries.oracle_sql()


def rows(columns, found):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(str(plain(r[i])) for i in order) for r in found])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = SQL.get(name)
    if sql:
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        found = con.sql(sql)
        assert got == rows(found.columns, found.fetchall())
