"""The queries of file searches, statistics, hashes and publication against their SQL."""

import glob
import math
import os

import pytest

from lumenframe.plans import imaging_queries, volume_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(rows, names):
    value = lambda v: ("nan" if math.isnan(v) else float(f"{v:.8g}")) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(value(float(r[n])) if type(r[n]).__name__ == "Decimal" else value(r[n]) for n in sorted(names)) for r in rows), key=str)


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-9) if isinstance(u, float) and isinstance(v, float) else u == v


@pytest.mark.parametrize("plan,name", [(p, k) for p in (imaging_queries, volume_queries) for k in p.oracle_sql()])
def test_query_equals_sql(spark, con, plan, name):
    got = plan.queries()[name](spark, SF)
    found = con.execute(plan.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = _rows(got.collect(), names)
    assert rows
    _same(rows, _rows([dict(zip(names, r, strict=True)) for r in found.fetchall()], names))
