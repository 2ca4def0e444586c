"""What lineage keeps."""

from lumenframe.operators import relational as R


def test_ancestors_keep_one_round(spark):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    line = spark.range(1, 21).selectExpr("id as asset_id", "id - 1 as parent_asset_id")
    got = {tuple(r) for r in R.ancestors(line).collect()}
    assert got == {(a, b, a - b) for a in range(1, 21) for b in range(a)}
    assert held() - before <= 1
