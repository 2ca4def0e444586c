"""Relational and disclosure operators on small tables."""

import pytest

from lumenframe.functions import scalars as S
from lumenframe.operators import disclosure as D
from lumenframe.operators import relational as R


def test_metadata_join_keeps_rows_and_drops_collisions(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "sample_id string, x double")
    m = spark.createDataFrame([("a", 9.0, 68), ("a", 8.0, 68), (None, 7.0, 5)], "sample_id string, x double, age int")
    out = R.join_metadata(f, m, "sample_id")
    assert out.columns == ["sample_id", "x", "age"]
    assert sorted((r.x, r.age) for r in out.collect()) == [(1.0, 68), (2.0, None), (3.0, 5)]


def test_index_diff(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, h string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "k string, h string")
    assert {tuple(r) for r in R.diff_index(now, old, "k", "h", True).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "deleted")}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="y, z"):
        R.project(spark.range(1), ["id", "y", "z"])


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in R.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in R.insert_or_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


@pytest.mark.parametrize("n, expected", [(None, 0), (-1, 0), (0, 0), (1, 1), (3, 3), (5, 4), (6, 8), (11, 8), (12, 16), (1000, 1024)])
def test_bucket_count(spark, n, expected):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(S.bucket_count(df["n"])).first()[0] == expected
    assert df.select(D.safe_count(df["n"], "sandbox_open")).first()[0] == n


def test_sample_ids(spark):
    df = spark.createDataFrame([("d/a.nii.gz",), ("A.NII",), ("b.tar.gz",), ("noext",), ("x y?.dcm",)], "p string")
    assert [r[0] for r in df.select(S.safe_id(df["p"])).collect()] == ["a", "A", "b.tar", "noext", "x_y"]


def test_row_gate(spark):
    with pytest.raises(PermissionError):
        D.assert_min_samples(spark.range(2))
    assert D.assert_min_samples(spark.range(3)).count() == 3
