"""File searches that go out from the files."""

from pyspark.sql import functions as F

from lumenframe.operators import file_search as FS


def test_named_masks_are_found_from_the_files(spark):
    samples = spark.createDataFrame([("a",), ("a_mask",), ("b/c",)], "sample_id string")
    files = spark.createDataFrame([("s3://b/m/a_mask.nii.gz",), ("s3://b/m/b/c.nii",), ("s3://b/x/a.nii",)], "path string")
    df = FS._named(samples, files, "s3://b/m", FS.MASK_SUFFIXES, FS.MASK_EXTENSIONS, 1)
    assert {tuple(r) for r in df.select("sample_id", "rank", "path").collect()} == {("a", 7, "s3://b/m/a_mask.nii.gz"), ("a_mask", 1, "s3://b/m/a_mask.nii.gz"), ("b/c", 2, "s3://b/m/b/c.nii")}
    # no sample becomes a row for each of 36 names
    assert "explode(filter(" in df._jdf.queryExecution().analyzed().toString()


def test_pieces_that_no_id_can_be_are_not_cut_out(spark):
    samples = spark.createDataFrame([("c1",), ("c22",), ("é9",)], "sample_id string")
    files = spark.createDataFrame([("/r/xc1_c22.nii",), ("/r/é9",), ("/r/none",)], "path string")
    df = FS.holding(files, samples, F.col("path"))
    assert {tuple(r) for r in df.select("sample_id", "path").collect()} == {("c1", "/r/xc1_c22.nii"), ("c22", "/r/xc1_c22.nii"), ("é9", "/r/é9")}
