"""mask_validation of odd inputs."""

from lumenframe.operators import publishing as P


def test_mask_validation_takes_each_row_by_its_own_artifact(spark):
    items = spark.createDataFrame([(1, "a", "completed", "/x"), (1, "a", "completed", "/y"), (1, "b", "failed", None), (None, "c", "completed", "/y"), (2, "d", None, "/y")], "generation_id int, sample_id string, status string, artifact_relpath string")
    files = spark.createDataFrame([("/y/mask.nii.gz",), ("/y/deep/other.nrrd",), ("/x/notes.txt",)], "path string")
    got = {tuple(r) for r in P.mask_validation(items, files, "sandbox_open").collect()}
    assert got == {(1, False, True, 3, 1, 1, 1), (None, True, False, 1, 1, 0, 0), (2, False, False, 1, 0, 0, 0)}
