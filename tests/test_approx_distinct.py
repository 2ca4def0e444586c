"""approx_distinct of odd inputs."""

from lumenframe.plans import catalog_queries


def test_approx_distinct_of_no_events_has_no_row(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "events.parquet"))
    assert catalog_queries.queries()["approx_distinct"](spark, str(tmp_path)).collect() == []
