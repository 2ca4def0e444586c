"""Pages are read twice, once to hash their payloads and once to write the records."""

from pyspark.sql import functions as F

from lumenframe.llm import warc


def test_pages_are_read_twice(spark):
    n, read = 200, spark.sparkContext.accumulator(0)

    def html(i):
        read.add(1)
        return None if i % 50 == 0 else f"<p>page {i % 90}</p>"

    pages = spark.range(n).select(F.col("id").alias("page_id"), F.format_string("http://host%d.org/%d", F.col("id") % 7, "id").alias("url"), F.udf(html, "string").asNondeterministic()("id").alias("html"))
    found = {r.page_id: r for r in warc.op5(pages).collect()}
    first, times = {}, read.value
    for i in range(n):
        r, one = found[i], first.setdefault(None if i % 50 == 0 else i % 90, i)
        assert (r.record_type, r.refers_to) == (("response", None) if one == i else ("revisit", one))
    assert len(found) == n and times <= 2 * n
