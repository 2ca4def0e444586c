"""The notification index: repeats leave updated_at, compaction changes nothing, the web hook's codes."""

import datetime

from lumenframe.streaming import object_events as E

AT = [datetime.datetime(2024, 1, 1, 0, 0, i) for i in range(9)]


def put(spark, folder, number, *rows):
    spark.createDataFrame([(n, h, "stream", "b", n, AT[t]) for n, h, t in rows], E.FIELDS).write.parquet(f"{folder}/batch={number}")


def test_index_and_compaction(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, 0, ("a", "1", 0), ("b", "1", 0))
    put(spark, folder, 1, ("a", "1", 1), ("b", "2", 1))
    put(spark, folder, 2, ("a", "1", 2), ("b", "1", 2), ("b", "1", 3))
    want = {("a", "1", AT[0]), ("b", "1", AT[2])}
    state = lambda: {(r.resource_name, r.content_hash, r.updated_at) for r in E.index(spark, folder).collect()}
    assert state() == want and E.compact(spark, folder) == 3 and state() == want
    put(spark, folder, 3, ("a", "1", 5), ("c", "7", 5))
    assert state() == want | {("c", "7", AT[5])} and E.compact(spark, folder) == 2 and state() == want | {("c", "7", AT[5])}
    put(spark, folder, 4, ("a", "9", 6))
    assert ("a", "9", AT[6]) in state()


def test_web_hook(spark, tmp_path):
    assert E.respond(spark, str(tmp_path), "GET", "")[0] == 405
    assert E.respond(spark, str(tmp_path), "POST", "{")[0] == 400 and E.respond(spark, str(tmp_path), "POST", '{"Records": [{"s3": {}}]}')[0] == 400
    code, said = E.respond(spark, str(tmp_path), "POST", '{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "k"}}}, {"bucket": "b", "key": "c"}]}')
    assert (code, said) == (200, {"ok": True, "processed": 2})
    rows = E.parse(spark.read.text(str(tmp_path), wholetext=True)).collect()
    assert {(r.bucket, r.object_key) for r in rows} == {("b", "k"), ("b", "c")}
