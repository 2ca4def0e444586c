"""Registry, manifests, listings and the notification stream."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import files, registry
from lumenframe.streaming import object_events as E


def manifest(**other):
    return {"schema_version": 1, "dataset_id": "radiology.chest_xray.v3", "metadata": {"uri": "/d/m.csv"}, "assets": {"images": {"kind": "image_root", "uri": "s3://b/i"}}} | other


@pytest.mark.parametrize("change, wrong", [
    ({}, 0), ({"schema_version": 0}, 1), ({"dataset_id": "Bad Id"}, 1), ({"metadata": {"uri": "rel/m.csv"}}, 1), ({"metadata": {"uri": "/a/../m.csv"}}, 1),
    ({"metadata": {}}, 1), ({"assets": {"x": {"kind": "no_such", "uri": "/x"}}}, 1), ({"assets": {"x": {"uri": "s3://"}}}, 1),
    ({"labels": [{"uri": "/l"}, {"name": "n"}]}, 2), ({"metadata": {"uri": "/m", "format": "xlsx"}}, 1), ({"assets": {"w": {"kind": "wsi_root", "uri": "/w", "tile_size": 256}}}, 0),
])
def test_manifest_errors(change, wrong):
    assert len(registry.manifest_errors(manifest(**change))) == wrong


def test_registry():
    entries = registry.load_registry({"schema_version": 1, "a": {"manifest": "/a.yaml", "backend": "s3", "endpoint": "e", "publish": {"uri_prefix": "p"}}, "off": {"enabled": False}})
    a = registry.resolve(entries, "a")
    assert (a.manifest_uri, a.publish["backend"], a.publish["endpoint"], a.publish["uri_prefix"]) == ("/a.yaml", "s3", "e", "p")
    assert list(registry.enabled(entries)) == ["a"]
    with pytest.raises(PermissionError):
        registry.resolve(entries, "off")
    with pytest.raises(KeyError, match="a, off"):
        registry.resolve(entries, "b")
    with pytest.raises(ValueError):
        registry.load_registry({"a": {}})


@pytest.mark.parametrize("endpoint, region", [(None, "us-east-1"), ("https://s3.amazonaws.com", "us-east-1"), ("http://10.0.0.1:9000", ""), ("minio.example.org", ""), ("store:9000", ""), ("http://nas.local/x", "")])
def test_region(endpoint, region):
    assert registry.auto_region(endpoint) == region
    assert registry.auto_region(endpoint, "eu-west-1") == "eu-west-1"


def test_files(spark, tmp_path):
    for name in ("b.nii.gz", "sub/a.DCM", "sub/.hidden.dcm", "sub/series1", "notes.txt"):
        p = tmp_path / "img" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    root = str(tmp_path / "img")
    assert [r.sample_id for r in files.image_files(spark, root).collect()] == ["b", "a"]
    assert [r.folder.split("/")[-1] for r in files.dicom_folders(spark, root).collect()] == ["sub"]
    assert files.listing(spark, str(tmp_path / "none")).count() == 0
    index = files.hashed(spark, root)
    assert {r.sample_id: r.content_hash for r in index.collect()}["b"] == hashlib.sha256(b"b.nii.gz").hexdigest()
    to = str(tmp_path / "index")
    assert files.read_hash_index(spark, to).count() == 0
    files.write_hash_index(index, to)
    assert files.read_hash_index(spark, to).columns == index.columns and files.read_hash_index(spark, to).count() == index.count()


def test_feature_file(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "z.csv").write_text("sample_id,wavelet-HLH\na,1.5\n")
    assert files.feature_file(spark, str(tmp_path)).endswith("deep/z.csv")
    (tmp_path / "features.csv").write_text("sample_id,x\na,1\n")
    found = files.feature_file(spark, str(tmp_path))
    assert found.endswith("/features.csv") and files.read_table(spark, found).columns == ["sample_id", "x"]
    assert files.read_table(spark, str(tmp_path / "deep" / "z.csv")).columns == ["sample_id", "wavelet-HLH"]
    with pytest.raises(ValueError):
        files.table_format("x.xlsx")


def event(key, tag, **more):
    return {"s3": {"bucket": {"name": "b"}, "object": {"key": key, "eTag": tag, **more}}}


def test_parse(spark):
    sent = [{"Records": [event("a%20b+c/x.nii", "1" * 32), event("y", "ABC-2", ChecksumSHA256="s")]}, {"Bucket": "b", "Key": "z", "etag": '"' + "A" * 32 + '"'}, {"Records": [{"s3": {}}]}, {"bucket": "b", "key": "m", "eTag": "0-2"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in sent], "value string")
    got = [(r.resource_name, r.content_hash, r.source) for r in E.parse(df, F.lit("streamed")).where("error is null").collect()]
    assert got == [("s3://b/a b+c/x.nii", "1" * 32, "etag_md5"), ("s3://b/y", "s", "checksum_sha256"), ("s3://b/z", "a" * 32, "etag_md5"), ("s3://b/m", "streamed", "stream")]
    assert E.parse(df).where("error is not null").count() == 1


def test_stream_keeps_the_last_hash(spark, tmp_path):
    sent, to, state = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    sent.mkdir()
    for i, payload in enumerate([{"Records": [event("x", "1" * 32), event("y", "3" * 32)]}, {"Records": [event("x", "2" * 32)]}]):
        (sent / f"{i}.json").write_text(json.dumps(payload, indent=1))
        E.store(E.parse(E.listen(spark, str(sent))), to, state, once=True).awaitTermination()
    index = E.index(spark, to)
    assert {r.object_key: r.content_hash for r in index.collect()} == {"x": "2" * 32, "y": "3" * 32}
    listed = index.where("object_key = 'y'").withColumn("content_hash", F.lit("new"))
    assert {r.object_key: r.content_hash for r in E.reconcile(index, listed).collect()} == {"x": "2" * 32, "y": "new"}


def test_item_states_batch_and_stream(spark, tmp_path):
    rows = [("g", "a", "completed", 1), ("g", "a", "failed", 2), ("g", "b", "failed", 1), ("g", "b", "completed", 2), ("g", "c", "running", 1)]
    df = spark.createDataFrame(rows, "generation string, sample string, status string, ts int")
    expected = {"a": "completed", "b": "completed", "c": "running"}
    keys = ["generation", "sample"]
    assert {r["sample"]: r.status for r in E.item_states(df, keys).collect()} == expected
    folder = str(tmp_path / "events")
    df.coalesce(1).write.parquet(folder)
    stream = E.item_states(spark.readStream.schema(df.schema).parquet(folder), keys)
    stream.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start().awaitTermination()
    assert {r["sample"]: r.status for r in spark.table("states").collect()} == expected


def test_expire_and_windows(spark):
    t = dt.datetime(2024, 1, 1, 12)
    items = spark.createDataFrame([("a", "claimed", None), ("b", "running", t), ("c", "completed", t), ("d", "claimed", t + dt.timedelta(hours=2))], "s string, status string, claimed_at timestamp")
    now = F.lit(t + dt.timedelta(hours=2))
    assert [r.status for r in E.expire(items, now).orderBy("s").collect()] == ["pending", "pending", "completed", "claimed"]
    assert E.expire(items, now, 0) is items
    events = spark.createDataFrame([(t,), (t + dt.timedelta(minutes=1),), (t + dt.timedelta(minutes=30),)], "ts timestamp")
    assert sorted(r.n for r in E.sessions(events, "ts", "1 hour", "5 minutes").collect()) == [1, 2]
    assert sorted(r.n for r in E.windowed(events, "ts", "1 hour", "10 minutes", None).collect()) == [1, 2]


def test_paths_below_their_root():
    from lumenframe.sources.registry import under_root_errors

    assert not under_root_errors("/d/a/b", "/d/a/", "x") and not under_root_errors("/d/a", "/d/a", "x")
    assert under_root_errors("/d/ab", "/d/a", "x") and under_root_errors("/d/a/../c", "/d/a", "x")
