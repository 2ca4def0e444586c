"""Operators that have no SQL: sinks, resources, hashes, workflows, decisions, against plain versions and values worked out by hand."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import hashing as H
from lumenframe.functions import scalars as S
from lumenframe.operators import file_search as FS
from lumenframe.operators import publishing as P
from lumenframe.operators import relational as R
from lumenframe.operators import statistics as ST
from lumenframe.operators import voxels as V
from lumenframe.plans import workflows as W
from lumenframe.sources import files as FI
from lumenframe.sources import resources as RS
from lumenframe.sources import sinks as SK


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# -- hashes


def test_derivation_hash_is_of_sorted_json():
    plain = '{"a":1,"b":"x","c":[1.5,null,true]}'
    assert H.derivation_hash(c=[1.5, None, True], b="x", a=1) == hashlib.sha256(plain.encode()).hexdigest()
    assert H.derivation_hash(a=1) != H.derivation_hash(a=2) and H.canonical_json({"x": 1 / 3}) == '{"x":0.3333333333}'


def test_requests_round_trip(spark):
    for value in ({"a": "ü/+?>", "n": [1, 2, None]}, {"x": "???>>>~~~"}, [], "plain"):
        text = H.encode_request(value)
        assert text.startswith("B64:") and "=" not in text and "/" not in text[4:] and H.decode_request(text) == value
        assert json.loads(one(spark, H.decoded(F.lit(text)))) == value
    assert H.decode_request('{"a": 1}') == {"a": 1} and H.decode_request("no json") == "no json"


def test_fast_fingerprint(spark, tmp_path):
    rows, want = [], {}
    for i, size in enumerate((0, 10, 4096, 4097, 9000)):
        data, mtime = bytes(j % 251 for j in range(size)), 1_700_000_000.125 + i
        rows.append((str(i), size, mtime, bytearray(data)))
        want[str(i)] = hashlib.sha256(struct.pack(">Q", size) + struct.pack(">d", mtime) + data[:4096] + (data[-4096:] if size > 4096 else b"")).hexdigest()
    got = H.fingerprints(spark.createDataFrame(rows, "path string, length long, mtime double, content binary"))
    assert {r.path: r.fingerprint for r in got.collect()} == want


def test_collection_hash_of_nulls_and_one_group(spark):
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", None), (None, "é")], "g string, v string")
    want = lambda v: hashlib.sha256(('{"image_hashes":' + v + "}").encode()).hexdigest()
    assert {(r.g, r.n, r.collection_hash) for r in H.collection_hashes(rows, "g", "v").collect()} == {("a", 2, want('["1","2"]')), (None, 1, want('["é"]'))}


def test_job_resources(spark):
    job = {"label": "l", "image_asset": "img", "steps": [{"resource": {"name": "r1", "x": {"mask_asset": "m"}}}, {"dataset_id": "img"}, {"mask_asset": ""}]}
    assert H.resource_names(job) == ["img", "r1", "m"]
    known = spark.createDataFrame([("img", "h1", "stream", "t"), ("r1", "h2", "unsupported", "t"), ("m", None, "stream", "t")], "resource_name string, content_hash string, source string, updated_at string")
    out = W.with_hashes(job, known)
    assert list(out["content_hashes"]) == ["img"] and "resource_hashes" not in out["steps"][0] and out["steps"][1]["resource_hashes"]["img"]["content_hash"] == "h1"
    with pytest.raises(ValueError):
        W.with_hashes({"label": ""}, known)


# -- scalars


def test_scalars(spark):
    assert one(spark, S.is_transient(F.lit("Database is BUSY now"))) and not one(spark, S.is_transient(F.lit("timeout"))) and not one(spark, S.is_transient(F.lit(None).cast("string")))
    assert one(spark, S.file_time(F.lit(1_700_000_000.9))) == "2023-11-14T22:13:20Z"
    assert one(spark, S.items_of(F.lit(" a, ,b,"))) == ["a", "b"] and one(spark, S.items_of(F.lit("a;b"), "[,;]")) == ["a", "b"]
    assert [one(spark, S.flag_of(F.lit(x))) for x in (" Yes", "0", "")] == [True, False, False] and one(spark, S.number_of(F.lit("x"), 2.0)) == 2.0
    assert one(spark, S.speaks_of_mask(F.lit("/a/x1_GTV.nii"), F.lit("x1"))) and not one(spark, S.speaks_of_mask(F.lit("/mask/x1.nii")))
    assert [one(spark, ST.general(F.lit(v))) for v in (0.5, 3.0, 1 / 3, 1e-5, 123456.7, 1234567.0, 0.0)] == ["%.6g" % v for v in (0.5, 3.0, 1 / 3, 1e-5, 123456.7, 1234567.0, 0.0)]


def test_config():
    c = W.Config({"X_FAST": "Yes", "X_N": "3.7", "X_BAD": "z", "X_L": "a, b,,"}, "X_")
    assert c.flag("fast") and c.whole("n") == 3 and c.whole("bad", 5) == 5 and c.items("l") == ["a", "b"] and c.items("none", ["d"]) == ["d"] and c.number("none", 1.5) == 1.5
    assert W.env_name("my-env.1") == "MY_ENV_1"


# -- sinks and sources


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, "x")], "sample_id string, Mean double, note string")
    SK.write_csv(df, f"{tmp_path}/c", ["note", "sample_id"])
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()} == {(None, "a"), ("x", "b")}
    SK.write_json(df, f"{tmp_path}/j")
    assert {r.sample_id: r.note for r in spark.read.json(f"{tmp_path}/j").collect()} == {"a": None, "b": "x"}
    SK.write_summary(spark, {"n": 2, "x": {"y": 1}}, f"{tmp_path}/s.json")
    SK.write_summary(spark, {"n": 3}, f"{tmp_path}/s.json")
    assert (tmp_path / "s.json").read_text() == '{\n  "n": 3\n}\n'
    path = SK.write_collection({"a": df.drop("note"), "c": spark.createDataFrame([(2.0, 9)], "Mean double, Other int")}, str(tmp_path), ["Mean"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1.5), ("b", None), ("c", 2.0)}
    SK.write_registry(spark, f"{tmp_path}/r.json", "d", {"manifest_uri": "m", "region": None})
    assert SK.write_registry(spark, f"{tmp_path}/r.json", "d", {"region": "eu"})["datasets"] == {"d": {"manifest_uri": "m", "region": "eu"}}
    SK.write_credential(spark, f"{tmp_path}/k.json", "main", "i", "s")
    assert (tmp_path / "k.json").stat().st_mode & 0o777 == 0o600
    model = {"name": "m1", "provider": "lungmask"}
    assert SK.write_model(spark, str(tmp_path), model) and not SK.write_model(spark, str(tmp_path), model) and SK.write_model(spark, str(tmp_path), model, True)
    assert SK.write_runners(spark, f"{tmp_path}/run", {"mask_ops": {"timeout_secs": 1}}) == ["mask_ops"] and json.loads((tmp_path / "run" / "mask_ops.yml").read_text())["name"] == "mask_ops"
    first = SK.place_once(spark, f"{tmp_path}/kept", {"a/b.py": "1", "c.py": "2"})
    assert first == SK.place_once(spark, f"{tmp_path}/kept", {"c.py": "2", "a/b.py": "1"}) and first != SK.place_once(spark, f"{tmp_path}/kept", {"c.py": "3"})


def test_folders_are_copied_and_listed(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "s1.nii.gz").write_bytes(b"1")
    (tmp_path / "in" / "s2.csv").write_bytes(b"22")
    files = spark.createDataFrame([(f"{tmp_path}/in/x/s1.nii.gz",), (f"{tmp_path}/in/s2.csv",)], "path string")
    assert sorted(r["bytes"] for r in SK.put_files(files, f"{tmp_path}/in", f"{tmp_path}/out").collect()) == [1, 2]
    assert (tmp_path / "out" / "x" / "s1.nii.gz").read_bytes() == b"1"
    RS.register_source(spark)
    rows = spark.read.format("imaging").option("path", f"{tmp_path}/out").load().collect()
    assert {(r.sample_id, r.length) for r in rows} == {("s1", 1), ("s2", 2)}
    one_, two = (SK.folder_signature(spark.createDataFrame(x, "rel string, hash string")).first()[0] for x in ([("a", "1"), ("b", "2")], [("b", "2"), ("a", "1")]))
    assert one_ == two == hashlib.sha256(b"a=1\nb=2").hexdigest()


def test_hash_index_of_another_kind_is_empty(spark, tmp_path):
    (tmp_path / "i.parquet").write_text("no parquet")
    assert FI.read_hash_index(spark, f"{tmp_path}/i.parquet").count() == 0 and FI.read_hash_index(spark, f"{tmp_path}/none").columns[0] == "sample_id"


URLS = {
    "imaging+dataset://ds?endpoint=http%3A%2F%2Fh%3A9&bucket=b&prefix=p/q": ("ds", "http://h:9", "b", "p/q", "", True),
    "imaging+dataset://ds?region=eu": ("ds", "", "imaging-data", "datasets/ds", "eu", True),
    "imaging+dataset://minio:9000/b/datasets/c1/": ("c1", "http://minio:9000", "b", "datasets/c1/", "", True),
    "imaging+dataset://s3.host.org/b/c@eu-west-1": ("c", "https://s3.host.org", "b", "c", "eu-west-1", True),
    "imaging+dataset://s3.host.org/b": ("", "https://s3.host.org", "b", "", "us-east-1", True),
    "imaging+dataset://only": ("only", None, None, None, None, False),
}


@pytest.mark.parametrize("url", URLS)
def test_resource_urls(spark, url):
    want = URLS[url]
    p = RS.parse_url(url)
    assert (p["dataset_id"], *[p["params"].get(k) for k in ("endpoint", "bucket", "prefix", "region")], p["s3"]) == want
    assert tuple(one(spark, RS.parsed_url(F.lit(url)))) == tuple("" if x is None else x for x in want)


def test_resource_client():
    assert RS.resource_url("imaging-aws", {"region": "eu", "bucket": "b", "collection": "c"}) == "imaging+dataset://s3.eu.amazonaws.com/b/c@eu" and RS.resource_url("x", {}) is None
    own = RS.client("imaging+dataset://minio/b/c", {"access_key": "k"}, lambda d: {"access_key": "registry"})
    assert own["access_key"] == "k" and own["manifest_uri"] == "s3://b/c/manifest.yaml" and RS.is_for("imaging+dataset://x") and not RS.is_for("s3://x")
    assert RS.client("imaging+dataset://d", None, lambda d: {"manifest_uri": f"/m/{d}"}) == {"manifest_uri": "/m/d", "dataset_id": "d"}
    with pytest.raises(ValueError):
        RS.client("http://x")


def test_lazy_look_up(spark):
    schema = "resource_name string, content_hash string, source string, bucket string, object_key string"
    index = spark.createDataFrame([("a", "1", "stream", "b", "k")], schema)
    located = spark.createDataFrame([("b", "2", "etag_md5", "b", "k2"), ("a", "9", "stream", "b", "k")], schema)
    answers, new = RS.look_up(spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "resource_name string"), index, located)
    assert {tuple(r) for r in answers.collect()} == {("a", "1", "stream"), ("b", "2", "etag_md5"), ("c", None, "unsupported")} and [r.resource_name for r in new.collect()] == ["b"]


# -- publication


def test_publish_decisions(spark):
    rows = spark.createDataFrame([("a", 10, 10, 10, 0), ("b", 10, 9, 9, 0), ("c", None, 20, 19, 1), ("d", None, 10, 9, 1), ("e", 5, 0, 0, 0)], "generation_id string, expected_n long, n_total long, n_completed long, n_failed long")
    assert {r.generation_id: r.decision for r in P.publish_decisions(rows).collect()} == {"a": "publish", "b": "partial", "c": "publish", "d": "blocked", "e": "partial"}
    assert {r.generation_id: (r.decision, r.failed_pct) for r in P.publish_decisions(rows, allow_partial=True).collect()}["d"] == ("publish", 10.0)


def test_requeue_takes_each_row_by_its_own_status(spark):
    items = spark.createDataFrame([(1, "a", "running", None), (1, "a", "running", None), (1, "a", "completed", None), (1, "b", "running", "slow"), (1, "b", "failed", "bad"), (2, None, "running", None), (3, "c", None, None)], "generation_id int, sample_id string, status string, error string")
    jobs = spark.createDataFrame([(1, "a", "FAILED"), (1, "b", "RUNNING"), (1, "b", "RUNNING")], "generation_id int, sample_id string, job_state string")
    generations = spark.createDataFrame([(1, "PARTIAL"), (2, "PARTIAL"), (3, "PARTIAL")], "generation_id int, state string")
    back, states = P.requeue_orphans(items, generations, jobs)
    want = [(1, "a", "pending", "job is gone")] * 2 + [(1, "a", "completed", None), (1, "b", "running", "slow"), (1, "b", "failed", "bad"), (2, None, "pending", "job is gone"), (3, "c", None, None)]
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, want))
    assert {tuple(r) for r in states.collect()} == {(1, "RUNNING"), (2, "RUNNING"), (3, "PARTIAL")}


def test_cancel_needs_the_key(spark):
    g = spark.createDataFrame([("a", "ACTIVE"), ("b", "RUNNING")], "generation_id string, state string")
    i = spark.createDataFrame([("a", "1", "running"), ("b", "1", "running"), ("b", "2", "completed")], "generation_id string, sample_id string, status string")
    with pytest.raises(PermissionError):
        P.cancel(g, i, ["b"], None, "k")
    states, items = P.cancel(g, i, ["a", "b"], "k", "k")
    assert dict(map(tuple, states.collect())) == {"a": "ACTIVE", "b": "CANCELLED"} and {tuple(r) for r in items.collect()} == {("a", "1", "running"), ("b", "1", "skipped"), ("b", "2", "completed")}


def test_contract_and_names(spark):
    df = spark.createDataFrame([("s", 1.0, "x")], "sample_id string, Mean double, diagnostics_v string")
    assert P.contract(df, ["Mean"]).columns == ["sample_id", "Mean"]
    with pytest.raises(ValueError, match="Std, Max"):
        P.contract(df, ["Std", "Mean", "Max"], "s")
    assert P.make_names(["a b", "1x", "if", "a.b", "_q", ".1", "", "a b"]) == ["a.b", "X1x", "if.", "a.b.1", "X_q", "X.1", "X", "a.b.2"]
    assert P.syntactic(df.toDF("a", "a", "b c")).columns == ["a", "a.1", "b.c"]
    mixed = spark.createDataFrame([("s", "1.5", "x"), ("t", None, "2")], "sample_id string, n string, t string")
    assert dict(P.features_only(mixed).dtypes) == {"sample_id": "string", "n": "double", "t": "string"} and P.features_only(df).columns == ["sample_id", "Mean"]


def test_output_metadata(spark):
    rows = spark.createDataFrame([(f"{i:02}_summary.json", {"n": "1", "columns": "x"}) for i in range(25)] + [("a.json", {})], "file string, summary map<string,string>")
    found = P.output_metadata(rows).collect()
    assert len(found) == 20 and all(r.summary == {"n": "1"} for r in found)


def test_lists(spark):
    assert P.filter_threshold({}) == 3 and P.filter_threshold({"nfilter.subset": 5, "default.dsimaging.nfilter.subset": 7}) == 7
    rows = P.datasets_listed(spark, {"a": 1, "b": 2}, lambda n: {"title": "T"} if n == "a" else {}[n]).collect()
    assert {tuple(r) for r in rows} == {("a", "T", "unknown", True), ("b", "(error reading manifest)", "unknown", True)}
    m = {"dataset_id": "d", "labels": [{"name": "l", "columns": ["x", "y"]}], "assets": {"i": {"kind": "image_root"}, "o": {}}, "metadata": {"id_col": "s"}}
    assert [tuple(r) for r in P.labels_listed(spark, m).collect()] == [("l", None, "x, y", None)] and {tuple(r) for r in P.assets_listed(spark, m).collect()} == {("i", "image_root"), ("o", "unknown")}
    told = P.metadata_summary(m, spark.range(9).toDF("s"))
    assert told["n_samples"] == 8 and told["columns"] == ["s"] and told["n_samples_sufficient"] and told["n_assets"] == 2 and not P.metadata_summary(m, None)["n_samples_sufficient"]
    jobs = spark.createDataFrame([("j", "x, g1"), ("k", "g11")], "job_id string, tags string")
    assert [r.job_id for r in P.tagged(jobs, "g1").collect()] == ["j"] and P.point(jobs, job_id="k").tags == "g11" and P.point(jobs, job_id="z") is None
    assert P.safe_levels(spark.createDataFrame([("a",), ("b",), (None,)], "v string"), "v").first()["levels"] is None


def test_validate_dataset(spark):
    files = spark.createDataFrame([("/d/i/x.nii",), ("/d/m.csv",)], "path string")

    def structure(m):
        if "dataset_id" not in m:
            raise ValueError("no id")

    assert P.validate_dataset(spark, {}, files, structure) == {"valid": False, "errors": ["no id"], "warnings": [], "asset_status": {}}
    m = {"dataset_id": "d", "metadata": {"uri": "/d/m.csv"}, "assets": {"i": {"kind": "image_root", "uri": "/d/i/"}, "g": {"kind": "mask_root", "root": "/d/none"}, "other": {"kind": "labels", "uri": "/q"}}}
    out = P.validate_dataset(spark, m, files, structure)
    assert out["errors"] == ["Asset 'g' not found: /d/none"] and len(out["warnings"]) == 1 and set(out["asset_status"]) == {"i", "g", "_metadata"}


# -- searches, joins


def test_search_ranks(spark):
    s = spark.createDataFrame([("p1",), ("p2",), ("",), (None,)], "sample_id string")
    only = spark.createDataFrame([("/r/any.nii",)], "path string")
    assert {r.sample_id: r.path for r in FS.worker_masks(s, only, "/r").collect()}["p2"] == "/r/any.nii"
    both = spark.createDataFrame([("/r/p1_label.txt",), ("/r/p1/a.nii",), ("/r/p1.nii",), ("/r/p2.mha",)], "path string")
    found = {r.sample_id: r.path for r in FS.worker_masks(s, both, "/r", spark.createDataFrame([("p2", "/r/p1.nii"), ("p1", "/gone")], "sample_id string, primary_mask string")).collect()}
    assert found == {"p1": "/r/p1_label.txt", "p2": "/r/p1.nii", "": None, None: None}
    store = spark.createDataFrame([("s3://b/m/p1_mask.nii",), ("s3://b/m/p1_seg.nii.gz",), ("s3://b/m/z/P_p2_GTV.nii",)], "path string")
    index = spark.createDataFrame([("p2", "")], "sample_id string, uri string")
    assert {r.sample_id: r.path for r in FS.sample_masks(s, store, "s3://b/m", index).collect()} == {"p1": "s3://b/m/p1_mask.nii", "p2": "s3://b/m/z/P_p2_GTV.nii", "": None, None: None}


def test_ancestors_end_in_a_circle(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "asset_id string, parent_asset_id string")
    assert {tuple(r) for r in R.ancestors(p).where("asset_id = 'd'").collect()} == {("d", "a", 1), ("d", "b", 2), ("d", "c", 3)}


# -- statistics and voxels


def test_quantiles_and_embeddings_of_odd_images(spark):
    np = pytest.importorskip("numpy")
    r = np.random.default_rng(1)
    images = {"flat": [3.0] * 5, "nan": [float("nan"), float("inf")], "skew": [*([1.0] * 98), 1e6, -1e6], "wide": r.normal(size=300).tolist(), "one": [2.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in images.items() for v in vs], "sample_id string, value double")
    q = {x.sample_id: x.q for x in ST.quantiles(rows.where(ST.finite(F.col("value"))), "sample_id", "value", [0, 0.01, 0.37, 1], 16).collect()}
    for k, vs in images.items():
        if k != "nan":
            assert np.allclose(q[k], np.percentile(vs, [0, 1, 37, 100]))
    got = {x.sample_id: x.vector for x in ST.embeddings(rows, 8).collect()}
    for k, vs in images.items():
        a = np.array([v for v in vs if np.isfinite(v)] or [0.0])
        lo, hi = np.percentile(a, [1, 99])
        lo, hi = (a.min(), a.max()) if hi <= lo else (lo, hi)
        hi = lo + 1 if hi <= lo else hi
        c = np.clip(a, lo, hi)
        v = np.concatenate([[c.mean(), c.std(), c.min(), c.max(), *np.percentile(c, [10, 50, 90]), a.size], np.histogram(c, 8, (lo, hi), density=True)[0]])
        assert np.allclose(got[k], v / np.linalg.norm(v)), k


def test_ball_and_closing_by_axis():
    assert len(V.ball(1)) == 19 and len(V.ball((0, 1, 1))) == 9 and len(V.ball(0)) == 1 and max(o[0] for o in V.ball((1, 2, 2))) == 1


def test_contours_with_a_hole(spark):
    square = lambda a, z: [{"x": float(a), "y": float(a)}, {"x": float(z), "y": float(a)}, {"x": float(z), "y": float(z)}, {"x": float(a), "y": float(z)}]
    rows = [("s", "r", i, 0, p) for i, p in enumerate((square(0.5, 6.5), square(2.5, 4.5)))]
    contours = spark.createDataFrame(rows, "source string, roi string, contour int, z int, points array<struct<x:double,y:double>>")
    got = {(r.y, r.x) for r in V.contours_to_mask(contours, spark.createDataFrame([("s", 20, 20)], "source string, n_y int, n_x int")).collect()}
    inside = lambda v, a, z: a < v < z
    assert got == {(y, x) for y in range(20) for x in range(20) if inside(x, 0.5, 6.5) and inside(y, 0.5, 6.5) and not (inside(x, 2.5, 4.5) and inside(y, 2.5, 4.5))}
    assert V.contours_to_mask(contours, spark.createDataFrame([("s", 20, 20)], "source string, n_y int, n_x int"), ["other"]).count() == 0


def test_series_takes_the_first(spark):
    files = spark.createDataFrame([("f", "2", 1.0, "a"), ("f", "1", 5.0, "b"), ("f", "1", -2.0, "c")], "folder string, series string, position double, path string")
    assert [(r.path, r.z) for r in V.series(files).orderBy("z").collect()] == [("c", 0), ("b", 1)]


# -- workflows


def test_runners_and_jobs(spark):
    assert len(W.RUNNERS) == 16 and W.segmenter_runner("lungmask") == "lungmask_infer" and W.profile_names({"own": {}})[-1] == "own"
    with pytest.raises(ValueError):
        W.segmenter_runner("x")
    with pytest.raises(ValueError):
        W.profile("a/b")
    with pytest.raises(ValueError, match="takes no color"):
        W.checked("mask_ops", {"color": 1})
    assert W.profile("ibsi_ct_3d_v1", {"ibsi_ct_3d_v1": {"x": 1}}) == {"x": 1}
    job = W.radiomics_job({"dataset_id": "d", "mask_asset": "m"})
    assert [s["type"] for s in job["steps"]] == ["resolve_dataset", "run_artifact", "publish_asset", "safe_summary"] and job["steps"][1]["config"]["mask_asset"] == "m"
    digest = job["steps"][2]["derivation_hash"]
    assert W.radiomics_job({"dataset_id": "d", "mask_asset": "m"}, lambda d, h: "asset" if h == digest else None)["action"] == "reused"
    assert W.segmentation_job({"dataset_id": "d", "segmenter": {"provider": "existing_mask_asset", "mask_asset": "m"}})["asset_id"] == "m"
    assert W.segmentation_job({"dataset_id": "d", "segmenter": {"provider": "totalsegmentator", "task": "total"}})["steps"][1]["runner"] == "totalsegmentator_infer"
    assert len(W.segment_and_extract_job({"dataset_id": "d", "segmenter": {"provider": "lungmask"}})["steps"]) == 5
    with pytest.raises(ValueError):
        W.radiomics_job({"dataset_id": "d"})

    @W.implement("imaging_qc_metrics")
    def _(inputs, config):
        return ST.image_metrics(inputs[config["image_asset"]])

    job = W.asset_job({"dataset_id": "d", "config": {"image_asset": "images"}}, "imaging_qc_metrics", "qc", "qc_table")
    out = W.run(job, {"images": spark.createDataFrame([("s", 1.0), ("s", 3.0)], "sample_id string, value double")}).first()
    assert (out.image_mean, out.image_std) == (2.0, 1.0) and {h["runner"] for h in W.health() if h["ready"]} >= {"imaging_qc_metrics"}

    @W.on_publish("k")
    def _(context):
        return {"seen": context["x"]}

    assert W.publish("k", {"x": 1}) == [{"seen": 1}]
    with pytest.raises(ValueError):
        W.publish("none", {})
    assert W.requested(H.encode_request({"a": 1})) == {"a": 1} and W.models_listed({"/m/a.json": {"name": "a"}, "/m/b.json": None}) == [{"name": "a", "provider": "unknown", "task": "segmentation", "path": "/m"}]


def test_prediction_is_by_batch(spark):
    import pandas as pd

    def load():
        return lambda f: pd.DataFrame({"sample_id": f["sample_id"], "label": (f["value"] > 1).astype("int32")})

    images = spark.createDataFrame([("a", 0.5), ("b", 2.0)], "sample_id string, value double")
    assert {tuple(r) for r in W.predicted(images, load, "sample_id string, label int").collect()} == {("a", 0), ("b", 1)}
