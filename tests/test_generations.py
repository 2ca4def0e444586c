"""Catalog tables and the states of generations."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import generations as G

def now():
    return F.to_timestamp(F.lit("2024-01-01T10:00:00Z"))


def items(spark, rows):
    return G.conform(spark.createDataFrame(rows, "generation_id string, sample_id string, status string"), "asset_items")


def test_tables(spark):
    assert G.keys("asset_items") == ["generation_id", "sample_id"] and len(G.schema("assets")) == 16
    assert all(G.empty(spark, t).count() == 0 for t in G.TABLES)
    row = G.conform(spark.createDataFrame([("g", "s")], "generation_id string, sample_id string"), "asset_items").first()
    assert row.status == "pending" and row.error is None
    with pytest.raises(Exception, match="must not be null"):
        G.conform(spark.createDataFrame([(None, "s")], "generation_id string, sample_id string"), "asset_items").collect()
    with pytest.raises(ValueError, match="no columns"):
        G.conform(spark.createDataFrame([(1,)], "other int"), "asset_items")


def test_decide_and_stale(spark):
    assets = G.conform(spark.createDataFrame([("a1", "d", "k", "h1", "2024"), ("a0", "d", "k", None, "2024")], "asset_id string, dataset_id string, kind string, derivation_hash string, created_at string"), "assets")
    made = [("g1", "h1", "RUNNING", "09:59"), ("g2", "h2", "PENDING", "08:30"), ("g3", "h3", "RUNNING", "07:59"), ("g4", "h4", "FAILED", "09:59")]
    gens = spark.createDataFrame([(g, "d", "k", h, s, "o", "2024", f"2024-01-01T{t}:00Z") for g, h, s, t in made], "generation_id string, dataset_id string, kind string, derivation_hash string, state string, owner_id string, created_at string, updated_at string")
    gens = G.conform(gens, "asset_generations")
    asked = spark.createDataFrame([("d", h) for h in ("h1", "h2", "h3", "h4", None)], "dataset_id string, derivation_hash string")
    found = {r.derivation_hash: (r.action, r.asset_id, r.generation_id) for r in G.decide(asked, assets, gens, now()).collect()}
    new = ("run_new", None, None)
    assert found == {"h1": ("reuse_asset", "a1", None), "h2": ("reuse_generation", None, "g2"), "h3": new, "h4": new, None: new}
    assert {r.generation_id: r.state for r in G.fail_stale(gens, now()).collect()} == {"g1": "RUNNING", "g2": "PENDING", "g3": "FAILED", "g4": "FAILED"}
    more = G.registered(assets, spark.createDataFrame([("n1", "d", "h1"), ("n2", "d", None), ("n3", "d", "h9")], "asset_id string, dataset_id string, derivation_hash string"))
    assert {tuple(r) for r in more.collect()} == {("n1", "a1"), ("n2", "n2"), ("n3", "n3")}


def test_feed(spark):
    rows = [("g", f"s{i:03}", "pending") for i in range(50)] + [("g", f"r{i}", "running") for i in range(25)] + [("h", "x", "pending"), ("h", "y", "completed")]
    out = G.feed(items(spark, rows), "me", now()).collect()
    claimed = sorted((r.generation_id, r.sample_id) for r in out if r.status == "claimed")
    assert len(out) == len(rows) and claimed == [("g", f"s{i:03}") for i in range(5)] + [("h", "x")]
    assert all((r.claimed_by, r.claimed_at) == ("me", "2024-01-01T10:00:00.000Z") for r in out if r.status == "claimed")


def test_sync_skip_and_contract(spark):
    at = datetime.datetime(2024, 1, 1)
    have = items(spark, [("g", "a", "running"), ("g", "b", "running"), ("g", "c", "completed"), ("g", "d", "failed"), ("g", "e", "claimed"), ("g", "f", "failed"), ("k", "a", "pending")])
    jobs = [("a", "FAILED", False, 0), ("a", "FINISHED", True, 1), ("b", "PUBLISHED", False, 0), ("c", "FAILED", False, 0), ("d", "RUNNING", None, 0), ("e", "CANCELLED", None, 0), ("f", "CANCELLED", None, 0)]
    jobs = spark.createDataFrame([("g", s, state, o, at + datetime.timedelta(n)) for s, state, o, n in jobs], "generation_id string, sample_id string, job_state string, has_output boolean, submitted_at timestamp")
    got = G.sync_jobs(have, jobs)
    assert {(r.generation_id, r.sample_id): r.status for r in got.collect()} == {
        ("g", "a"): "completed", ("g", "b"): "failed", ("g", "c"): "completed", ("g", "d"): "running", ("g", "e"): "skipped", ("g", "f"): "failed", ("k", "a"): "pending",
    }
    skipped = G.skip_open(got, spark.createDataFrame([("g",), ("g",)], "generation_id string"))
    assert {r.sample_id for r in skipped.where("status = 'skipped'").collect()} == {"d", "e"} and skipped.count() == 7
    assert {tuple(r) for r in G.counters(got).collect()} == {("g", 6, 2, 2, 1), ("k", 1, 0, 0, 0)}
    arts = spark.createDataFrame([("g", "a", ["sample_id", "x", "y"]), ("g", "b", ["sample_id"]), ("g", "c", None)], "generation_id string, sample_id string, columns array<string>")
    assert {(r.sample_id, tuple(r.missing)) for r in G.missing_features(arts, ["x"]).collect()} == {("b", ("x",)), ("c", ("sample_id", "x"))}
