"""

Every function maps whole tables to whole tables: many generations are advanced in one job, none of them by a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The catalog's tables, their keys, and the values that missing ones take.
TABLES = {
    "assets": "asset_id STRING NOT NULL, dataset_id STRING NOT NULL, kind STRING NOT NULL, modality STRING, status STRING NOT NULL, visibility STRING NOT NULL, storage_backend STRING NOT NULL, derivation_hash STRING, created_at STRING NOT NULL, created_by STRING, created_by_job STRING, path_or_root STRING, description STRING, manifest_json STRING, provenance_json STRING, tags STRING",
    "asset_parents": "asset_id STRING NOT NULL, parent_asset_id STRING NOT NULL, relationship STRING NOT NULL",
    "asset_aliases": "dataset_id STRING NOT NULL, alias STRING NOT NULL, asset_id STRING NOT NULL, updated_at STRING NOT NULL",
    "asset_generations": "generation_id STRING NOT NULL, dataset_id STRING NOT NULL, kind STRING NOT NULL, derivation_hash STRING NOT NULL, visibility STRING NOT NULL, state STRING NOT NULL, owner_id STRING NOT NULL, created_by_job STRING, expected_n BIGINT, completed_n BIGINT, failed_n BIGINT, published_asset_id STRING, spec_json STRING, error STRING, created_at STRING NOT NULL, updated_at STRING NOT NULL",
    "asset_items": "generation_id STRING NOT NULL, sample_id STRING NOT NULL, status STRING NOT NULL, claimed_by STRING, claimed_at STRING, artifact_relpath STRING, checksum STRING, error STRING",
    "sample_manifests": "dataset_id STRING NOT NULL, sample_id STRING NOT NULL, source_kind STRING NOT NULL, manifest_json STRING NOT NULL, content_hash STRING, created_at STRING NOT NULL, updated_at STRING NOT NULL",
    "content_fingerprints": "dataset_id STRING NOT NULL, sample_id STRING NOT NULL, file_path STRING NOT NULL, fingerprint STRING NOT NULL, content_hash STRING, file_size BIGINT NOT NULL, file_mtime DOUBLE NOT NULL, computed_at STRING NOT NULL",
    "resource_content_hashes": "resource_name STRING NOT NULL, content_hash STRING NOT NULL, updated_at STRING NOT NULL, source STRING NOT NULL, bucket STRING, object_key STRING",
}
KEYS = {
    "assets": ["asset_id"], "asset_parents": ["asset_id", "parent_asset_id"], "asset_aliases": ["dataset_id", "alias"], "asset_generations": ["generation_id"],
    "asset_items": ["generation_id", "sample_id"], "sample_manifests": ["dataset_id", "sample_id"], "content_fingerprints": ["dataset_id", "sample_id"], "resource_content_hashes": ["resource_name"],
}
DEFAULTS = {
    "assets": {"status": "active", "visibility": "global", "storage_backend": "file"},
    "asset_parents": {"relationship": "derived_from"},
    "asset_generations": {"visibility": "private", "state": "PENDING", "completed_n": 0, "failed_n": 0},
    "asset_items": {"status": "pending"},
    "sample_manifests": {"source_kind": "single_file"},
}
LIVE, OPEN_ITEMS = ("PENDING", "RUNNING"), ("pending", "claimed", "running")
#: Which status an item takes from the state of its job.
FROM_JOB = {"FINISHED": "completed", "PUBLISHED": "completed", "FAILED": "failed", "CANCELLED": "skipped", "PENDING": "running", "RUNNING": "running"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def keys(table: str) -> list[str]:
    return KEYS[table]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the table's columns in order: missing ones null, defaults filled in. A required value that is null fails the job."""
    fields, defaults = schema(table).fields, DEFAULTS.get(table, {})
    unknown = [c for c in rows.columns if c not in {f.name for f in fields}]
    if unknown:
        raise ValueError(f"{table} has no columns {', '.join(unknown)}")
    out = []
    for f in fields:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        elif not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"{table}.{f.name} must not be null")).cast(f.dataType))
        out.append(c.alias(f.name))
    return rows.select(*out)


def registered(assets: DataFrame, new: DataFrame) -> DataFrame:
    """UPS-04: (row of ``new``'s asset_id, registered_id): an active asset with the same data set and derivation hash stands for it; a null hash never does."""
    held = assets.where("status = 'active' and derivation_hash is not null").groupBy("dataset_id", "derivation_hash").agg(F.min_by("asset_id", F.struct("created_at", "asset_id")).alias("_held"))
    return new.join(held, ["dataset_id", "derivation_hash"], "left").select("asset_id", F.coalesce("_held", "asset_id").alias("registered_id"))


def decide(requests: DataFrame, assets: DataFrame, generations: DataFrame, now: Column, max_age_s: int = 7200) -> DataFrame:
    """STM-12: ``requests`` (dataset_id, derivation_hash, ...) with ``action``, ``asset_id`` and ``generation_id``.

    An active asset is used again, else a live generation younger than ``max_age_s``, else ``run_new``. Ties go to the oldest.
    """
    on = ["dataset_id", "derivation_hash"]
    by_asset = assets.where("status = 'active' and derivation_hash is not null").groupBy(*on).agg(F.min_by("asset_id", F.struct("created_at", "asset_id")).alias("asset_id"))
    young = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("updated_at")) < max_age_s
    by_generation = generations.where(F.col("state").isin(*LIVE) & young).groupBy(*on).agg(F.min_by("generation_id", F.struct("created_at", "generation_id")).alias("_live"))
    action = F.when(F.col("asset_id").isNotNull(), "reuse_asset").when(F.col("_live").isNotNull(), "reuse_generation").otherwise("run_new")
    out = requests.join(by_asset, on, "left").join(by_generation, on, "left").withColumn("action", action)
    return out.withColumn("generation_id", F.when(F.col("action") == "reuse_generation", F.col("_live"))).drop("_live")


def fail_stale(generations: DataFrame, now: Column, max_age_s: int = 7200) -> DataFrame:
    """UPS-06: live generations without an update for longer than ``max_age_s`` become FAILED."""
    old = F.col("state").isin(*LIVE) & F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("updated_at")) > max_age_s, F.lit(False))
    return generations.withColumns({"state": F.when(old, "FAILED").otherwise(F.col("state")), "error": F.when(old, "no update in time").otherwise(F.col("error"))})


def feed(items: DataFrame, claimer: str, now: Column, batch: int = 10, max_in_flight: int = 30) -> DataFrame:
    """LIM-02, LIM-03, STM-11: each generation claims its first pending items by sample_id, as many as ``batch`` and its free slots allow.

    Counts are summed before the exchange; only pending items are ranked, and Spark keeps the first ``batch`` of a generation on
    each task before it exchanges them, so a generation with a third of all items does not land in one task.
    """
    active = items.groupBy("generation_id").agg(F.count_if(F.col("status").isin("claimed", "running")).alias("_active"))
    rank = F.row_number().over(Window.partitionBy("generation_id").orderBy("sample_id"))
    first = items.where("status = 'pending'").select("generation_id", "sample_id").withColumn("_rank", rank).where(F.col("_rank") <= batch)
    won = first.join(active, "generation_id").where(F.col("_rank") <= max_in_flight - F.col("_active")).select("generation_id", "sample_id", F.lit(True).alias("_won"))
    out = items.join(won, ["generation_id", "sample_id"], "left")
    new = {"status": F.lit("claimed"), "claimed_by": F.lit(claimer), "claimed_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}
    return out.select(*[F.when(F.col("_won"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])


def sync_jobs(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """STM-10: items with the status of their latest job (generation_id, sample_id, job_state, has_output, submitted_at).

    A finished job without output is a failure. Completed items stay, and a failed one changes only to completed or running.
    """
    on = ["generation_id", "sample_id"]
    latest = jobs.groupBy(*on).agg(F.max_by(F.struct("job_state", "has_output"), "submitted_at").alias("_job"))
    known = F.create_map(*[F.lit(x) for pair in FROM_JOB.items() for x in pair])
    found = F.try_element_at(known, F.col("_job.job_state"))
    found = F.when((found == "completed") & ~F.coalesce("_job.has_output", F.lit(False)), "failed").otherwise(found)
    may = F.col("status").isin(*OPEN_ITEMS) | ((F.col("status") == "failed") & found.isin("completed", "running"))
    out = items.join(latest, on, "left")
    return out.select(*[F.when(may & found.isNotNull(), found).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in items.columns])


def skip_open(items: DataFrame, cancelled: DataFrame) -> DataFrame:
    """STM-14: items of cancelled generations that have not ended are skipped."""
    out = items.join(cancelled.select("generation_id", F.lit(True).alias("_gone")).distinct(), "generation_id", "left")
    status = F.when(F.col("_gone") & F.col("status").isin(*OPEN_ITEMS), "skipped").otherwise(F.col("status"))
    return out.select(*[status.alias(c) if c == "status" else F.col(c) for c in items.columns])


def missing_features(artifacts: DataFrame, selected: list[str]) -> DataFrame:
    """STM-13: (keys and ``missing``) of artifacts (generation_id, sample_id, columns array) that lack a selected feature."""
    lack = F.array_except(F.array(*[F.lit(x) for x in ["sample_id", *selected]]), F.coalesce("columns", F.array().cast("array<string>")))
    return artifacts.select("generation_id", "sample_id", lack.alias("missing")).where(F.size("missing") > 0)


def counters(items: DataFrame) -> DataFrame:
    """AGG-02: for each generation how many items have each end, in one pass."""
    return items.groupBy("generation_id").agg(F.count("*").alias("n_total"), *[F.count_if(F.col("status") == s).alias(f"{s}_n") for s in ("completed", "failed", "skipped")])
