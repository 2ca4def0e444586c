
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import disclosure as D
from lumenframe.operators.file_search import with_mask

#: Asset kinds whose place is a folder, and those that are a file.
FOLDERS = ("image_root", "mask_root", "wsi_root", "dicom_series_root", "rt_struct_root", "rt_seg_root", "qc_visual_asset", "wsi_tile_root", "registration_root")
FILES = ("feature_table", "rt_dose_file", "rt_plan_file", "dose_table", "qc_table", "embedding_table", "multimodal_ref")
ACTIVE_JOBS = ("PENDING", "RUNNING")


# -- status and publication


def collection_status(items: DataFrame, generations: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """AGG-03: for each generation the items by status, ``not_done``, ``retrying`` and ``is_done``.

    Done is a generation with items, none of them open, and as many as expected (if that is known).
    """
    names = ("pending", "claimed", "running", "completed", "failed", "skipped")
    counts = items.groupBy("generation_id").agg(F.count("*").alias("n_total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names])
    out = generations.select("generation_id", "expected_n").join(counts, "generation_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_total", *[f"n_{s}" for s in names])})
    open_ = F.col("n_pending") + F.col("n_claimed") + F.col("n_running")
    out = out.withColumn("not_done", open_).withColumn("is_done", (open_ == 0) & (F.col("n_total") > 0) & (F.col("n_total") >= F.coalesce("expected_n", F.lit(0))))
    if jobs is None:
        return out.withColumn("retrying", F.lit(0).cast("long"))
    again = jobs.where("job_state = 'PENDING' and retry_count > 0").groupBy("generation_id").agg(F.count("*").alias("retrying"))
    return out.join(again, "generation_id", "left").withColumn("retrying", F.coalesce("retrying", F.lit(0).cast("long")))


def publish_decisions(status: DataFrame, most_failed: float = 0.05, allow_partial: bool = False) -> DataFrame:
    """AGG-05, AGG-06, MTH-08: ``decision`` publish, partial (fewer completed than expected) or blocked (too large a share failed), and ``failed_pct``.

    ``status``: generation_id, expected_n, n_total, n_completed, n_failed. An unknown expectation is met.
    """
    share = F.when(F.col("n_total") > 0, F.col("n_failed") / F.col("n_total")).otherwise(0.0)
    blocked = (share > most_failed) & F.lit(not allow_partial)
    decision = F.when(blocked, "blocked").when(F.col("n_completed") < F.col("expected_n"), "partial").otherwise("publish")
    return status.select("generation_id", decision.alias("decision"), F.round(share * 100, 1).alias("failed_pct"))


def mask_validation(items: DataFrame, files: DataFrame, profile: str = "clinical_default") -> DataFrame:
    """AGG-07: for each generation how many items have a mask, lack one or failed, and whether all are valid (also without items).

    ``items``: generation_id, sample_id, status, artifact_relpath; ``files``: path. Counts pass the disclosure profile.
    """
    done = items.where("status = 'completed' and artifact_relpath <> ''")
    found = with_mask(done.select("generation_id", F.col("artifact_relpath").alias("artifact_path")), files)
    marks = lambda rows, *values: rows.select("generation_id", *[F.coalesce(v, F.lit(False)).cast("int").alias(c) for c, v in zip(("t", "o", "f", "v"), values, strict=True)])
    yes, no = F.lit(True), F.lit(False)
    each = marks(items, yes, F.col("status") != "failed", F.col("status") == "failed", no).unionAll(marks(found, no, no, no, yes))
    total = each.groupBy("generation_id").agg(*[F.sum(c).alias(c) for c in ("t", "o", "f", "v")])
    out = total.select("generation_id", F.col("t").alias("total"), F.col("v").alias("n_valid"), (F.col("o") - F.col("v")).alias("n_missing"), F.col("f").alias("n_failed"))
    shown = [D.safe_count(F.col(c), profile).alias(c) for c in ("total", "n_valid", "n_missing", "n_failed")]
    return out.select("generation_id", (F.col("n_valid") == F.col("total")).alias("valid"), (F.col("n_missing") > 0).alias("needs_regeneration"), *shown)


def requeue_orphans(items: DataFrame, generations: DataFrame, jobs: DataFrame, message: str = "job is gone") -> tuple[DataFrame, DataFrame]:
    """JN-19: running items without an active job are pending again, with a note, and their generations RUNNING."""
    on = ["generation_id", "sample_id"]
    active = jobs.where(F.col("job_state").isin(*ACTIVE_JOBS)).select(*on).distinct()
    # each row by its own status: rows of one item may differ in it
    running = F.col("status").eqNullSafe("running")
    lost = items.where(running).select(*on).join(active, on, "left_anti")
    seen = items.where(running).join(active.withColumn("_held", F.lit(True)), on, "left")
    new = {"status": F.lit("pending"), "error": F.lit(message)}
    seen = seen.select(*[F.when(F.col("_held").isNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])
    back = items.where(~running).unionByName(seen)
    touched = lost.select("generation_id").distinct().withColumn("_lost", F.lit(True))
    state = F.when(F.col("_lost"), "RUNNING").otherwise(F.col("state")).alias("state")
    return back, generations.join(touched, "generation_id", "left").select(*[state if c == "state" else F.col(c) for c in generations.columns])


def requeue_invalid(items: DataFrame, missing: DataFrame) -> DataFrame:
    """STM-13: completed items whose artifact lacks a selected feature (``missing``: generation_id, sample_id, missing) are pending again."""
    on = ["generation_id", "sample_id"]
    out = items.join(missing.select(*on, "missing").dropDuplicates(on), on, "left")
    bad = F.col("missing").isNotNull() & (F.col("status") == "completed")
    new = {"status": F.lit("pending"), "artifact_relpath": F.lit(None).cast("string"), "error": F.concat(F.lit("missing features: "), F.array_join("missing", ", "))}
    return out.select(*[F.when(bad, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])


def cancel(generations: DataFrame, items: DataFrame, ids: list[str], key: str | None, admin_key: str) -> tuple[DataFrame, DataFrame]:
    """STM-14: cancels generations and skips their open items; needs the admin key, and an ACTIVE generation stays as it is."""
    if not admin_key or key != admin_key:
        raise PermissionError("cancelling needs the admin key")
    hit = F.col("generation_id").isin(ids) & (F.col("state") != "ACTIVE")
    gone = generations.where(hit).select("generation_id", F.lit(True).alias("_gone"))
    state = F.when(hit, "CANCELLED").otherwise(F.col("state")).alias("state")
    status = F.when(F.col("_gone") & F.col("status").isin("pending", "claimed", "running"), "skipped").otherwise(F.col("status")).alias("status")
    left = items.join(gone, "generation_id", "left").select(*[status if c == "status" else F.col(c) for c in items.columns])
    return generations.select(*[state if c == "state" else F.col(c) for c in generations.columns]), left


# -- projections and unions


def contract(features: DataFrame, selected: list[str], sample_id: str | None = None) -> DataFrame:
    """PRJ-02, PRJ-03: sample_id and the selected features, nothing else; missing ones are an error that names them and the sample."""
    missing = [c for c in selected if c not in features.columns]
    if missing:
        raise ValueError(f"Selected feature(s) missing for {sample_id or 'the table'}: {', '.join(missing)}")
    first = [F.col("sample_id")] if "sample_id" in features.columns else [F.lit(sample_id).alias("sample_id")]
    return features.select(*first, *[c for c in selected if c != "sample_id"])


def collection_features(parts: dict[str, DataFrame], selected: list[str] | None = None) -> DataFrame:
    """SET-02, SNK-02: the feature tables of all samples in one; with ``selected`` exactly these, else all columns in first-seen order."""
    frames = [contract(df, selected, s) if selected else (df if "sample_id" in df.columns else df.select(F.lit(s).alias("sample_id"), "*")) for s, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def make_names(names: list[str]) -> list[str]:
    """PRJ-04: syntactic and unique names: odd characters become dots, a bad start gets an X, reserved words a dot, repeats a number."""
    #: Reserved words.
    reserved = {"if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_character_", "NA_complex_", "in"}
    plain = []
    for n in names:
        if not re.match(r"[^\W\d_]|\.(?!\d)", n):
            n = "X" + n
        n = re.sub(r"[^\w.]", ".", n)
        plain.append(n + "." if n in reserved else n)
    taken, out, counts = set(plain), [], {}
    seen: set[str] = set()
    for n in plain:
        if n in seen:
            k = counts.get(n, 0) + 1
            while f"{n}.{k}" in taken:
                k += 1
            counts[n] = k
            taken.add(f"{n}.{k}")
            out.append(f"{n}.{k}")
        else:
            seen.add(n)
            out.append(n)
    return out


def syntactic(df: DataFrame) -> DataFrame:
    """PRJ-04 for a table."""
    return df.toDF(*make_names(df.columns))


def compact(summary: Column) -> Column:
    """PRJ-06: a summary (map of strings) without its bulky parts."""
    return F.map_filter(summary, lambda k, _: ~k.isin("columns", "samples", "images"))


def output_metadata(summaries: DataFrame, most: int = 20) -> DataFrame:
    """PRJ-06, LIM-05: (file, summary) of at most ``most`` summary or manifest files, the first by name. ``summaries``: file, summary (map)."""
    found = summaries.where(F.col("file").rlike(r"(summary|manifest)\.json$")).orderBy("file").limit(most)
    return found.select("file", compact(F.col("summary")).alias("summary"))


def features_only(df: DataFrame) -> DataFrame:
    """PRJ-07: without diagnostics; every other column but sample_id a number where all its values are, else a string."""
    kept = [c for c in df.columns if not c.startswith("diagnostics")]
    texts = [f.name for f in df.schema.fields if f.name in kept and f.name != "sample_id" and f.dataType.simpleString() == "string"]
    if texts:
        odd = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first()
        texts = [c for c in texts if not odd[c]]
    return df.select(*[F.col(c).cast("double").alias(c) if c in texts else F.col(c) for c in kept])


def column_union(tables: DataFrame) -> DataFrame:
    """AGG-17: (columns): all names of ``tables`` (position, columns array) in first-seen order."""
    each = tables.select("position", F.posexplode("columns").alias("i", "name"))
    first = each.groupBy("name").agg(F.min(F.struct("position", "i")).alias("at"))
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("columns"))


# -- lists and lookups


def listed(rows: DataFrame, **equal) -> DataFrame:
    """FLT-01, FLT-02, FLT-04: rows that meet every given equality, newest first; None and the empty string are no filter."""
    for name, value in equal.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("created_at"), *[c for c in ("asset_id", "generation_id", "sample_id") if c in rows.columns]) if "created_at" in rows.columns else rows


def assets_of(assets: DataFrame, dataset_id: str, kind: str | None = None, include_inactive: bool = False) -> DataFrame:
    """FLT-01, PRJ-08: a data set's assets without their place and description; only active ones unless asked otherwise."""
    return listed(assets, dataset_id=dataset_id, kind=kind, status=None if include_inactive else "active").drop("path_or_root", "description")


def point(rows: DataFrame, **key):
    """FLT-03: the one row of a key, or None."""
    found = listed(rows.drop("created_at") if "created_at" in rows.columns and not key else rows, **key).limit(1).collect()
    return found[0] if found else None


def tagged(jobs: DataFrame, generation_id: str) -> DataFrame:
    """FLT-08: jobs with the generation among their comma-joined tags (as a whole tag)."""
    return jobs.where(F.array_contains(F.transform(F.split("tags", ","), lambda x: F.trim(x)), generation_id))


def first_tagged(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """JN-17: (job_id, sample_id): of a job's tags that are samples the one that comes first in the items' order (``position``)."""
    tags = jobs.select("job_id", F.explode(F.split("tags", ",")).alias("_t")).select("job_id", F.trim("_t").alias("sample_id"))
    return tags.join(items.select("sample_id", "position"), "sample_id").groupBy("job_id").agg(F.min_by("sample_id", F.struct("position", "sample_id")).alias("sample_id"))


def masks_listed(generations: DataFrame, dataset_id: str, profile: str = "clinical_default", states: tuple[str, ...] = ("PUBLISHED", "ACTIVE")) -> DataFrame:
    """FLT-07, DSC-08: finished segmentations of a data set with the number of valid masks under the disclosure profile; complete ones only."""
    spec = lambda k: F.get_json_object("spec_json", f"$.{k}")
    rows = generations.where((F.col("dataset_id") == dataset_id) & F.col("kind").like("%seg%") & F.col("state").isin(*states))
    rows = rows.where(F.coalesce("completed_n", F.lit(0)) >= F.coalesce("expected_n", F.lit(0)))
    n = D.safe_count(F.coalesce("completed_n", F.lit(0)), profile)
    return rows.select(F.col("generation_id").alias("alias"), F.coalesce(spec("processor"), spec("segmenter"), F.lit("unknown")).alias("provider"), F.lit("ready").alias("status"), n.alias("n_valid"), F.col("created_at").cast("string").alias("created_at"))


def labels_listed(spark: SparkSession, manifest: dict) -> DataFrame:
    """DSC-08: a manifest's label sets."""
    rows = [(x.get("name"), x.get("type"), ", ".join(x.get("columns") or []), x.get("description")) for x in manifest.get("labels") or []]
    return spark.createDataFrame(rows, "name string, type string, columns string, description string")


def assets_listed(spark: SparkSession, manifest: dict) -> DataFrame:
    """DSC-08: a manifest's assets by name and kind."""
    rows = [(n, a.get("kind") or a.get("type") or "unknown") for n, a in (manifest.get("assets") or {}).items()]
    return spark.createDataFrame(rows, "name string, type string")


def datasets_listed(spark: SparkSession, datasets: dict, manifest_of) -> DataFrame:
    """DSC-08: the enabled data sets; one whose manifest cannot be read has a placeholder for a title."""
    rows = []
    for name in datasets:
        try:
            m = manifest_of(name)
            rows.append((name, m.get("title") or "(untitled)", m.get("modality") or "unknown", True))
        except Exception:  # noqa: BLE001 - whatever is wrong with one manifest, the others are listed
            rows.append((name, "(error reading manifest)", "unknown", True))
    return spark.createDataFrame(rows, "dataset_id string, title string, modality string, enabled boolean")


def filter_threshold(options: dict) -> int:
    """DSC-05: the smallest number of rows that may be shown; the first of these options that is set, else 3."""
    for name in ("dsimaging.nfilter.subset", "default.dsimaging.nfilter.subset", "nfilter.subset", "default.nfilter.subset"):
        if options.get(name) is not None:
            return int(options[name])
    return 3


def metadata_summary(manifest: dict, metadata: DataFrame | None, profile: str = "clinical_default") -> dict:
    """DSC-07: what may be told about a data set; its number of samples passes the disclosure profile."""
    n = None
    if metadata is not None:
        n = metadata.agg(D.safe_count(F.count("*"), profile).alias("n")).first()["n"]
    meta = manifest.get("metadata") or {}
    return {
        "dataset_id": manifest.get("dataset_id"), "title": manifest.get("title") or "(untitled)", "modality": manifest.get("modality") or "unknown",
        "task_types": manifest.get("task_types") or [], "templates": manifest.get("compatible_templates") or [], "n_samples": n,
        "columns": None if metadata is None else metadata.columns, "id_col": meta.get("id_col"), "label_col": meta.get("label_col"),
        "n_assets": len(manifest.get("assets") or {}), "n_samples_sufficient": n is not None and n > 0,
    }


def safe_levels(df: DataFrame, column: str, most: int = 40, share: float = 0.33) -> DataFrame:
    """DSC-03: (levels): the sorted levels of a column, null where there are too many of them, as such or for the rows; counted before they are gathered."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    n = df.agg(F.count("*").alias("n"))
    few = counts.limit(most + 1).agg(F.array_sort(F.collect_list(column)).alias("levels"))
    released = (F.size("levels") <= most) & (F.size("levels") <= share * F.col("n"))
    return few.join(F.broadcast(n)).select(F.when(released, F.col("levels")).alias("levels"))


# -- existence


def asset_status(assets: DataFrame, files: DataFrame) -> DataFrame:
    """FLT-13: ``assets`` (name, kind, uri) with ``exists``: a folder holds a listed file, a file is listed; an empty place does not exist.

    Kinds that have no place are left out. Listed files (path) meet assets through their folders by equality.
    """
    known = assets.where(F.col("kind").isin(*FOLDERS, *FILES, "metadata"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = files.select(F.explode(above).alias("_place")).distinct().withColumn("_folder", F.lit(True))
    listed_files = files.select(F.col("path").alias("_place"), F.lit(False).alias("_folder")).distinct()
    place = F.regexp_replace(F.coalesce("uri", F.lit("")), "/$", "")
    rows = known.withColumn("_place", place).withColumn("_folder", F.col("kind").isin(*FOLDERS))
    hit = folders.unionByName(listed_files).withColumn("_hit", F.lit(True))
    return rows.join(hit, ["_place", "_folder"], "left").select("name", "kind", "uri", (F.col("_hit").isNotNull() & (F.col("_place") != "")).alias("exists"))


def validate_dataset(spark: SparkSession, manifest: dict, files: DataFrame, structure) -> dict:
    """FLT-13: ``{valid, errors, warnings, asset_status}``; faults of the structure (``structure(manifest)`` raises) end the check."""
    try:
        structure(manifest)
    except ValueError as e:
        return {"valid": False, "errors": [str(e)], "warnings": [], "asset_status": {}}
    meta = manifest.get("metadata") or {}
    rows = [(n, a.get("kind") or a.get("type") or "unknown", a.get("uri") or a.get("root") or a.get("file") or a.get("manifest")) for n, a in (manifest.get("assets") or {}).items()]
    rows.append(("_metadata", "metadata", meta.get("uri") or meta.get("file")))
    status = {r["name"]: r.asDict() for r in asset_status(spark.createDataFrame(rows, "name string, kind string, uri string"), files).collect()}
    errors = [f"Asset '{n}' not found: {s['uri'] or '(unknown)'}" for n, s in sorted(status.items()) if not s["exists"]]
    warnings = [] if manifest.get("compatible_templates") else ["No compatible_templates specified in manifest."]
    return {"valid": not errors, "errors": errors, "warnings": warnings, "asset_status": status}
