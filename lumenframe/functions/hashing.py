
from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes at each end of a file that enter its fast fingerprint, and bytes hashed at once.
END_BYTES, HASH_BYTES = 4096, 65536


def canonical_json(value) -> str:
    """A value as JSON with sorted keys on the first level, without spaces; numbers with at most 10 decimals."""

    def text(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            if not math.isfinite(v):
                return '"NA"' if math.isnan(v) else '"Inf"' if v > 0 else '"-Inf"'
            return (f"{v:.10f}".rstrip("0").rstrip(".")) or "0"
        if isinstance(v, dict):
            return "{" + ",".join(json.dumps(str(k), ensure_ascii=False) + ":" + text(x) for k, x in v.items()) + "}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(text, v)) + "]"
        return json.dumps(str(v), ensure_ascii=False)

    return text(dict(sorted(value.items()))) if isinstance(value, dict) else text(value)


def derivation_hash(**params) -> str:
    """HSH-01: the address of what the parameters derive; their order does not matter."""
    return hashlib.sha256(canonical_json(params).encode()).hexdigest()


def derivation_hash_of(**columns: Column) -> Column:
    """HSH-01 for columns: one hash a row."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def image_derivation_hash(content_hash: Column, fingerprint: Column, processor: Column, params: Column) -> Column:
    """HSH-02: over the content hash, else the fingerprint; a row with neither fails the job."""
    identity = F.coalesce(content_hash, fingerprint, F.raise_error(F.lit("either content_hash or fingerprint is required")).cast("string"))
    return derivation_hash_of(image_identity=identity, processor=processor, params=params)


def profile_signature(profile: dict, path: str | None = None, content: bytes | None = None) -> str:
    """HSH-06: over the profile, its file's base name and that file's SHA-256 (null without a file)."""
    return derivation_hash(profile=profile, profile_file=(path or "").rsplit("/", 1)[-1], profile_file_hash=None if content is None else hashlib.sha256(content).hexdigest())


def short_digest(value: Column, n: int = 16) -> Column:
    """HSH-07: the first characters of a SHA-256, as for cache folders."""
    return F.substring(F.sha2(value, 256), 1, n)


def paired_hash(image_hash: Column, mask_hash: Column) -> Column:
    """JN-18: the hash of a sample with a mask."""
    return F.concat(F.coalesce(image_hash, F.lit("")), F.lit(":"), F.coalesce(mask_hash, F.lit("")))


def collection_hashes(rows: DataFrame, group: str, value: str, spec: dict | None = None) -> DataFrame:
    """AGG-16: (group, n, collection_hash): the derivation hash of ``spec`` with the sorted values as ``image_hashes``.

    Sample ids do not enter. A hash of a whole collection is one stream by its nature: the values are exchanged by group and sorted (on
    disk, if need be), and a task feeds them to the hash one by one, so a collection of any size takes no memory.
    """
    mark = "\0values\0"
    head, tail = canonical_json({**(spec or {}), "image_hashes": mark}).split(json.dumps(mark))
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        nothing = object()
        now, n, h = nothing, 0, None

        def done():
            h.update(("]" + tail).encode())
            return pa.RecordBatch.from_arrays([pa.array([now], group_type), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], names=[group, "n", "collection_hash"])

        for b in batches:
            group_type = b.schema.field(0).type
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g != now:
                    if now is not nothing:
                        yield done()
                    now, n, h = g, 0, hashlib.sha256((head + "[").encode())
                h.update((("," if n else "") + json.dumps(v, ensure_ascii=False)).encode())
                n += 1
        if now is not nothing:
            yield done()

    given = rows.select(group, F.col(value).cast("string").alias("_v")).where("_v is not null")
    return given.repartition(group).sortWithinPartitions(group, "_v").mapInArrow(run, f"{group} {kind}, n long, collection_hash string")


def fingerprints(files: DataFrame) -> DataFrame:
    """HSH-04: (path, fingerprint) for ``files`` (path, length, mtime in seconds, content): size, time and both ends, as one SHA-256.

    Sizes and times enter as big-endian 64-bit numbers; the time's bits have no built-in function, so they are made in Arrow batches.
    """
    @F.pandas_udf("binary")
    def head(size: pd.Series, mtime: pd.Series) -> pd.Series:
        import numpy as np

        both = np.empty((len(size), 2), ">u8")
        both[:, 0], both[:, 1] = size.to_numpy(np.uint64), mtime.to_numpy(">f8").view(">u8")
        return pd.Series([x.tobytes() for x in both])

    ends = F.concat(head("length", "mtime"), F.substring("content", 1, END_BYTES), F.when(F.col("length") > END_BYTES, F.substring("content", -END_BYTES, END_BYTES)).otherwise(F.lit(b"")))
    return files.select("path", F.sha2(ends, 256).alias("fingerprint"))


def fingerprint_diff(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-07: ``fresh`` (dataset_id, sample_id, fingerprint, ...) with ``status`` against the stored table; unchanged rows need no write."""
    old = stored.select("dataset_id", "sample_id", F.col("fingerprint").alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("fingerprint"), "changed").otherwise("unchanged")
    return fresh.join(old, ["dataset_id", "sample_id"], "left").withColumn("status", status).drop("_old")


def encode_request(value) -> str:
    """JSN-02: a request as ``B64:`` and URL-safe base 64 of its JSON, without padding."""
    return "B64:" + base64.urlsafe_b64encode(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_request(text: str):
    """JSN-02: the value of a request, of plain JSON, or the text itself."""
    body = text.removeprefix("B64:")
    for data in (lambda: base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4), validate=True).decode(), lambda: text):
        try:
            return json.loads(data())
        except ValueError:
            continue
    return text


def decoded(request: Column) -> Column:
    """JSN-02 for a column: the JSON of each request; what is no base 64 is taken as JSON itself."""
    body = F.translate(F.regexp_replace(request, "^B64:", ""), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.startswith(request, F.lit("B64:")), F.unbase64(padded).cast("string")).otherwise(request)


def resource_names(job) -> list[str]:
    """JN-20, MAP-02: the resources that a job names anywhere, in the order of their first mention."""
    #: The fields that name a resource.
    fields = ("resource", "dataset_id", "image_asset", "mask_asset", "mask_b_asset", "reference_asset", "dicom_asset", "rt_asset", "dose_asset", "plan_asset", "wsi_asset")
    out: dict[str, None] = {}

    def visit(value, field: str) -> None:
        if isinstance(value, dict):
            if field == "resource" and isinstance(value.get("name"), str):
                out[value["name"]] = None
            for k, v in value.items():
                visit(v, k)
        elif isinstance(value, (list, tuple)):
            for v in value:
                visit(v, "")
        elif field in fields and isinstance(value, str) and value:
            out[value] = None

    visit(job, "")
    return list(out)


def enriched(job: dict, hashes: DataFrame) -> dict:
    """JN-20: a job with the hashes of the resources that it and each of its steps name; unsupported and empty ones are left out.

    ``hashes``: resource_name, content_hash, source, updated_at. What comes to the driver is one row for each name in the job.
    """
    names = resource_names(job)
    found = hashes.where(F.col("resource_name").isin(names) & (F.col("source") != "unsupported") & (F.coalesce("content_hash", F.lit("")) != "")) if names else None
    known = {r["resource_name"]: {"name": r["resource_name"], "content_hash": r["content_hash"], "source": r["source"], "updated_at": r["updated_at"]} for r in found.collect()} if names else {}
    if not known:
        return job
    out = {**job, "content_hashes": {n: known[n] for n in names if n in known}}
    if job.get("steps"):
        steps = []
        for s in job["steps"]:
            mine = {n: known[n] for n in resource_names(s) if n in known}
            steps.append({**s, "resource_hashes": mine} if mine else s)
        out["steps"] = steps
    return out
