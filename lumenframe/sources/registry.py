
from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_table, table_format

#: The kinds of assets a manifest may name.
ASSET_KINDS = (
    "image_root", "mask_root", "feature_table", "wsi_root", "dicom_series_root", "rt_struct_root", "rt_dose_file", "rt_plan_file",
    "rt_seg_root", "dose_table", "qc_table", "qc_visual_asset", "embedding_table", "wsi_tile_root", "registration_root", "multimodal_ref",
)
#: Fixed value: the form of a dataset id.
DATASET_ID = r"[a-z0-9][a-z0-9._-]*"
#: Settings that a publishing target takes from its dataset unless it has its own.
INHERITED = ("endpoint", "credentials_ref", "region")


@dataclass(frozen=True)
class Dataset:
    """A registry entry, with the settings of where it is read and where results are published."""

    dataset_id: str
    manifest_uri: str | None
    source: dict
    publish: dict | None = None
    entry: dict = field(default_factory=dict)


def parse_document(text: str) -> dict:
    """A JSON document, or a YAML one where a YAML library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML library is installed") from e
        return yaml.safe_load(text) or {}


def read_document(spark: SparkSession, uri: str) -> dict:
    """SRC-13: one small document from any file system that Spark reads."""
    return parse_document(spark.read.text(uri, wholetext=True).first()["value"])


def _version(document: dict) -> int:
    try:
        return int(document.get("schema_version") or 0)
    except (TypeError, ValueError):
        return 0


def load_registry(document: dict) -> dict[str, dict]:
    """SRC-17: the entries by dataset id; ``manifest`` is an older name of ``manifest_uri``."""
    if _version(document) < 1:
        raise ValueError("registry has no valid schema_version")
    entries = {k: dict(v or {}) for k, v in document.items() if k != "schema_version"}
    for e in entries.values():
        if e.get("manifest_uri") is None and "manifest" in e:
            e["manifest_uri"] = e["manifest"]
    return entries


def enabled(entries: dict[str, dict]) -> dict[str, dict]:
    """FLT-09: all entries but those that are switched off."""
    return {k: e for k, e in entries.items() if e.get("enabled") is not False}


def resolve(entries: dict[str, dict], dataset_id: str) -> Dataset:
    """SRC-18."""
    if dataset_id not in entries:
        raise KeyError(f"unknown dataset {dataset_id!r}; the registry has {', '.join(sorted(entries))}")
    e = entries[dataset_id]
    if e.get("enabled") is False:
        raise PermissionError(f"dataset {dataset_id!r} is disabled")
    source = {"backend": backend(e.get("backend") or "file"), **{k: e.get(k) for k in INHERITED}}
    own, publish = e.get("publish"), None
    if own is not None:
        publish = {k: own[k] if own.get(k) is not None else source[k] for k in ("backend", *INHERITED)}
        publish = {**publish, "backend": backend(publish["backend"]), "uri_prefix": own.get("uri_prefix")}
    return Dataset(dataset_id, e.get("manifest_uri"), source, publish, e)


def backend(kind: str) -> str:
    """SRC-14."""
    if kind not in ("file", "s3"):
        raise ValueError(f"unknown storage backend {kind!r}")
    return kind


#: The names under which credentials give identity and secret, the region of a store without an endpoint, hosts that have none.
IDENTITY, SECRET = ("identity", "identifier", "access_key", "username"), ("secret", "password", "secret_key")
REGION, OWN_HOSTS = "us-east-1", ("minio", "host.docker")


def s3_settings(config: dict, secrets: Callable[[str], dict] | None = None, environment: dict | None = None) -> dict[str, str]:
    """SRC-15: the Hadoop settings of an S3 store. Keys come from ``secrets(credentials_ref)``, else from the environment."""
    found = secrets(config["credentials_ref"]) if secrets and config.get("credentials_ref") else {}
    env = environment or {}
    pick = lambda names: next((found[n] for n in names if found.get(n)), None)
    access = pick(IDENTITY) or env.get("AWS_ACCESS_KEY_ID")
    secret = pick(SECRET) or env.get("AWS_SECRET_ACCESS_KEY")
    if not access or not secret:
        raise PermissionError("no S3 credentials found")
    endpoint = config.get("endpoint")
    out = {"spark.hadoop.fs.s3a.access.key": access, "spark.hadoop.fs.s3a.secret.key": secret}
    if endpoint:
        out |= {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": "true"}
    region = auto_region(endpoint, config.get("region"))
    return out | ({"spark.hadoop.fs.s3a.endpoint.region": region} if region else {})


def auto_region(endpoint: str | None, explicit: str | None = None) -> str:
    """SRC-16: the given region; the default one without an endpoint; none for hosts that are no public store."""
    if explicit:
        return explicit
    if not endpoint:
        return REGION
    host = re.sub(r"^[a-z]+://", "", endpoint.lower()).split("/")[0].split(":")[0]
    own = re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", host) or host.startswith(OWN_HOSTS) or "." not in host or host.endswith(".local")
    return "" if own else REGION


def uri_errors(uri, label: str) -> list[str]:
    """FLT-11."""
    if not isinstance(uri, str) or not uri:
        return [f"{label}: no URI"]
    if uri.startswith("s3://"):
        return [] if uri[5:].split("/")[0] else [f"{label}: no bucket in {uri}"]
    if not uri.startswith("/"):
        return [f"{label}: neither absolute nor s3://: {uri}"]
    return [f"{label}: '..' in {uri}"] if ".." in uri.split("/") else []


def under_root_errors(path: str, root: str, label: str) -> list[str]:
    """FLT-11: a path must lie below its root, as written and without ``..``."""
    base = root.rstrip("/")
    wrong = ".." in path.split("/") or not (path == base or path.startswith(base + "/"))
    return [f"{label}: not below {root}: {path}"] if wrong else []


def manifest_errors(manifest: dict) -> list[str]:
    """FLT-12: all that is wrong with a manifest; keys it does not know are left alone."""
    errors = [] if _version(manifest) >= 1 else ["schema_version: missing or below 1"]
    if not re.fullmatch(DATASET_ID, str(manifest.get("dataset_id") or "")):
        errors.append("dataset_id: missing or malformed")
    meta = manifest.get("metadata") or {}
    errors += uri_errors(meta.get("uri"), "metadata.uri")
    if meta.get("format") not in (None, "parquet", "csv"):
        errors.append(f"metadata.format: {meta['format']}")
    for name, asset in (manifest.get("assets") or {}).items():
        asset = asset or {}
        errors += uri_errors(asset.get("uri"), f"assets.{name}.uri")
        if asset.get("kind") not in (None, *ASSET_KINDS):
            errors.append(f"assets.{name}.kind: {asset['kind']}")
    for i, label in enumerate(manifest.get("labels") or []):
        if not label.get("name"):
            errors.append(f"labels[{i}].name: missing")
        errors += uri_errors(label.get("uri"), f"labels[{i}].uri")
    return errors


def metadata(spark: SparkSession, manifest: dict) -> DataFrame:
    """SRC-05, SRC-06: the metadata table of a manifest: ``file`` before ``uri``."""
    wrong = manifest_errors(manifest)
    if wrong:
        raise ValueError("; ".join(wrong))
    meta = manifest["metadata"]
    path = (meta.get("file") or meta["uri"]).replace("s3://", "s3a://", 1)
    return read_table(spark, path, meta.get("format") or table_format(path, strict=False))


def size_and_columns(table: DataFrame) -> tuple[int, list[str]]:
    """SRC-04: of a Parquet table only the footers are read."""
    return table.agg(F.count("*")).first()[0], table.columns
