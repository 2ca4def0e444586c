"""Imaging resources: their URLs, what they resolve to, and a Spark data source over them (SRC-05, SRC-06, SRC-20, SRC-26, SRC-28, SRC-31, STM-06)."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.scalars import sample_id
from lumenframe.sources.files import read_table

#: The scheme, the bucket of URLs without one, hosts that are reached without TLS, hosts without a region.
SCHEME, BUCKET = "imaging+dataset://", "imaging-data"
PLAIN_HOST, NO_REGION = r"^(\d|localhost|minio|host\.docker)", r"^(\d|localhost|minio|\.local|host\.docker)"
REGION = "us-east-1"


def parse_url(url: str) -> dict:
    """SRC-26: ``dataset_id``, ``params`` (endpoint, bucket, prefix, region) and ``s3`` of a resource URL.

    Three forms: ``id?endpoint=..&bucket=..``, ``host/bucket/collection[@region]`` and a bare id, which the registry knows.
    """
    body = url.removeprefix(SCHEME)
    if body.find("?") > 0:
        name, _, query = body.partition("?")
        given = dict(p.split("=") for p in unquote(query).split("&") if p.count("=") == 1 and not p.endswith("="))
        params = {"endpoint": given.get("endpoint", ""), "bucket": given.get("bucket", BUCKET), "prefix": given.get("prefix", f"datasets/{name}"), "region": given.get("region", "")}
        return {"dataset_id": name, "params": params, "s3": True}
    at = re.search("@[a-z]", body)
    region = body[at.start() + 1 :] if at else ""
    body = body[: at.start()] if at else body
    host, slash, rest = body.partition("/")
    if not (slash and host):
        return {"dataset_id": body, "params": {}, "s3": False}
    bucket, _, collection = rest.partition("/")
    region = region or ("" if re.search(NO_REGION, host) else REGION)
    params = {"endpoint": ("http" if re.search(PLAIN_HOST, host) else "https") + "://" + host, "bucket": bucket, "prefix": collection, "region": region}
    return {"dataset_id": collection.removesuffix("/").rsplit("/", 1)[-1], "params": params, "s3": True}


def parsed_url(url: Column) -> Column:
    """SRC-26 for a column: a struct of dataset_id, endpoint, bucket, prefix, region and s3, in built-in functions."""
    body = F.regexp_replace(url, "^" + re.escape(SCHEME), "")
    query = F.regexp_extract(body, r"^[^?]+\?(.*)$", 1)
    # a plus sign is no space here
    given = F.str_to_map(F.url_decode(F.replace(query, F.lit("+"), F.lit("%2B"))), F.lit("&"), F.lit("="))
    name = F.regexp_extract(body, r"^([^?]+)\?", 1)
    value = lambda k, default: F.coalesce(F.nullif(F.try_element_at(given, F.lit(k)), F.lit("")), default)
    old = F.struct(name.alias("dataset_id"), value("endpoint", F.lit("")).alias("endpoint"), value("bucket", F.lit(BUCKET)).alias("bucket"), value("prefix", F.concat(F.lit("datasets/"), name)).alias("prefix"), value("region", F.lit("")).alias("region"), F.lit(True).alias("s3"))
    asked = F.regexp_extract(body, r"^.*?@([a-z].*)$", 1)
    plain = F.regexp_replace(body, r"@[a-z].*$", "")
    part = lambda i: F.regexp_extract(plain, r"^([^/]+)/([^/]*)/?(.*)$", i)
    scheme = F.when(part(1).rlike(PLAIN_HOST), "http://").otherwise("https://")
    region = F.when(asked != "", asked).when(part(1).rlike(NO_REGION), "").otherwise(REGION)
    last = F.regexp_extract(F.regexp_replace(part(3), "/$", ""), r"([^/]*)$", 1)
    new = F.struct(last.alias("dataset_id"), F.concat(scheme, part(1)).alias("endpoint"), part(2).alias("bucket"), part(3).alias("prefix"), region.alias("region"), F.lit(True).alias("s3"))
    none = F.lit("")
    bare = F.struct(plain.alias("dataset_id"), none.alias("endpoint"), none.alias("bucket"), none.alias("prefix"), none.alias("region"), F.lit(False).alias("s3"))
    return F.when(body.rlike(r"^[^?]+\?"), old).when(part(1) != "", new).otherwise(bare)


def resource_url(kind: str, params: dict) -> str | None:
    """SRC-31: the URL of a self-hosted store (``imaging-minio``) or of a cloud one (``imaging-aws``); None for other kinds."""
    if kind == "imaging-minio":
        return f"{SCHEME}{params['host']}/{params['bucket']}/{params['collection']}"
    if kind == "imaging-aws":
        return f"{SCHEME}s3.{params['region']}.amazonaws.com/{params['bucket']}/{params['collection']}@{params['region']}"
    return None


def is_for(url: str) -> bool:
    """SRC-28: whether a URL is one of ours."""
    return url.startswith(SCHEME)


def client(url: str, credentials: dict | None = None, registry: Callable[[str], dict] | None = None) -> dict:
    """SRC-28: where a resource's data set lies. The resource's own place and credentials go before the registry's entry."""
    if not is_for(url):
        raise ValueError(f"not an imaging resource: {url}")
    found = parse_url(url)
    entry = dict(registry(found["dataset_id"])) if registry and not found["s3"] else {}
    params = {k: v for k, v in found["params"].items() if v}
    out = {**entry, **params, **{k: v for k, v in (credentials or {}).items() if v}, "dataset_id": found["dataset_id"]}
    if found["s3"]:
        out["manifest_uri"] = f"s3://{params['bucket']}/{params.get('prefix', '').rstrip('/')}/manifest.yaml"
    return out


def as_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """SRC-05: a manifest's metadata as a table."""
    meta = manifest.get("metadata") or {}
    uri = meta.get("file") or meta.get("uri")
    if not uri:
        raise ValueError("the manifest names no metadata")
    return read_table(spark, uri)


def register_source(spark: SparkSession) -> None:
    """SRC-28: ``spark.read.format("imaging").option("path", folder)``: sample_id, path and length of every file below a folder.

    A Python data source, for callers who want samples by name; ``binaryFile`` underneath reads contents.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.root = options.get("path")

        def partitions(self):
            import os

            places = [os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if not f.startswith(".")]
            places.sort()
            n = max(1, min(256, len(places) // 1000))
            return [InputPartition(places[i::n]) for i in range(n)]

        def read(self, partition):
            import os

            for p in partition.value:
                name = os.path.basename(p)
                known = re.sub(r"(?i)\.(nii\.gz|nii|nrrd|mha|mhd|dcm)$", "", name)
                yield (known if known != name else re.sub(r"\.[^.]+$", "", name), p, os.path.getsize(p))

    class Imaging(DataSource):
        @classmethod
        def name(cls):
            return "imaging"

        def schema(self):
            return "sample_id string, path string, length long"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Imaging)


def materialised(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """SRC-20: of a listed prefix (path) the files with one of a role's extensions, with their sample ids; executors read them where they are."""
    tail = "|".join(re.escape(e.lstrip(".")) for e in extensions)
    return files.where(F.lower("path").rlike(rf"\.({tail})$")).withColumn("sample_id", sample_id(F.col("path")))


def look_up(wanted: DataFrame, index: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STM-06: (answers, new rows of the index) for ``wanted`` (resource_name).

    What the index holds is returned as it is; else what ``located`` (resource_name, content_hash, source, bucket, object_key) has computed,
    which also becomes part of the index; else a row of nulls with the source ``unsupported``.
    """
    names = wanted.select("resource_name").distinct()
    known = index.select("resource_name", F.struct("content_hash", "source").alias("_known"))
    fresh = located.select("resource_name", F.struct("content_hash", "source").alias("_fresh")).dropDuplicates(["resource_name"])
    rows = names.join(known, "resource_name", "left").join(fresh, "resource_name", "left")
    hit = F.coalesce("_known", "_fresh")
    answers = rows.select("resource_name", hit["content_hash"].alias("content_hash"), F.coalesce(hit["source"], F.lit("unsupported")).alias("source"))
    new = located.join(names, "resource_name", "left_semi").join(index.select("resource_name"), "resource_name", "left_anti").dropDuplicates(["resource_name"])
    return answers, new
