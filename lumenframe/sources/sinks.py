
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.publishing import collection_features


def write_features(df: DataFrame, path: str) -> None:
    """SNK-03: a feature table as Parquet, one row a sample; the commit protocol makes it whole or absent."""
    df.write.mode("overwrite").parquet(path)


def write_collection(parts: dict[str, DataFrame], root: str, selected: list[str] | None = None) -> str:
    """SNK-02: the features of all samples under ``root``."""
    path = f"{root.rstrip('/')}/radiomics_features.parquet"
    write_features(collection_features(parts, selected), path)
    return path


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """SNK-04: a table as CSV with a header, in the order of ``fields``; null is an empty cell."""
    df.select(*(fields or df.columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK-05: a table as JSON, one object a line."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """SNK-05: one small document, indented by two; on any file system that Spark knows."""
    put_text(spark, path, json.dumps(summary, indent=2) + "\n")


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _place(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, text: str, mode: str | None = None) -> None:
    """Writes a small file beside its place and renames it, so that readers see the old or the new one. ``mode``: octal permissions."""
    p, fs = _place(spark, path)
    jvm = spark.sparkContext._jvm
    stage, _ = _place(spark, f"{path}.tmp")
    out = fs.create(stage, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if mode:
        fs.setPermission(stage, jvm.org.apache.hadoop.fs.permission.FsPermission(mode))
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(stage, p):
        raise OSError(f"could not put {path}")


def get_text(spark: SparkSession, path: str) -> str:
    p, fs = _place(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_files(files: DataFrame, root: str, target: str) -> DataFrame:
    """SNK-06, SRC-12: copies ``files`` (path) from below ``root`` to the same places below ``target``, on the executors; (path, to, bytes).

    Contents are streamed in pieces by the task that has the path, from and to file systems that the worker can open; a lost task is run
    again and puts the same files. Stores are written by Spark's own writers instead.
    """

    def run(batches: Iterator) -> Iterator:
        import os
        import shutil

        import pyarrow as pa

        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                at = p.removeprefix("file://").removeprefix("file:")
                to = os.path.join(target, os.path.relpath(at, root))
                os.makedirs(os.path.dirname(to), exist_ok=True)
                shutil.copyfile(at, to + ".tmp")
                os.replace(to + ".tmp", to)
                out.append((p, to, os.path.getsize(to)))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "to", "bytes"), x, strict=True)) for x in out], pa.schema([("path", pa.string()), ("to", pa.string()), ("bytes", pa.int64())]))

    return files.select("path").mapInArrow(run, "path string, to string, bytes long")


def register_dataset(registry: dict, dataset_id: str, entry: dict) -> dict:
    """SNK-08: the registry with a data set added or its fields replaced; a field of None is left as it was."""
    datasets = dict(registry.get("datasets") or {})
    datasets[dataset_id] = {**(datasets.get(dataset_id) or {}), **{k: v for k, v in entry.items() if v is not None}}
    return {**registry, "schema_version": registry.get("schema_version", 1), "datasets": datasets}


def write_registry(spark: SparkSession, path: str, dataset_id: str, entry: dict) -> dict:
    """SNK-08: read, change and put a registry kept as JSON (which is YAML too), for owner and group only."""
    now = json.loads(get_text(spark, path)) if exists(spark, path) else {}
    new = register_dataset(now, dataset_id, entry)
    put_text(spark, path, json.dumps(new, indent=2), "660")
    return new


def write_credential(spark: SparkSession, path: str, name: str, identity: str, secret: str) -> None:
    """SNK-08: credentials by name, for the owner only; they never enter a table."""
    now = json.loads(get_text(spark, path)) if exists(spark, path) else {}
    put_text(spark, path, json.dumps({**now, name: {"identity": identity, "secret": secret}}, indent=2), "600")


def write_model(spark: SparkSession, root: str, model: dict, force: bool = False) -> bool:
    """SNK-12: a model's manifest and its mark; what is installed stays unless ``force``. Says whether it wrote."""
    mark = f"{root.rstrip('/')}/{model['name']}.installed"
    if exists(spark, mark) and not force:
        return False
    put_text(spark, f"{root.rstrip('/')}/{model['name']}.json", json.dumps(model, indent=2))
    put_text(spark, mark, "")
    return True


def write_runners(spark: SparkSession, root: str, runners: dict[str, dict]) -> list[str]:
    """SNK-09: one definition a file, as JSON (which is YAML too)."""
    for name, runner in runners.items():
        put_text(spark, f"{root.rstrip('/')}/{name}.yml", json.dumps({"name": name, **runner}, indent=2))
    return sorted(runners)


def folder_signature(files: DataFrame) -> DataFrame:
    """SNK-10: (signature): the SHA-256 of the sorted ``place=hash`` lines of ``files`` (rel, hash): equal for equal contents."""
    lines = files.select(F.concat("rel", F.lit("="), "hash").alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("signature"))


def place_once(spark: SparkSession, root: str, files: dict[str, str]) -> str:
    """SNK-10: a runtime's files in a folder named after their contents, with a mark when all are there; a second call finds it."""
    lines = sorted(f"{rel}={hashlib.sha256(text.encode()).hexdigest()}" for rel, text in files.items())
    folder = f"{root.rstrip('/')}/{hashlib.sha256(chr(10).join(lines).encode()).hexdigest()}"
    if not exists(spark, f"{folder}/.complete"):
        for rel, text in files.items():
            put_text(spark, f"{folder}/{rel}", text)
        put_text(spark, f"{folder}/.complete", "")
    return folder
