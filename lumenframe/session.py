"""SparkSession settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lumenframe", master: str | None = None) -> SparkSession:
    """A session with UTC time, AQE and local defaults; on a cluster the submitter's settings win."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.aggregatePushdown", "true")
    )
    if master is None and "SPARK_MASTER" not in os.environ:
        master = f"local[{cpus}]"
        builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table; ``sf_dir`` may be on any file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
