"""The queries of this sub-package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, licenses, lm, mixing, nearcopies, quality, sharding, substring, warc
from .oracles import oracle_sql  # noqa: F401


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _over_documents(op):
    return lambda spark, sf_dir: op(_documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_iblt_fingerprints": _over_documents(fingerprints.op1),
        "op2_byte_bpe": _over_documents(bpe.op2),
        "op3_window_dedup": _over_documents(substring.op3),
        "op4_minhash_near": _over_documents(nearcopies.op4),
        "op5_warc_captures": lambda spark, sf_dir: warc.op5(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op6_histogram_shards": _over_documents(sharding.op6),
        "op7_line_quality": _over_documents(quality.op7),
        "op8_backoff_lm": _over_documents(lm.op8),
        "op9_pfair_mix": _over_documents(mixing.op9),
        "op10_license_scan": _over_documents(licenses.op10),
    }
