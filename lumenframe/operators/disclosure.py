
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import bucket_count

THRESHOLD = 3
OPEN = ("sandbox_open", "trusted_internal")
HARDENED = ("clinical_hardened", "high_sensitivity_dp")
PROFILES = (*OPEN, "clinical_default", *HARDENED)


def safe_count(n: Column, profile: str, threshold: int = THRESHOLD) -> Column:
    """DSC-01."""
    if profile in OPEN:
        return n
    if profile in HARDENED:
        return F.when(n < threshold, F.lit(None)).otherwise(bucket_count(n))
    return bucket_count(n)


def safe_distribution(n: Column, profile: str, threshold: int = THRESHOLD) -> Column:
    """DSC-02."""
    if profile in HARDENED:
        return F.lit(None).cast("long")
    return n if profile in OPEN else F.when(n >= threshold, bucket_count(n))


def label_distribution(df: DataFrame, columns: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """AGG-01: counts of non-null labels, cells below the threshold left out."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def suppressed_classes(df: DataFrame, columns: list[str], threshold: int = THRESHOLD) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") < threshold, 1).otherwise(0)), F.lit(0)).cast("long").alias("suppressed"))


def assert_min_samples(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """AGG-04: reads at most ``threshold`` rows to decide."""
    if df.limit(threshold).count() < threshold:
        raise PermissionError(f"fewer than {threshold} rows")
    return df
